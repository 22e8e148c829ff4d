"""Cutting plan lineage with reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.io import scratch_dir


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``; make one only in local mode."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
    elif spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the shared scratch folder, for readers that need them several times."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise to the checkpoint folder and forget how it was computed."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
