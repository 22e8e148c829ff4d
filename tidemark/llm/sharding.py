"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass 1 scatters whole records uniformly: a seeded rendezvous hash picks the shard
and a second seeded hash one of its buckets, whose number follows the table's bytes
so that a bucket fits in memory.  Pass 2 applies Spark's Fisher-Yates ``shuffle`` to
each bucket and writes it below ``shard=``.  What was written is the order: a task that
is run again rewrites its whole buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import field, scratch_path

SHARDS, BUCKET_BYTES, SEED = 24, 8 << 20, 17


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash of the key is largest; one more shard takes rows only into itself."""
    scores = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("score"), F.lit(s).alias("shard")) for s in range(shards)])
    return F.array_max(scores)["shard"]


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Write all records in shuffled order below ``path`` and return them with shard and slot.

    The rows come back with every column of ``docs`` plus ``shard`` (0 to shards - 1, of
    doc_id and the shard count only), ``slot`` (gapless from 0 in a shard) and
    ``grown_shard`` (with one more shard).  Columns of those names in ``docs`` are
    replaced.  A null doc_id is a key like any other; null and empty texts stay as they
    are; repeated rows are separate records, and spread over buckets by their text and by
    the partition they were read from.  An empty table writes no file and returns no rows.
    """
    key, text = field(docs, "doc_id", "long"), field(docs, "text", "string")
    own = [c for c in docs.columns if c not in ("shard", "slot", "grown_shard")]
    total = docs.agg(F.sum(record_size(text)).alias("bytes")).first()["bytes"] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    placed = docs.select(
        F.struct(*[docs[c] for c in own]).alias("record"), shard_of(key, shards, seed).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), key, text, F.spark_partition_id()), F.lit(per_shard)).alias("bucket"),
    )
    buckets = placed.repartition(shards * per_shard, "shard", "bucket").groupBy("shard", "bucket").agg(F.collect_list("record").alias("records"))
    ordered = buckets.select("shard", "bucket", F.posexplode(F.shuffle("records", seed)).alias("place", "record"))
    ordered.write.partitionBy("shard").parquet(path)
    return read_shards(docs.sparkSession.read.schema(ordered.select("bucket", "place", "record", "shard").schema).parquet(path), shards, seed)


def read_shards(written: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Records of written shards with gapless slots: bucket sizes are summed, never rows sorted."""
    sizes = written.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    # Buckets of a shard are summed in runs of 1,024, then the runs: two short windows.
    runs = sizes.withColumn("run", (F.col("bucket") / 1024).cast("long"))
    run_rows = runs.groupBy("shard", "run").agg(F.sum("rows").alias("run_rows"))
    before = F.expr("coalesce(sum(run_rows) over (partition by shard order by run rows between unbounded preceding and 1 preceding), 0)")
    inside = F.expr("coalesce(sum(rows) over (partition by shard, run order by bucket rows between unbounded preceding and 1 preceding), 0)")
    starts = runs.select("shard", "run", "bucket", inside.alias("inside")).join(run_rows.select("shard", "run", before.alias("before")), ["shard", "run"])
    starts = starts.select("shard", "bucket", (F.col("inside") + F.col("before")).alias("start"))
    rows = written.join(starts, ["shard", "bucket"])
    names = written.schema["record"].dataType.names
    kept = [F.col("record").getField(n).alias(n) for n in names]
    key = F.col("record").getField("doc_id").cast("long") if "doc_id" in names else F.lit(None).cast("long")
    return rows.select(*kept, "shard", (F.col("start") + F.col("place")).alias("slot"), shard_of(key, shards + 1, seed).alias("grown_shard"))


def shard(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """:func:`write_shards` into a new folder that all executors share."""
    return write_shards(docs, scratch_path(docs.sparkSession, "shards"), shards, bucket_bytes, seed)
