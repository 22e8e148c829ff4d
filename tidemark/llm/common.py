"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["LOWER", "UPPER", "ascii_lower", "cut", "documents", "field", "lean", "row_key", "scratch_path", "ship", "stored", "table", "worker_state"]


def ship(name: str) -> None:
    """Send a module's functions to Python workers by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def worker_state(name: str, make: Callable[[], object]) -> object:
    """One object per Python worker process, made at first use and kept between its tasks."""
    holder = sys.modules.setdefault("tidemark_worker_state", types.ModuleType("tidemark_worker_state"))
    if name not in holder.__dict__:
        holder.__dict__[name] = make()
    return holder.__dict__[name]


def _give_back() -> None:
    """Return memory that Arrow and the C library keep after use to the system."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over batches in a worker that gives freed memory back after every batch.

    Workers outlive their tasks; what one stage freed but kept would add to the memory of the next.
    """

    def each(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch
            del batch
            _give_back()

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(each(batches))
        _give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def field(docs: DataFrame, name: str, kind: str) -> Column:
    """A column cast to its kind; null where the table has no such column."""
    return docs[name].cast(kind) if name in docs.columns else F.lit(None).cast(kind)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def row_key(doc_id: Column, text: Column) -> Column:
    """A 64-bit key of a row, never null: rows equal in id and text share it."""
    return F.xxhash64(doc_id, doc_id.isNull(), F.coalesce(text, F.lit("")))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        cut(spark.range(1))  # makes the folder of a local session
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: smaller than a checkpoint for many rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ship(__name__)
