"""Stage outputs shared by several queries of one session, written once each.

A stage result is published as Parquet in the shared scratch folder and read
back, the way stages hand over tables in production: readers get a short plan,
measured sizes, column pruning and filter pushdown, and a lost executor costs
nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.io import scratch_dir

CODEC = "zstd"
_PUBLISHED: dict[tuple[str, str, str], DataFrame] = {}


def published(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """The table, if this application has published it."""
    return _PUBLISHED.get((spark.sparkContext.applicationId, sf_dir, name))


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table published under ``name`` for this application and input folder."""
    return shared_parts(spark, sf_dir, name, {"": build})


def shared_parts(spark: SparkSession, sf_dir: str, name: str, builds: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """Like ``shared`` for a union of tables of one schema, written part by part.

    The driver plans one part at a time, never the whole union.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PUBLISHED:
        paths, schema = [], None
        for part, build in builds.items():
            built = build()
            if schema is not None and built.dtypes != [(f.name, f.dataType.simpleString()) for f in schema]:
                raise ValueError(f"the parts of {name} differ in columns")
            schema = schema or built.schema
            paths.append(scratch_dir(spark, f"{name}-{part}".rstrip("-")))
            built.write.parquet(paths[-1], compression=CODEC)
        _PUBLISHED[key] = spark.read.schema(schema).parquet(*paths)
    return _PUBLISHED[key]
