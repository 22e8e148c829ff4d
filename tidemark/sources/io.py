"""Reading, writing, profiling and comparing table sets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.contracts import TableSpec

CODECS = ("zstd", "snappy", "gzip", "lz4", "uncompressed")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared checkpoint folder (local runs: under /tmp)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def load_tables(
    spark: SparkSession, directory: str, specs: Mapping[str, TableSpec], *, suffix: str = ".parquet"
) -> dict[str, DataFrame]:
    """Read every table of a set with its declared schema (no inference)."""
    return {
        name: spark.read.schema(spec.schema).parquet(f"{directory}/{name}{suffix}")
        for name, spec in specs.items()
    }


def write_tables(
    tables: Mapping[str, DataFrame],
    directory: str,
    *,
    compression: str = "zstd",
    partition_by: Mapping[str, Sequence[str]] | None = None,
    row_group_bytes: int = 128 * 1024 * 1024,
    mode: str = "errorifexists",
    suffix: str = ".parquet",
) -> None:
    """Write a table set as Parquet; the file committer makes each table atomic.

    A partitioned table is first hashed on its partition columns plus a salt,
    so a value holding a third of the rows is written by many tasks while small
    values do not become one file per task.
    """
    if compression not in CODECS:
        raise ValueError(f"unknown codec: {compression}")
    for name, df in tables.items():
        columns = list((partition_by or {}).get(name, ()))
        writer_df = df
        if columns:
            salt = (F.abs(F.xxhash64(*df.columns)) % 8).alias("salt")
            writer_df = df.repartition(*(F.col(c) for c in columns), salt)
        writer = (
            writer_df.write.mode(mode).option("compression", compression)
            .option("parquet.block.size", str(row_group_bytes))
        )
        if columns:
            writer = writer.partitionBy(*columns)
        writer.parquet(f"{directory}/{name}{suffix}")


def write_jsonl(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """One JSON object per row."""
    df.write.mode(mode).json(path)


def load_cases(
    spark: SparkSession, path: str, ddl: str, *, key: str = "case_id", multi_line: bool = True
) -> DataFrame:
    """Nested JSON rows with a declared schema; ids must be present, unique and non-empty."""
    df = spark.read.schema(ddl).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    row = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("ids"), F.coalesce(F.max("n"), F.lit(0)).alias("most"),
        F.coalesce(F.sum(F.col(key).isNull().cast("int")), F.lit(0)).alias("missing"),
    ).first()
    if row["ids"] == 0:
        raise ValueError(f"{path} holds no rows")
    if row["most"] > 1 or row["missing"]:
        raise ValueError(f"{path} must have unique non-null {key} values")
    return df


def register(spark: SparkSession, namespaces: Mapping[str, Mapping[str, DataFrame]]) -> list[str]:
    """Temp views named ``<namespace>__<table>``; returns the names, sorted."""
    names = []
    for namespace, tables in namespaces.items():
        for table, df in tables.items():
            df.createOrReplaceTempView(f"{namespace}__{table}")
            names.append(f"{namespace}__{table}")
    return sorted(names)


def profile_table(df: DataFrame, name: str, timestamp_columns: Iterable[str] = (), primary_key: Iterable[str] = ()) -> DataFrame:
    """One row per column: table row count, nulls, type, key flag, time range of the table.

    A single aggregate over the table; only its one result row is exploded.
    """
    times, keys = list(timestamp_columns), set(primary_key)
    nulls = [F.coalesce(F.sum(F.col(c).isNull().cast("bigint")), F.lit(0)).alias(f"_n{i}") for i, c in enumerate(df.columns)]
    bounds = [F.min(c).alias(f"_lo_{c}") for c in times] + [F.max(c).alias(f"_hi_{c}") for c in times]
    row = df.agg(F.count(F.lit(1)).alias("row_count"), *nulls, *bounds)
    none = F.lit(None).cast("timestamp_ntz")
    lows = [F.col(f"_lo_{c}").cast("timestamp_ntz") for c in times]
    highs = [F.col(f"_hi_{c}").cast("timestamp_ntz") for c in times]
    low = F.least(*lows) if len(lows) > 1 else (lows[0] if lows else none)
    high = F.greatest(*highs) if len(highs) > 1 else (highs[0] if highs else none)
    columns = F.array(*(
        F.struct(
            F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("column_name"), F.lit(kind).alias("column_type"),
            F.col(f"_n{i}").alias("null_count"), F.lit(c in keys).alias("is_key"),
        )
        for i, (c, kind) in enumerate(df.dtypes)
    ))
    return row.select(
        F.lit(name).alias("table_name"), "row_count", low.alias("min_timestamp"), high.alias("max_timestamp"), F.inline(columns)
    )


def fingerprint(df: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive content digest: row count and the sum of row hashes."""
    used = list(columns or df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.xxhash64(*used).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("content_hash"),
    ).select(F.lit(name).alias("table_name"), "row_count", "content_hash")


def verify_profiles(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Issues between two profile tables: tables, columns, types, keys, counts, time range."""
    key = ["table_name", "column_name"]
    fields = ("row_count", "min_timestamp", "max_timestamp", "position", "column_type", "null_count", "is_key")
    left = actual.select(*key, F.struct(*fields).alias("a"))
    right = expected.select(*key, F.struct(*fields).alias("e"))
    tables_a = actual.select("table_name").distinct().withColumn("in_actual", F.lit(True))
    tables_e = expected.select("table_name").distinct().withColumn("in_expected", F.lit(True))
    known = tables_a.join(tables_e, "table_name", "full")
    both = left.join(right, key, "full").join(known, "table_name")
    have_a, have_e = F.coalesce("in_actual", F.lit(False)), F.coalesce("in_expected", F.lit(False))
    matched = F.col("a").isNotNull() & F.col("e").isNotNull()

    def issue(code: str, condition, shown, wanted):
        return F.when(condition, F.struct(
            F.lit(code).alias("code"), shown.cast("string").alias("actual"), wanted.cast("string").alias("expected")
        ))

    none = F.lit(None)
    column_level = F.array(
        issue("column.missing", have_a & have_e & F.col("a").isNull(), none, F.col("e.column_type")),
        issue("column.unexpected", have_a & have_e & F.col("e").isNull(), F.col("a.column_type"), none),
        *(
            issue(code, matched & ~F.col(f"a.{f}").eqNullSafe(F.col(f"e.{f}")), F.col(f"a.{f}"), F.col(f"e.{f}"))
            for code, f in (("column.type", "column_type"), ("column.key", "is_key"), ("column.nulls", "null_count"))
        ),
    )
    columns = both.select("table_name", "column_name", F.inline(F.filter(column_level, lambda x: x.isNotNull())))
    table_fields = lambda df, tag: df.groupBy("table_name").agg(
        *(F.max(f).alias(f"{tag}_{f}") for f in ("row_count", "min_timestamp", "max_timestamp"))
    )
    sides = table_fields(actual, "a").join(table_fields(expected, "e"), "table_name", "full").join(known, "table_name")
    table_level = F.array(
        issue("table.missing", ~have_a, none, F.col("e_row_count")),
        issue("table.unexpected", ~have_e, F.col("a_row_count"), none),
        *(
            issue(code, have_a & have_e & ~F.col(f"a_{f}").eqNullSafe(F.col(f"e_{f}")), F.col(f"a_{f}"), F.col(f"e_{f}"))
            for code, f in (("table.rows", "row_count"), ("table.start", "min_timestamp"), ("table.end", "max_timestamp"))
        ),
    )
    tables = sides.select("table_name", F.lit(None).cast("string").alias("column_name"), F.inline(F.filter(table_level, lambda x: x.isNotNull())))
    return columns.unionByName(tables)


def diff_tables(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that differ between two tables with the same columns and a unique key.

    ``left_only`` / ``right_only`` / ``changed`` with the names of changed columns.
    """
    if left.columns != right.columns:
        raise ValueError("tables to compare must have the same columns")
    keys = list(key)
    others = [c for c in left.columns if c not in keys]
    a = left.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in others), F.lit(True).alias("_in_a"))
    b = right.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in others), F.lit(True).alias("_in_b"))
    joined = a.join(b, keys, "full")
    changed = F.array(*(F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in others))
    status = (
        F.when(F.col("_in_b").isNull(), "left_only").when(F.col("_in_a").isNull(), "right_only")
        .when(F.exists(changed, lambda x: x.isNotNull()), "changed")
    )
    return joined.select(
        *keys, status.alias("status"),
        F.when(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull(), F.filter(changed, lambda x: x.isNotNull())).alias("changed_columns"),
    ).where("status IS NOT NULL")


def tables_equal(left: DataFrame, right: DataFrame) -> bool:
    """Multiset equality: no row is left over on either side."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
