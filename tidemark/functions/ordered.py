"""Ordered (prefix / suffix) aggregation that never puts a whole group in one task.

A SQL window with ``partitionBy(group)`` sorts a complete group inside one task.
That is fine for bounded groups but not when one group may hold a third of the
table.  Here groups are additionally cut into value ranges if one is larger than
a range: every range is summed on its own, the short list of range totals is
accumulated per group, and the offsets are joined back.  The cut points come from Spark's range partitioning of the
order column over all rows, so one (group, range) piece holds about ``rows_per_piece`` rows
whatever the group sizes are; only rows of one equal value stay together, and callers reduce
those to one row with a count first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_PIECE = 1_000_000
LEAST_PIECES = 1
PIECE = "_piece"


def cut_points(
    df: DataFrame, order: str, rows_per_piece: int = ROWS_PER_PIECE, least: int = LEAST_PIECES, keys: Sequence[str] = ()
) -> list[float]:
    """Upper ends of even ranges of ``order``, as Spark's range partitioning places them.

    The number of ranges follows the number of rows without a cap; a table of one range needs no
    cut, nor does one where no group of ``keys`` has more rows than a range.  The driver receives
    one number per range.
    """
    values = df.select(F.col(order).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    pieces = max(least, -(-df.count() // max(rows_per_piece, 1)))
    if pieces <= 1:
        return []
    if keys and df.groupBy(*keys).count().agg(F.max("count")).first()[0] <= rows_per_piece:
        return []
    ends = values.repartitionByRange(pieces, "_v").groupBy(F.spark_partition_id().alias("_p")).agg(F.max("_v").alias("end"))
    return sorted({row["end"] for row in ends.collect() if math.isfinite(row["end"])})


def with_piece(df: DataFrame, order: str, cuts: Sequence[float], name: str = PIECE) -> DataFrame:
    """Add the range number of a value (a JVM-side binary search over the cut points).

    Nulls and NaN go to one range of their own.
    """
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    bucket = Bucketizer(splits=splits, inputCol="_order", outputCol="_bucket", handleInvalid="keep")
    placed = bucket.transform(df.withColumn("_order", F.col(order).cast("double")))
    return placed.withColumn(name, F.col("_bucket").cast("int")).drop("_order", "_bucket")


_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}


def _merge(kind: str, offset: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(offset, F.lit(0)) + local
    if kind == "product":
        return F.coalesce(offset, F.lit(1.0)) * local
    if kind == "min":
        return F.least(offset, local)
    return F.greatest(offset, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: dict[str, tuple[str, str]],
    *,
    descending: bool = False,
    cuts: Sequence[float] | None = None,
    tie_breakers: Sequence[str] = (),
    totals: Sequence[str] = (),
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Add inclusive running aggregates of ``measures`` per ``keys`` along ``order``.

    ``measures`` maps a new column to ``(sum|min|max|product, source column)``.
    ``totals`` names measures whose whole-group value is added as ``<name>_total``.
    Rows should be unique on (keys, order, tie_breakers) for a defined result.
    """
    if cuts is None:
        cuts = cut_points(df, order, rows_per_piece, keys=keys)
    staged = with_piece(df, order, cuts)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    local = (
        W.partitionBy(*keys, PIECE)
        .orderBy(direction(order), *(F.col(t) for t in tie_breakers))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    whole = W.partitionBy(*keys, PIECE)
    if not cuts:
        wanted = {name: _COMBINE[kind](source).over(local) for name, (kind, source) in measures.items()}
        wanted |= {f"{name}_total": _COMBINE[measures[name][0]](measures[name][1]).over(whole) for name in totals}
        return staged.withColumns(wanted).drop(PIECE)

    pieces = staged.groupBy(*keys, PIECE).agg(
        *(_COMBINE[kind](source).alias(f"_p_{name}") for name, (kind, source) in measures.items())
    )
    before = (
        W.partitionBy(*keys)
        .orderBy(F.col(PIECE).desc() if descending else F.col(PIECE).asc())
        .rowsBetween(W.unboundedPreceding, -1)
    )
    group = W.partitionBy(*keys)
    offsets = pieces.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys),
        F.col(PIECE).alias("_k_piece"),
        *(
            _COMBINE[kind](f"_p_{name}").over(before).alias(f"_o_{name}")
            for name, (kind, _) in measures.items()
        ),
        *(_COMBINE[measures[n][0]](f"_p_{n}").over(group).alias(f"{n}_total") for n in totals),
    )
    out = staged.withColumns({f"_l_{name}": _COMBINE[kind](source).over(local) for name, (kind, source) in measures.items()})
    match = F.col(PIECE) == F.col("_k_piece")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = out.join(offsets, match, "left")
    out = out.withColumns({name: _merge(kind, F.col(f"_o_{name}"), F.col(f"_l_{name}")) for name, (kind, _) in measures.items()})
    drop = [PIECE, "_k_piece", *(f"_k_{k}" for k in keys)]
    drop += [f"_o_{n}" for n in measures] + [f"_l_{n}" for n in measures]
    return out.drop(*drop)


def group_quantiles(
    counted: DataFrame,
    keys: Sequence[str],
    value: str,
    count: str,
    wanted: dict[str, float],
    *,
    nearest: bool = False,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Exact quantiles from ``(keys, value) -> count`` rows.

    One row per key group with the non-null count as ``n`` and one column per
    entry of ``wanted`` (name -> probability).  Linear interpolation, or the
    value at the nearest rank when ``nearest``.
    """
    present = counted.where(F.col(value).isNotNull()).select(*keys, value, count)
    ranked = running(
        present, keys, value, {"_cum": ("sum", count)}, totals=["_cum"], rows_per_piece=rows_per_piece
    )
    last = F.col("_cum_total") - 1
    holds = lambda index: (index >= F.col("_cum") - F.col(count)) & (index < F.col("_cum"))
    aggregates: list[Column] = [F.max("_cum_total").alias("n")]
    for name, p in wanted.items():
        position = F.lit(float(p)) * last
        low = F.round(position) if nearest else F.floor(position)
        high = low if nearest else F.ceil(position)
        aggregates += [
            F.max(F.when(holds(low), F.col(value))).cast("double").alias(f"_lo_{name}"),
            F.max(F.when(holds(high), F.col(value))).cast("double").alias(f"_hi_{name}"),
            F.max(position - low).alias(f"_w_{name}"),
        ]
    merged = ranked.groupBy(*keys).agg(*aggregates)
    out = merged.select(
        *keys,
        F.col("n").cast("bigint").alias("n"),
        *(
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")
            ).alias(name)
            for name in wanted
        ),
    )
    return out
