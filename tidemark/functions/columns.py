"""Column expressions shared by the operators (all JVM side)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAIN_SECONDS = {"hour": 3600, "day": 86400}


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def period_start(ts: str | Column, grain: str) -> Column:
    """Truncate UTC wall time to hour or day without touching the session zone."""
    day = col(ts).cast("date").cast("timestamp_ntz")
    if grain == "day":
        return day
    if grain == "hour":
        return day + F.make_dt_interval(hours=F.hour(col(ts)))
    raise ValueError(f"unknown time grain: {grain}")


def period_end(start: str | Column, grain: str) -> Column:
    return col(start) + F.expr(f"INTERVAL '1' {grain.upper()}")


def grain_step(grain: str | Column) -> Column:
    """Length in seconds of a time grain held in a column."""
    return F.when(col(grain) == "hour", F.lit(3600)).otherwise(F.lit(86400)).cast("bigint")


def in_window(ts: str | Column, start, end) -> Column:
    """Half-open window test; the literal bounds are pushed to the scan."""
    return (col(ts) >= F.lit(start)) & (col(ts) < F.lit(end))


def micros(ts: str | Column) -> Column:
    """UTC wall time as microseconds since 1970 (zone free)."""
    return F.timestamp_diff(
        "MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), col(ts)
    )


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Signed elapsed seconds, keeping fractions."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(1e6)


def whole_seconds_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("SECOND", col(start), col(end))


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """``n / d`` as double, null where the denominator is not positive."""
    n, d = col(numerator).cast("double"), col(denominator).cast("double")
    return F.when(d > 0, n / d)


def count_if(condition: Column) -> Column:
    """Rows meeting a condition; null counts as not met."""
    return F.coalesce(F.sum(F.when(condition, 1)), F.lit(0)).cast("bigint")


def sorted_struct(columns: Sequence[str]) -> Column:
    return F.struct(*(F.col(name) for name in sorted(columns)))


def canonical_json(columns: Iterable[str | Column]) -> Column:
    """JSON text with keys in sorted order and nulls left out."""
    names = [c for c in columns]
    if all(isinstance(c, str) for c in names):
        return F.to_json(sorted_struct(names))  # type: ignore[arg-type]
    return F.to_json(F.struct(*names))


def stable_id(prefix: str, *parts: str | Column, length: int = 20) -> Column:
    """``PREFIX-`` plus leading hex of a SHA-256 over the JSON of the parts."""
    body = F.to_json(F.struct(*(col(p).alias(f"k{i}") for i, p in enumerate(parts))))
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(body, 256), 1, length))


def keyed_uniform(key: str | Column, seed: int | str) -> Column:
    """Deterministic number in [0, 1) per key: SHA-256 of ``seed:key``.

    Thirteen hex digits (52 bits) are used so that the integer is exact in a
    double.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), col(key).cast("string")), 256)
    head = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double")
    return head / F.lit(float(16**13))


def json_list(*flags: tuple[str, Column]) -> Column:
    """JSON array of the names whose flag is true, in the order given."""
    items = F.array(*(F.when(flag, F.lit(name)) for name, flag in flags))
    return F.to_json(F.filter(items, lambda x: x.isNotNull()))


def codes(*flags: tuple[str, Column]) -> Column:
    """Array of the names whose flag is true, in the order given."""
    items = F.array(*(F.when(flag, F.lit(name)) for name, flag in flags))
    return F.filter(items, lambda x: x.isNotNull())
