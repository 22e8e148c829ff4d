"""Helpers for registering queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.binding import base, commerce_tables, oracle_prelude
from tidemark.plans.shared import published, shared, shared_parts
from tidemark.sources.contracts import DIMENSIONS, SOURCE_SPECS

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Named queries and, where one exists, the SQL giving the same result."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = sql
            return query

        return register

    def merge(self, other: "Catalog") -> None:
        self.queries.update(other.queries)
        self.oracles.update(other.oracles)


# Values on an exact decimal grid can sit on a rounding tie, where the last bit of
# a double decides.  Both sides add this share of the last kept digit first.
NUDGE = 0.037


def rounded(df: DataFrame, digits: int = 6, only: Sequence[str] | None = None) -> DataFrame:
    """Round double columns so that summation order does not show."""
    def shown(name: str, kind: str):
        if kind != "double" or (only is not None and name not in only):
            return F.col(name)
        return F.round(F.col(name) + F.lit(NUDGE * 10.0**-digits), digits).alias(name)

    return df.select(*(shown(c, kind) for c, kind in df.dtypes))


def r(expression: str, digits: int = 6, name: str | None = None) -> str:
    """SQL text of the same rounding."""
    label = name or expression.split(".")[-1]
    return f"round({expression} + {NUDGE * 10.0**-digits:.6e}, {digits}) AS {label}"


class LazyTables(Mapping):
    """Source tables derived from the given ones, each bound on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str, names: Sequence[str]) -> None:
        self._spark, self._dir, self._names = spark, sf_dir, tuple(names)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        return commerce_tables(self._spark, self._dir, name)[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def tables_of(spark: SparkSession, sf_dir: str, *names: str) -> LazyTables:
    return LazyTables(spark, sf_dir, names or tuple(SOURCE_SPECS))


def dims_sql(*present: str) -> str:
    """The 16 dimension columns, null unless present."""
    return ", ".join(d if d in present else f"CAST(NULL AS VARCHAR) AS {d}" for d in DIMENSIONS)


__all__ = ["Catalog", "Query", "base", "commerce_tables", "dims_sql", "oracle_prelude", "published", "r", "rounded", "shared", "shared_parts", "tables_of"]
