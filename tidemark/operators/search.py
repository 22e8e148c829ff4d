"""Read-only query and search surface over registered tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.lineage import cut

class QueryRefused(ValueError):
    """The statement is not a read-only query over the allowed tables."""


# Parsed plan nodes of a read-only query, and built-in functions that reach outside the data.
READ_NODES = frozenset(
    "Project Filter Aggregate Join Union Intersect Except Distinct Sort GlobalLimit LocalLimit Offset SubqueryAlias UnresolvedSubqueryColumnAliases "
    "UnresolvedWith UnresolvedRelation UnresolvedHaving WithWindowDefinition OneRowRelation UnresolvedInlineTable".split()
)
REFUSED_FUNCTIONS = frozenset(
    "reflect try_reflect java_method input_file_name input_file_block_start input_file_block_length current_catalog current_database current_schema current_user session_user user version "
    "spark_partition_id monotonically_increasing_id raise_error assert_true getvariable try_variable".split()
)


def _read(spark: SparkSession, query: str, views: Iterable[str], refused: frozenset[str]):
    """The parsed plan of a query that only reads the allowed tables."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    nodes, functions, relations = set(), set(), set()
    _walk(parsed, frozenset(), nodes, functions, relations)
    if extra := sorted(nodes - READ_NODES):
        raise QueryRefused(f"only plain read queries are accepted, not {', '.join(extra)}")
    if called := sorted(functions & refused):
        raise QueryRefused(f"functions outside the data are not accepted: {', '.join(called)}")
    if unknown := sorted(relations - {v.lower() for v in views}):
        raise QueryRefused(f"relations are not registered: {unknown}")
    return parsed


def allowed_query(spark: SparkSession, query: str, views: Iterable[str], refused_functions: frozenset[str] = REFUSED_FUNCTIONS) -> DataFrame:
    """Analyse a query made of :data:`READ_NODES` over the listed tables; anything else is refused.

    Commands, table functions, sampling and generators are not among the nodes.  Spark's own
    analyser resolves names and columns afterwards.
    """
    _read(spark, query, views, refused_functions)
    return spark.sql(query)


def _items(scala_seq) -> list:
    return [scala_seq.apply(i) for i in range(scala_seq.size())]


def _walk(plan, scope: frozenset[str], nodes: set[str], functions: set[str], relations: set[str]) -> None:
    """Node kinds, function names and tables anywhere in a parsed plan: children, subqueries and CTE bodies.

    A CTE name hides a table only after its own definition.
    """
    kind = plan.getClass().getSimpleName().rstrip("$")
    nodes.add(kind)
    if kind == "UnresolvedRelation":
        name = plan.tableName().replace("`", "").lower()
        if name not in scope:
            relations.add(name)
        return
    if kind == "UnresolvedWith":
        for pair in _items(plan.cteRelations()):
            _walk(pair._2(), scope, nodes, functions, relations)
            scope = scope | {pair._1().lower()}
    for expression in _items(plan.expressions()):
        _calls(expression, functions)
    for child in (*_items(plan.children()), *_items(plan.subqueries())):
        _walk(child, scope, nodes, functions, relations)


def _calls(expression, functions: set[str]) -> None:
    if expression.getClass().getSimpleName() == "UnresolvedFunction":
        functions.add(_items(expression.nameParts())[-1].lower())
    for child in _items(expression.children()):
        _calls(child, functions)


def _ordered(parsed) -> bool:
    """Whether the outermost rows of a parsed query have an order."""
    while parsed.getClass().getSimpleName() in ("UnresolvedWith", "GlobalLimit", "LocalLimit", "Offset"):
        parsed = _items(parsed.children())[0]
    return parsed.getClass().getSimpleName() == "Sort"


def bounded(df: DataFrame, row_limit: int, byte_limit: int, *, ordered: bool = False) -> tuple[DataFrame, bool]:
    """At most ``row_limit`` rows and ``byte_limit`` JSON bytes, in a defined order.

    ``limit`` comes first (top-k per task), so the byte sum only ever sees
    ``row_limit + 1`` rows.
    """
    names = df.columns
    ranked = df if ordered else df.orderBy(*(F.col(c).asc_nulls_last() for c in names))
    top = ranked.limit(row_limit + 1).withColumn("_id", F.monotonically_increasing_id())
    place = W.partitionBy(F.lit(0)).orderBy("_id")
    sized = top.withColumns({"_row": F.row_number().over(place), "_bytes": F.sum(F.octet_length(F.to_json(F.struct(*names)))).over(place)})
    sized = cut(sized)  # row_limit + 1 rows, computed once
    fits = (F.col("_row") <= row_limit) & (F.col("_bytes") <= byte_limit)
    truncated = not sized.where(~fits).isEmpty()
    return sized.where(fits).orderBy("_row").select(*names), truncated


def bounded_sql(spark: SparkSession, query: str, views: Sequence[str], *, row_limit: int = 500, byte_limit: int = 100_000) -> tuple[DataFrame, bool]:
    """The first rows of an accepted query, and whether there were more."""
    parsed = _read(spark, query, views, REFUSED_FUNCTIONS)
    return bounded(spark.sql(query), row_limit, byte_limit, ordered=_ordered(parsed))


def text_match(df: DataFrame, query: str) -> Column:
    """Case-insensitive substring test over every string column."""
    tests = [F.contains(F.lower(F.col(c)), F.lit(query.lower())) for c, kind in df.dtypes if kind == "string"]
    return F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests)), F.lit(False)) if tests else F.lit(False)


def search_text(df: DataFrame, query: str) -> DataFrame:
    return df if not query else df.where(text_match(df, query))


def find(df: DataFrame, *, query: str = "", equals: dict[str, str | None] | None = None, newest: str | None = None, ties: Sequence[str] = (), limit: int = 50) -> DataFrame:
    """Filter, search and keep the newest rows (a top-k, no full sort)."""
    for column, value in (equals or {}).items():
        if value and column in df.columns:
            df = df.where(F.col(column) == value)
    df = search_text(df, query)
    if newest:
        df = df.orderBy(F.col(newest).desc(), *(F.col(c).desc() for c in ties))
    return df.limit(limit)


def changes(config_changes: DataFrame, flags: DataFrame, *, service: str | None = None, query: str = "", limit: int = 50) -> DataFrame:
    """Configuration changes and flag states in one list, nulls last."""
    both = config_changes.withColumn("record_kind", F.lit("configuration")).unionByName(flags.withColumn("record_kind", F.lit("feature_flag")), allowMissingColumns=True)
    both = both.where(F.col("service") == service) if service else both
    order = [F.col(c).asc_nulls_last() for c in ("changed_at", "valid_from", "record_kind") if c in both.columns]
    return search_text(both, query).orderBy(*order).limit(limit)


def extract_refs(df: DataFrame, *, single: Sequence[str] = (), lists: Sequence[str] = (), json_lists: Sequence[str] = ()) -> DataFrame:
    """Distinct evidence ids held in plain, array and JSON-array columns."""
    arrays = [F.array(F.col(c)) for c in single] + [F.col(c) for c in lists] + [F.from_json(c, "array<string>") for c in json_lists]
    merged = F.array_distinct(F.flatten(F.array(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays))))
    return df.select(F.explode(merged).alias("evidence_record_id")).where("evidence_record_id IS NOT NULL").distinct()


# Marker words, path fields and the path pattern.
SECRET_MARKERS = ("api_key", "token", "secret", "password", "authorization")
PATH_FIELDS = ("dataset_dir", "analytics_dir", "detection_dir", "impact_dir", "evidence_dir", "audit_dir")
PATH_PATTERN = r"""(?:(?:file:)?/[^\s'"\\]+|[A-Za-z]:\\[^\s'"\\]+)"""


def redact_text(column: str | Column) -> Column:
    """Replace path-like substrings."""
    return F.regexp_replace(F.col(column) if isinstance(column, str) else column, PATH_PATTERN, "[PATH_REDACTED]")


def redact_map(column: str | Column) -> Column:
    """Mask secret-named keys, drop path fields and redact path-like values of a map."""
    source = F.col(column) if isinstance(column, str) else column
    kept = F.map_filter(source, lambda k, v: ~_is_path(k))
    return F.transform_values(kept, lambda k, v: F.when(_is_secret(k), F.lit("[REDACTED]")).otherwise(redact_text(v)))


_OBJECT, _ARRAY = "map<string,variant>", "array<variant>"
UNREAD = '"[REDACTED]"'
#: Levels that one column expression walks; plans nested much deeper overflow the analyser's stack.
LEVELS = 4


def json_depth(column: str | Column) -> Column:
    """How deep objects and lists are nested in JSON text."""
    brackets = F.regexp_replace(F.regexp_replace(column, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    step = lambda state, c: F.struct((state["now"] + c).alias("now"), F.greatest(state["most"], state["now"] + c).alias("most"))
    signs = F.transform(F.split(brackets, ""), lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0))
    return F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def _entries(value: Column) -> Column:
    """Members of an object with their keys, or elements of a list without; null for anything else."""
    members = F.transform(F.map_entries(F.try_variant_get(value, "$", _OBJECT)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    elements = F.transform(F.try_variant_get(value, "$", _ARRAY), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.coalesce(members, elements)


def _is_path(key: Column) -> Column:
    return F.lower(key).isin(*PATH_FIELDS, "path") | F.endswith(F.lower(key), F.lit("_path"))


def _is_secret(key: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(key), F.lit(m)) for m in SECRET_MARKERS))


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def _redacted(value):
    """The rules of ``redact_json`` on a parsed value."""
    if isinstance(value, dict):
        kept = {k: v for k, v in sorted(value.items()) if not (k.lower() in (*PATH_FIELDS, "path") or k.lower().endswith("_path"))}
        return {k: "[REDACTED]" if any(m in k.lower() for m in SECRET_MARKERS) else _redacted(v) for k, v in kept.items()}
    if isinstance(value, list):
        return [_redacted(v) for v in value]
    return re.sub(PATH_PATTERN, "[PATH_REDACTED]", value) if isinstance(value, str) else value


def _distinct(members: list[tuple]) -> dict:
    if len({k for k, _ in members}) < len(members):
        raise ValueError("a key repeats")
    return dict(members)


def _refuse(text: str):
    raise ValueError(f"{text} is not JSON")


@F.pandas_udf(StringType())
def _redact_deep(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(_redacted(json.loads(text, object_pairs_hook=_distinct, parse_constant=_refuse)), separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            return UNREAD

    return texts.map(one)


def redact_json(column: str | Column) -> Column:
    """Mask secret-named keys, drop path fields and redact path-like strings at every level of JSON text.

    Values of up to ``LEVELS`` levels are walked as VARIANT in one column expression;
    a Python helper receives only the rows that are nested deeper.  Rows stay where they
    are.  Keys come out sorted.  Objects and lists that are no valid JSON, repeat a key or are
    nested beyond what the parsers read are masked whole; any other unreadable text is redacted
    as text.  Null stays null.
    """
    def walk(value: Column, left: int) -> Column:
        plain = F.to_json(value)
        text = F.startswith(plain, F.lit('"'))
        leaf = F.when(text, _quoted(redact_text(F.try_variant_get(value, "$", "string")))).otherwise(plain)
        nested = F.startswith(plain, F.lit("{")) | F.startswith(plain, F.lit("["))
        if not left:
            return F.when(nested, F.lit(UNREAD)).otherwise(leaf)
        kept = F.filter(_entries(value), lambda e: e["key"].isNull() | ~_is_path(e["key"]))

        def shown(entry: Column) -> Column:
            inner = F.when(F.coalesce(_is_secret(entry["key"]), F.lit(False)), F.lit(UNREAD)).otherwise(walk(entry["value"], left - 1))
            return F.concat(F.when(entry["key"].isNotNull(), F.concat(_quoted(entry["key"]), F.lit(":"))).otherwise(""), inner)

        inside = F.array_join(F.transform(kept, shown), ",")
        return F.when(nested, F.concat(F.left(plain, F.lit(1)), inside, F.right(plain, F.lit(1)))).otherwise(leaf)

    whole = F.col(column) if isinstance(column, str) else column
    deep = json_depth(whole) > LEVELS
    unread = F.when(F.regexp_like(whole, F.lit(r"^\s*[\[{]")), F.lit(UNREAD)).otherwise(redact_text(whole))
    near = F.coalesce(walk(F.try_parse_json(whole), LEVELS), unread)
    return F.when(deep, _redact_deep(F.when(deep, whole))).when(whole.isNotNull(), near)


def nested_refs(df: DataFrame, column: str) -> DataFrame:
    """Distinct evidence ids named at any level of JSON text, one ``evidence_record_id`` a row.

    Ids are strings under ``evidence_record_id``, elements of a list under
    ``evidence_record_ids`` and elements of the list written in a string under
    ``evidence_record_ids_json``; elements that are null are no ids.  Text that is no valid
    JSON names none.  The walk takes ``LEVELS`` levels at a time: what lies deeper
    becomes rows of its own, so the number of passes follows from the deepest text.
    """
    shape = "array<struct<id:string,rest:string>>"
    none = F.array().cast(shape)
    found = lambda v: F.struct(v.alias("id"), F.lit(None).cast("string").alias("rest"))

    def named(key: Column, value: Column) -> Column:
        text = F.when(F.startswith(F.to_json(value), F.lit('"')), F.try_variant_get(value, "$", "string"))
        many = F.when(key == "evidence_record_ids", value).when(key == "evidence_record_ids_json", F.try_parse_json(text))
        listed = F.transform(F.try_variant_get(many, "$", _ARRAY), lambda v: F.try_variant_get(v, "$", "string"))
        return F.transform(F.coalesce(F.when(key == "evidence_record_id", F.array(text)), listed, F.array().cast("array<string>")), found)

    def walk(value: Column, left: int) -> Column:
        if not left:
            plain = F.to_json(value)
            nested = F.startswith(plain, F.lit("{")) | F.startswith(plain, F.lit("["))
            return F.when(nested, F.array(F.struct(F.lit(None).cast("string").alias("id"), plain.alias("rest")))).otherwise(none)
        return F.coalesce(F.flatten(F.transform(_entries(value), lambda e: F.concat(named(e["key"], e["value"]), walk(e["value"], left - 1)))), none)

    texts, parts = df.select(F.col(column).alias("rest")), []
    readable = F.when(F.try_parse_json(column).isNotNull(), json_depth(column))
    deepest = df.agg(F.coalesce(F.max(readable), F.lit(0))).first()[0]
    for _ in range(0, deepest, LEVELS):
        texts = texts.select(F.inline(walk(F.try_parse_json("rest"), LEVELS)))
        parts.append(texts.select("id").where("id IS NOT NULL"))
        texts = texts.select("rest").where("rest IS NOT NULL")
    every = reduce(DataFrame.unionByName, parts) if parts else df.select(F.lit(None).cast("string").alias("id")).where("id IS NOT NULL")
    return every.select(F.col("id").alias("evidence_record_id")).distinct()


GENESIS = "0" * 64


def chain_hash(columns: Sequence[str], previous: str = "previous_hash") -> Column:
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted((*columns, previous))))), 256)


def verify_hash_chain(log: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = (), sequence: str = "sequence", previous: str = "previous_hash", own: str = "record_hash") -> DataFrame:
    """Violations of an ordered, hash-chained log.

    Neighbours meet through an equi-join on sequence + 1, so a log of any length
    is checked in parallel instead of in one ordered window.
    """
    last = log.select(*keys, (F.col(sequence) + 1).alias(sequence), F.col(own).alias("_expected")).dropDuplicates([*keys, sequence])
    copies = log.groupBy(*keys, sequence).agg(F.count(F.lit(1)).alias("_copies"))
    rows = log.join(last, [*keys, sequence], "left").join(copies, [*keys, sequence])
    first = F.col(sequence) == 1
    flags = F.array_compact(F.array(
        F.when(F.col("_copies") > 1, F.lit("sequence.repeated")),
        F.when(~first & F.col("_expected").isNull(), F.lit("sequence.gap")),
        F.when(F.col(previous) != F.when(first, F.lit(GENESIS)).otherwise(F.coalesce("_expected", F.col(previous))), F.lit("chain.previous")),
        F.when(F.col(own) != chain_hash([*columns, sequence], previous), F.lit("chain.hash")),
    ))
    return rows.select(*keys, sequence, F.explode(flags).alias("code"))


def result_digest(df: DataFrame) -> DataFrame:
    """Row count, JSON bytes and an order-insensitive hash of a result."""
    text = F.to_json(F.struct(*df.columns))
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("byte_count"),
                  F.coalesce(F.sum(F.xxhash64(text).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("content_hash"))
