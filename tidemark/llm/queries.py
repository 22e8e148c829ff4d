"""One query per operator, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, html_text, mixing, near_dedup, packing, periodic, private, quality, rules, sharding, substring, toxicity, trie
from tidemark.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    shards = sharding.shard(documents(spark, sf_dir))
    return shards.select("doc_id", sharding.record_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(documents(spark, sf_dir)).drop("row")


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir)).withColumn("broken", F.array_join("broken", ","))


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(documents(spark, sf_dir))


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.decide(documents(spark, sf_dir), near_dedup.Settings(words=3, percent=85, bands=25)).drop("row")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), packing.default_tokenizer())


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.clean(documents(spark, sf_dir))


def _with_periods(docs: DataFrame) -> DataFrame:
    """The contract's texts: one document in ten repeats its words from some word on with some period."""
    text, h = F.coalesce("text", F.lit("")), F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(F.translate(text, rules.WHITE, " " * len(rules.WHITE)), " "), "")
    plan = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words"))
    plan = plan.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    plan = plan.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    built = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i))), " ")
    return plan.select("doc_id", F.when(F.col("n") > 0, built).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(_with_periods(documents(spark, sf_dir))).withColumn("best", periodic.best_run(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"), head_of=lambda c: F.crc32(c.cast("string")) % 9, base_of=lambda c: c - c % 5)


@query
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find(documents(spark, sf_dir))
    base = [k.name for k in private.KINDS if k.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in base], F.sha2(private.written(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        private.written(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


ORACLES["op6_exact_dedup"] = """
with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""

_STOP = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
ORACLES["op4_quality_rules"] = rf"""
with t as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from documents
), grams as (
    select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g from t, unnest(generate_series(1, len(words) - 2)) as u(i)
), twice as (
    select doc_id, i from grams qualify count(*) over (partition by doc_id, g) > 1
), covered as (
    select doc_id, count(distinct i + k) as n from twice, unnest([0, 1, 2]) as v(k) group by doc_id
), m as (
    select t.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(covered.n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines, len(list_filter(words, lambda w: w in ({_STOP})))::bigint as n_stop_words,
        len(list_filter(words, lambda w: upper(w) = w and lower(w) <> w))::bigint as n_upper_words
    from t left join covered on t.doc_id = covered.doc_id
), b as (
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, concat_ws(',',
        case when word_chars < 2.0 * n_words or word_chars > 12.0 * n_words then 'word_length' end,
        case when n_symbols > 0.15 * n_words then 'symbols_per_word' end,
        case when n_upper_words > 0.4 * n_words then 'shouting_words' end,
        case when n_stop_words < 0.02 * n_words then 'stop_words' end,
        case when n_dup_lines > 0.4 * n_lines then 'duplicate_lines' end) as broken
    from m
)
select *, not base_failed and broken = '' as kept from b
"""

# Unsigned CRC-32 of a decimal number, byte by byte and bit by bit.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)), "
    "lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint)"
)
ORACLES["op12_prefix_trie"] = f"""
with t as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as n
    from conversations where conv_id is not null
), own as (
    select conv_id, list(sha256(length(role)::varchar || ':' || role || text) order by n) as keys, list(strlen(text) order by n) as sizes from t group by conv_id
), plan as (
    select own.*, conv_id - conv_id % 5 as base, ({_CRC} % 9)::int as h from own
), built as (
    select p.conv_id, list_concat(coalesce(b.keys[1:p.h], []), p.keys[p.h + 1:]) as keys, list_concat(coalesce(b.sizes[1:p.h], []), p.sizes[p.h + 1:]) as sizes
    from plan p left join own b on b.conv_id = p.base
), rows as (
    select conv_id, d, len(keys) as n, array_to_string(keys[1:d], '') as node, case when d > 0 then array_to_string(keys[1:d - 1], '') end as up, case when d > 0 then sizes[d] else 0 end as bytes
    from built, unnest(range(0, len(keys) + 1)) as u(d)
), nodes as (
    select node, min(conv_id) as conv_id, min(d) as depth, min(up) as up, count(*) as n_convs, max(bytes) as bytes,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where d = n), '')) as ends_sha256
    from rows group by node
), kids as (
    select up as node, count(*) as n_children from nodes where up is not null group by up
), full_nodes as (
    select n.*, coalesce(k.n_children, 0) as n_children, p.conv_id as parent_conv_id
    from nodes n left join kids k on k.node = n.node left join nodes p on p.node = n.up
), sums as (
    select a.node, sum(case when f.n_children = 0 then 1 else 0 end)::bigint as n_leaves, sum((f.n_convs - 1) * f.bytes)::bigint as saved_tokens
    from full_nodes f, unnest(range(0, f.depth + 1)) as u(d) join nodes a on a.node = f.node[1:64 * u.d] group by a.node
)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from full_nodes join sums using (node)
"""


def _private_sql() -> str:
    """Spans of every kind in SQL: the base kinds with the contract's own patterns."""
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: case when i % 2 = 1 then {digits}[-i]::int else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][{digits}[-i]::int + 1] end)) % 10 = 0"
    moved = "replace(value, ' ', '')[5:] || replace(value, ' ', '')[1:4]"
    mod = (
        f"list_reduce(list_prepend(0::bigint, list_transform(string_split({moved}, ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) + 945 end::bigint)), "
        "lambda acc, v: case when v < 1000 then acc * 10 + v else acc * 100 + v - 1000 end % 97) = 1"
    )
    octets = " and ".join(f"try_cast(string_split(value, '.')[{i}] as hugeint) <= 255" for i in range(1, 5))
    rows = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", octets),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"case when len({digits}) between 13 and 19 then {luhn} else false end"), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"len({digits}) between 9 and 15"),
        "iban": (r"[A-Z][A-Z][0-9][0-9]( ?[A-Z0-9]){11,30}", f"not regexp_matches(before, '[A-Za-z0-9]$') and {mod}"),
        "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "not regexp_matches(before, '[0-9-]$') and not regexp_matches(value, '^(000|666|9)|-00-|-0000$')"),
        "phone_local": (r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", r"not regexp_matches(before, '[0-9+][ ().-]*$')"),
    }
    parts = []
    for rank, kind in enumerate(private.KINDS):
        pattern, check = rows[kind.name]
        word = rf"(?i)(^|[^\p{{L}}])({'|'.join(kind.words)})([^\p{{L}}]|$)"
        keep = "ok" if kind.base else f"ok and {kind.prior} + {kind.confirmed} + case when near then {kind.context} else 0 end >= {private.PASS}"
        parts.append(f"""
select doc_id, {rank} as rank, '{kind.name}' as kind, begins, ends, {kind.prior} + {kind.confirmed} + case when near then {kind.context} else 0 end as score from (
    select *, {check} as ok, regexp_matches(before, '{word}') or regexp_matches(behind, '{word}') as near from (
        select doc_id, found[i] as value, right(pieces[i], {private.NEAR}) as before, left(pieces[i + 1], {private.NEAR}) as behind,
            (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))::bigint as begins, begins + length(found[i]) as ends
        from (select doc_id, regexp_extract_all(text, '{pattern}') as found, string_split_regex(text, '{pattern}') as pieces from documents), unnest(range(1, len(found) + 1)) as u(i))
) where {keep}""")
    base = ", ".join(f"'{k.name}'" for k in private.KINDS if k.base)
    counts = ", ".join(f"count(kind) filter (where kind = '{k.name}') as n_{k.name}" for k in private.KINDS if k.base)
    text = "string_agg(kind || ':' || begins || ':' || ends, ',' order by rank, begins)"
    return f"""with s as ({" union all ".join(parts)})
select d.doc_id, {counts}, sha256(coalesce({text} filter (where kind in ({base})), '')) as base_sha256, coalesce({text}, '') as spans,
    coalesce(string_agg(score::varchar, ',' order by rank, begins), '') as scores
from documents d left join s on s.doc_id = d.doc_id group by d.doc_id"""


ORACLES["op13_personal_data"] = _private_sql()
