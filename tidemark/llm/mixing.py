"""Mixing sources to target weights: a temperature found by bisection, then budgeted block permutations.

Each source's share of all tokens is raised to an exponent in [0, 1] and normalised.  The
exponent is bisected to the largest value that reaches the target entropy, or to the
smallest that keeps every source within the repetition limit, if that is larger.  A
source is read in whole passes and one part of a pass, as its weight in the token budget
demands.  A pass is a permutation of the source in two levels: blocks in seeded order, and
rows in seeded order inside each block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, field, row_key, stored

ENTROPY_SHARE, REPETITIONS, BLOCK_TOKENS, SEED = 0.97, 2.0, 1 << 18, 11
#: Up to so many different source totals are summed on the driver, more by Spark; exponents tried at once.
TOTALS, TRIED = 10_000, 15


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised powers of the token shares; sources without tokens weigh nothing."""
    total = sum(tokens.values())
    powers = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    norm = sum(powers.values())
    return {s: p / norm if norm else 0.0 for s, p in powers.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def passes(tokens: dict[str, int], shares: dict[str, float], budget: int | None = None) -> dict[str, float]:
    """How often each source is read; without a budget the least repeated one is read exactly once."""
    if budget is None:
        budget = max((n / shares[s] for s, n in tokens.items() if n), default=0)
    return {s: shares[s] * budget / n if n else 1.0 for s, n in tokens.items()}


def bisect(wanted, low: float, high: float, steps: int = 60) -> float:
    """The largest value in [low, high] for which ``wanted`` holds, true below and false above."""
    if wanted(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if wanted(middle) else (low, middle)
    return low


def exponent(tokens: dict[str, int], entropy_share: float = ENTROPY_SHARE, repetitions: float = REPETITIONS, budget: int | None = None) -> float:
    """The exponent for a target entropy (a share of the greatest possible), raised as far as the repetition limit needs."""
    live = {s: n for s, n in tokens.items() if n}
    if len(live) < 2:
        return 1.0
    found = bisect(lambda t: entropy(weights(live, t)) >= entropy_share * math.log(len(live)), 0.0, 1.0)
    within = lambda t: max(passes(live, weights(live, t), budget).values()) <= repetitions
    return found if within(found) else 1.0 - bisect(lambda d: within(1.0 - d), 0.0, 1.0 - found)


def measures(sizes: DataFrame, total: int, known: int = TOTALS):
    """A function from exponents to (sum of powers of the shares, entropy of the weights) over (tokens, sources) rows."""
    few = sizes.limit(known + 1).collect()
    if len(few) <= known:
        logs, times = np.log(np.array([r["tokens"] for r in few], dtype=float) / total), np.array([r["sources"] for r in few], dtype=float)
        sums = lambda t: (float((p := times * np.exp(t * logs)).sum()), float((p * logs).sum()))
        found = lambda tried: [sums(t) for t in tried]
    else:

        def found(tried: list[float]) -> list[tuple[float, float]]:
            log = F.log(F.col("tokens") / F.lit(float(total)))
            power = [F.col("sources") * F.exp(F.lit(t) * log) for t in tried]
            row = sizes.agg(*[F.sum(p) for p in power], *[F.sum(p * log) for p in power]).first()
            return list(zip(row[: len(tried)], row[len(tried) :], strict=True))

    return lambda tried: [(norm, math.log(norm) - t * moment / norm) for t, (norm, moment) in zip(tried, found(tried), strict=True)]


def sections(wanted, low: float, high: float, rounds: int = 12) -> float:
    """``bisect`` for a test of many values at once."""
    if wanted([high])[0]:
        return high
    for _ in range(rounds):
        tried = [low + (high - low) * k / (TRIED + 1) for k in range(1, TRIED + 1)]
        good = wanted(tried)
        at = good.index(False) if False in good else TRIED
        low, high = tried[at - 1] if at else low, tried[at] if at < TRIED else high
    return low


def plan(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, repetitions: float = REPETITIONS, budget: int | None = None, known: int = TOTALS) -> DataFrame:
    """One row per source: source, tokens, weight, passes.  Of the sources only sums reach the driver."""
    sources = cut(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    all_ = sources.where("tokens > 0").agg(F.count("*").alias("n"), F.sum("tokens").alias("total"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if not all_["n"]:
        return sources.withColumn("weight", F.lit(0.0)).withColumn("passes", F.lit(1.0))
    total = all_["total"]
    measure = measures(cut(sources.where("tokens > 0").groupBy("tokens").agg(F.count("*").alias("sources"))), total, known)
    # Larger sources are read less often: the largest sets the budget, the smallest meets the repetition limit.
    read = lambda n, t, norm: (n / total) ** t / norm / n
    size = lambda t, norm: 1 / read(all_["most"], t, norm) if budget is None else budget
    power = 1.0
    if all_["n"] > 1:
        power = sections(lambda ts: [e >= entropy_share * math.log(all_["n"]) for _, e in measure(ts)], 0.0, 1.0)
        within = lambda ts: [read(all_["least"], t, norm) * size(t, norm) <= repetitions for t, (norm, _) in zip(ts, measure(ts), strict=True)]
        if not within([power])[0]:
            power = 1.0 - sections(lambda ds: within([1.0 - d for d in ds]), 0.0, 1.0 - power)
    norm = measure([power])[0][0]
    live = F.col("tokens") > 0
    weight = F.when(live, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(power)) / F.lit(norm)).otherwise(0.0)
    passes_ = F.when(live, F.col("weight") * F.lit(float(size(power, norm))) / F.col("tokens")).otherwise(1.0)
    return sources.withColumn("weight", weight).withColumn("passes", passes_)


def draw(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, repetitions: float = REPETITIONS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """Which document is read in which pass: doc_id, row, source, tokens, weight, pass, block, place.

    Tokens are words between white space.  A null source is a source of its own, "".  Empty
    and null texts have no tokens: they are read once per whole pass and take no budget.  The
    budget is in tokens; None stands for the size at which the least repeated source is read
    exactly once, so that no document is left out.  The last, partial pass of a source ends with
    the document that reaches its budget.  Repeated rows (same id and text) are read each,
    and all of them or none in a partial pass.  An empty table gives no rows.
    """
    text = F.coalesce(field(docs, "text", "string"), F.lit(""))
    source = F.coalesce(field(docs, "source", "string"), F.lit(""))
    words = F.regexp_count(text, F.lit("[^ \t-\r]+")).cast("long")
    key = row_key(field(docs, "doc_id", "long"), field(docs, "text", "string"))
    rows = cut(docs.select(field(docs, "doc_id", "long").alias("doc_id"), key.alias("row"), source.alias("source"), words.alias("tokens")))
    shares = stored(plan(rows, entropy_share, repetitions, budget), "shares")
    known = rows.join(shares.withColumnRenamed("tokens", "source_tokens"), "source")
    each = known.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("passes") - 1, F.lit(0)).cast("int"))))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_tokens") / block_tokens))
    placed = each.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row", "pass"), blocks)).withColumn("key", F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "row", "pass"), 1))
    whole = placed.where("pass + 1 <= passes + 1e-9")
    # Only the last pass of a source is cut: blocks before the budget, then rows of the block it falls in.
    part = placed.where("pass + 1 > passes + 1e-9").withColumn("allowed", F.round((F.col("passes") - F.col("pass")) * F.col("source_tokens")).cast("long"))
    sums = part.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    runs = sums.withColumn("run", (F.col("block") / 1024).cast("long"))
    totals = runs.groupBy("source", "run").agg(F.sum("block_tokens").alias("run_tokens"))
    ahead = totals.select("source", "run", F.expr("coalesce(sum(run_tokens) over (partition by source order by run rows between unbounded preceding and 1 preceding), 0)").alias("ahead"))
    inside = F.expr("coalesce(sum(block_tokens) over (partition by source, run order by block rows between unbounded preceding and 1 preceding), 0)")
    starts = runs.select("source", "run", "block", inside.alias("inside")).join(ahead, ["source", "run"]).select("source", "block", (F.col("inside") + F.col("ahead")).alias("start"))
    located = part.join(starts, ["source", "block"]).withColumn("before", F.expr("start + coalesce(sum(tokens) over (partition by source, block order by key range between unbounded preceding and 1 preceding), 0)"))
    taken = located.where("before < allowed")
    columns = ["doc_id", "row", "source", "tokens", "weight", "pass", "block", "key"]
    return whole.select(*columns).unionByName(taken.select(*columns)).withColumnRenamed("key", "place")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a document comes once per pass that reads it."""
    read = draw(docs, **options).select(F.col("row").alias("_row"), "pass").distinct().groupBy("_row").agg(F.count("*").cast("int").alias("_reads"))
    rows = docs.withColumn("_key", row_key(field(docs, "doc_id", "long"), field(docs, "text", "string"))).join(read, F.col("_key") == F.col("_row"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_reads"))).select(*[F.col(f"`{c}`") for c in docs.columns])
