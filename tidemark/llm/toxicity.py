"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the four-letter runs inside them; the vocabulary holds those that the
labelled examples tie to one label.  Examples stand in blocks; for each term the index keeps
its postings by block and the largest weight of each block.  A query sums these maxima to
an upper bound per block, visits blocks from the highest bound on, and stops when the next
bound is below its k-th best similarity, so the neighbours are exact.  Votes are weighted by
similarity, and a monotone map fitted on other labelled rows turns them into probabilities.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field as member

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, field, ship

ship(__name__)

#: Bounds of what is learnt from labelled rows: examples and calibration rows of each label, terms.
EXAMPLES, CALIBRATION, TERMS = 3000, 3000, 4000
NEIGHBOURS, BLOCK, EVIDENCE, THRESHOLD = 15, 64, 3, 0.7
WORD = re.compile(r"[^\W\d_]+")
SCORES = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, similarity: double, toxic: int>>"


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: 1 is held out, 0 gives examples, 2 calibration rows."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def terms(word: str) -> list[str]:
    return [word, *{"~" + word[i : i + 4] for i in range(len(word) - 3)}]


def counts(text: str | None) -> Counter:
    """How often each term occurs in the whole text."""
    found: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for term in terms(word):
            found[term] += n
    return found


@dataclass
class Index:
    """Examples as unit vectors over the vocabulary, inverted and cut into blocks."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: list[int]
    labels: np.ndarray
    postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per term: examples, weights, start of each block
    maxima: np.ndarray  # terms x blocks
    prior: float
    knots: list[tuple[float, float]] = member(default_factory=list)

    def vector(self, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, unit weights) of (term number, count) pairs."""
        if not pairs:
            return np.empty(0, dtype=np.int64), np.empty(0)
        numbers = np.array([t for t, _ in pairs], dtype=np.int64)
        weights = (1 + np.log([n for _, n in pairs])) * self.idf[numbers]
        return numbers, weights / np.linalg.norm(weights)

    def nearest(self, numbers: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k examples of largest cosine above 0, as (cosine, example), ties by example."""
        if not len(numbers) or not self.ids:
            return []
        bounds = weights @ self.maxima[numbers]
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or (len(best) == k and bounds[block] < -best[-1][0] - 1e-9):
                break
            scores = np.zeros(BLOCK)
            for t, w in zip(numbers, weights, strict=True):
                examples, values, starts = self.postings[t]
                a, b = starts[block], starts[block + 1]
                if b > a:
                    scores[examples[a:b] - block * BLOCK] += w * values[a:b]
            best = sorted(best + [(-scores[i], int(block) * BLOCK + int(i)) for i in np.flatnonzero(scores > 0)])[:k]
        return [(-s, e) for s, e in best]

    def votes(self, near: list[tuple[float, int]]) -> float:
        """The share of toxic votes, each weighing its squared cosine, with the prior as one weak vote."""
        power = [(s * s, self.labels[e]) for s, e in near]
        return (sum(w * y for w, y in power) + 0.2 * self.prior) / (sum(w for w, _ in power) + 0.2)

    def probability(self, votes: float) -> float:
        if not self.knots:
            return votes
        at = bisect_right([v for v, _ in self.knots], votes)
        if at in (0, len(self.knots)):
            return self.knots[min(at, len(self.knots) - 1)][1]
        (x0, y0), (x1, y1) = self.knots[at - 1], self.knots[at]
        return y0 + (y1 - y0) * (votes - x0) / (x1 - x0)


def build(vocabulary: list[tuple[str, int]], examples: list[tuple[int, int, list[tuple[int, int]]]], rows: int, prior: float) -> Index:
    """The index of (doc_id, label, (term, count) pairs) examples; vocabulary: (term, example rows with it)."""
    idf = np.array([math.log((rows + 1) / (n + 1)) + 1 for _, n in vocabulary]) if vocabulary else np.empty(0)
    blocks = -(-len(examples) // BLOCK)
    index = Index({t: i for i, (t, _) in enumerate(vocabulary)}, idf, [e[0] for e in examples], np.array([e[1] for e in examples], dtype=float), [], np.zeros((len(vocabulary), max(1, blocks))), prior)
    lists: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
    for number, (_, _, pairs) in enumerate(examples):
        for t, w in zip(*index.vector(pairs), strict=True):
            lists[t].append((number, w))
            index.maxima[t, number // BLOCK] = max(index.maxima[t, number // BLOCK], w)
    for postings in lists:
        numbers = np.array([n for n, _ in postings], dtype=np.int64)
        index.postings.append((numbers, np.array([w for _, w in postings]), np.searchsorted(numbers, np.arange(blocks + 1) * BLOCK)))
    return index


def monotone(points: list[tuple[float, int, float]]) -> list[tuple[float, float]]:
    """Knots of the rising fit (pool adjacent violators) of (votes, label, weight) points: both ends of every pool."""
    pools: list[list[float]] = []  # weight, weighted labels, lowest and highest votes
    for votes, label, weight in sorted(points):
        pools.append([weight, weight * label, votes, votes])
        while len(pools) > 1 and (pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0] or pools[-2][3] == pools[-1][2]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    return [(float(v), y / w) for w, y, low, high in pools for v in dict.fromkeys((low, high))]


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 50):
            part = batch.iloc[at : at + 50]
            found = [counts(t) for t in part["text"]]
            sizes = [len(f) for f in found]
            out = part[["doc_id", "toxic", "fold"]].loc[part.index.repeat(sizes)].reset_index(drop=True)
            yield out.assign(term=[t for f in found for t in f], n=[n for f in found for n in f.values()])


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, calibration: int = CALIBRATION, limit: int = TERMS) -> Index:
    """An index from a bounded sample of labelled rows that are not held out.

    At most ``examples`` and ``calibration`` rows of each label, the first in hash order of
    their ids; rows without a label 0 or 1 are left out.  All that reaches the driver is
    bounded by these and ``limit``.
    """
    spark = docs.sparkSession
    known = labels.select(field(labels, "doc_id", "long").alias("doc_id"), field(labels, "toxic", "int").alias("toxic"))
    known = known.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # an id with both labels is toxic
    known = known.withColumn("fold", remainder(F.col("doc_id"))).where("fold <> 1")
    shares = {(r["toxic"], r["fold"]): r["n"] for r in known.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for toxic in (0, 1):
        for fold, most in ((0, examples), (2, calibration)):
            part = known.where((F.col("toxic") == toxic) & (F.col("fold") == fold)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
            chosen = part if chosen is None else chosen.unionByName(part)
    chosen = cut(chosen.dropDuplicates(["doc_id"]))
    texts = docs.select(field(docs, "doc_id", "long").alias("doc_id"), field(docs, "text", "string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # An id that many rows share is one example, the row with the first text.
    texts = texts.groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text"))
    found = cut(texts.mapInPandas(_terms, "doc_id long, toxic int, fold long, term string, n long"))
    sizes = {r["toxic"]: r["n"] for r in chosen.where("fold = 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    tied = found.where("fold = 0").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (bad - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (good - F.col("b") + 0.5))
    strength = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    picked = tied.where((F.col("a") <= bad) & (F.col("b") <= good)).select("term", (F.col("a") + F.col("b")).alias("rows"), odds.alias("odds"), strength.alias("z"))
    picked = picked.where("abs(odds) >= 1.5 and abs(z) >= 2.5").orderBy(F.desc(F.abs("z")), "term").limit(limit)
    vocabulary = [(r["term"], r["rows"]) for r in picked.collect()]
    number = {t: i for i, (t, _) in enumerate(vocabulary)}
    kept = found.join(F.broadcast(spark.createDataFrame([(t, i) for t, i in number.items()], "term string, number int")), "term")
    vectors: dict[int, list[tuple[int, int]]] = {}
    for r in kept.select("doc_id", "number", "n").collect():
        vectors.setdefault(r["doc_id"], []).append((r["number"], r["n"]))
    rows = {f: sorted((r["doc_id"], r["toxic"]) for r in chosen.where(F.col("fold") == f).collect()) for f in (0, 2)}
    total = sum(shares.values())
    prior = (sum(n for (toxic, _), n in shares.items() if toxic) + 0.5) / (total + 1)
    # Alike examples stand together, so that block maxima are tight.
    ordered = sorted(((d, y, sorted(vectors.get(d, []))) for d, y in rows[0]), key=lambda e: ([t for t, _ in e[2]], e[0]))
    index = build(vocabulary, ordered, bad + good, prior)
    taken = Counter(y for _, y in rows[2])
    weight = {y: shares.get((y, 2), 0) / taken[y] for y in taken}
    index.knots = monotone([(index.votes(index.nearest(*index.vector(sorted(vectors.get(d, []))))), y, weight[y]) for d, y in rows[2]])
    return index


def _score(index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        vocabulary, nothing = index.vocabulary, index.probability(index.votes([]))
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = WORD.findall((text or "").lower())
                if len(known) > 300_000:
                    known.clear()
                for word in set(words).difference(known):
                    known[word] = tuple(vocabulary[t] for t in terms(word) if t in vocabulary)
                found = Counter()
                for hit in filter(None, map(known.__getitem__, words)):
                    found.update(hit)
                if not found:
                    out.append((nothing, []))
                    continue
                near = index.nearest(*index.vector(sorted(found.items())))
                out.append((index.probability(index.votes(near)), [(index.ids[e], float(s), int(index.labels[e])) for s, e in near[:EVIDENCE]]))
            scores = [min(1.0, max(0.0, float(s))) for s, _ in out]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores], "evidence": [e for _, e in out]})

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The toxicity of every row: doc_id, held_out, score, predicted, evidence.

    One row per input row.  Texts without a term of the vocabulary, null and empty ones too,
    get the calibrated prior and no evidence.  Without usable labels every score is the prior
    0.5.  A null doc_id counts as empty text in the hold-out rule.  Repeated rows get equal
    scores; of neighbours with equal cosine the first in the index count.
    """
    index = train(docs, labels)
    source = docs.select(field(docs, "doc_id", "long").alias("doc_id"), field(docs, "text", "string").alias("text"))
    return source.withColumn("held_out", remainder(F.col("doc_id")) == 1).mapInPandas(_score(index), SCORES)
