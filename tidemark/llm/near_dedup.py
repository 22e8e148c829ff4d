"""MinHash near-deduplication: universal minima, banding, verification, star components.

Documents with equal shingle sets form one class, and only classes are compared.  Each
bucket of a band links its members to the bucket's smallest class; a link counts once the
signatures agree well enough and the full sets reach the threshold.  Components follow from
alternating large-star and small-star.  Members of a bucket that are still in different
components are then compared in blocks on their full sets, so no link between members
of one bucket is lost, while the members of one component are never paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, field, lean, row_key, ship, worker_state
from tidemark.llm.components import connected

ship(__name__)

FEATURES = "doc_id long, row long, n long, node binary, signature array<int>"
#: Texts that a worker holds the sets or signatures of at a time.
SLICE = 250


@dataclass(frozen=True)
class Settings:
    """Word shingles, threshold in percent, and the bands.

    With 36 bands of 5 minima a pair at 80 percent shares no bucket with probability 6e-7
    (25 bands at 85 percent: 4e-7).  ``agree`` is the least number of equal minima a pair needs before its sets are read:
    5 standard deviations below the mean at the threshold.
    """

    words: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5
    seed: int = 7
    block_items: int = 1_000_000

    @property
    def agree(self) -> int:
        n, p = self.bands * self.rows, self.percent / 100
        return int(n * p - 5 * (n * p * (1 - p)) ** 0.5)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < 200_000:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles, A-Z lower-cased."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: both touch ASCII only
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(found) < words:
        found, words = [b" ".join(found)], 1
    hashes = np.fromiter(map(worker_state("word hashes", _WordHashes).__getitem__, found), dtype=np.uint64, count=len(found))
    total = np.zeros(len(hashes) - words + 1, dtype=np.uint64)
    for i in range(words):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - words + 1 + i] + np.uint64(i + 1))
    return np.unique(total)


def _minima(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 32-bit value per universal hash function; values carry their function's number."""
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(items), 2048):
        np.minimum(least, (a[:, None] * items[None, at : at + 2048] + b[:, None]).min(axis=1), out=least)
    return (_mix(least + np.arange(len(a), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _functions(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the universal hash functions."""
    a, b = np.random.default_rng(settings.seed).integers(1, 1 << 63, (2, settings.bands * settings.rows), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows in frames of at most ``SLICE`` rows, so that a worker's results do not add up over an Arrow batch."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.iloc[at : at + SLICE]


def _features(settings: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _functions(settings)
        for batch in _slices(batches):
            counts, nodes, signatures = [], [], []
            for text in batch["text"]:
                items = shingles(text, settings.words)
                counts.append(len(items))
                nodes.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                signatures.append(_minima(items, a, b) if len(items) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "row": batch["row"], "n": counts, "node": nodes, "signature": signatures})

    return run


def _sets(settings: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _functions(settings)
        for batch in _slices(batches):
            items = [shingles(t, settings.words) for t in batch["text"]]
            signatures = [_minima(x, a, b) for x in items]
            yield pd.DataFrame({"node": batch["node"], "items": [x.view(np.int64) for x in items], "signature": signatures, "marks": [s.astype(np.uint8).tobytes() for s in signatures]})

    return run


def close(a_items: Column, b_items: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, on distinct arrays."""
    shared = F.size(F.array_intersect(a_items, b_items)).cast("long")
    return 100 * shared >= percent * (F.size(a_items) + F.size(b_items) - shared)


def _cross_links(percent: int, agree: int):
    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        """Links between members of different components; fewer than there are components.

        Signatures rule out most pairs: equal minima have equal marks, so a pair with fewer
        than ``agree`` equal marks fails.  The sets of the others are compared.
        """
        block = block.sort_values("node", ignore_index=True)
        sizes = block["items"].map(len).to_numpy()
        place = np.unique(np.concatenate(block["items"].to_list()), return_inverse=True)[1].astype(np.int32)
        places = np.split(place, np.cumsum(sizes)[:-1])
        marks = np.frombuffer(b"".join(block["marks"]), dtype=np.uint8).reshape(len(block), -1)
        number = {p: i for i, p in enumerate(dict.fromkeys(block["part"]))}
        part = block["part"].map(number).to_numpy()
        largest = np.bincount(part).argmax()  # pairs inside a component, and so inside the largest, need no look
        seen, links = np.zeros(place.max() + 1, dtype=np.int32), []
        for x in np.flatnonzero(part != largest):
            fits = (part != part[x]) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
            others = np.flatnonzero(fits)
            others = others[(marks[others] == marks[x]).sum(axis=1) >= agree]
            if not len(others):
                continue
            seen[places[x]] = 1
            shared = np.add.reduceat(seen[np.concatenate([places[y] for y in others])], np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
            seen[places[x]] = 0
            for y in others[100 * shared >= percent * (sizes[others] + sizes[x] - shared)]:
                if part[y] != part[x]:
                    links.append((block["node"][x], block["node"][y]))
                    part[part == part[y]] = part[x]
        return pd.DataFrame(links, columns=["node", "other"])

    return run


def _residual(members: DataFrame, parts: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links across components among members of one bucket, from blocks of bounded size.

    Every member has been compared with its bucket's centre, so only the others are left,
    and only where they lie in several components.
    """
    labelled = members.where("node <> centre").join(parts, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("part"))
    mixed = labelled.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.sum("n").alias("items")).where("low <> high")
    blocks = mixed.select("bucket", F.ceil(F.col("items") / settings.block_items).cast("int").alias("blocks"))
    # Every pair of blocks meets once; a bucket of one block, the usual case, is one group.
    mine = labelled.join(blocks, "bucket").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = mine.select("bucket", "node", "part", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("bucket", "node", "part", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"))
    return spread.join(sets, "node").groupBy("bucket", "first", "second").applyInPandas(_cross_links(settings.percent, settings.agree), "node binary, other binary")


def classes(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(features of every row, (node, root) of every class that is linked to a smaller one)."""
    source = docs.select(field(docs, "doc_id", "long").alias("doc_id"), field(docs, "text", "string").alias("text"))
    source = source.withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    buckets = F.transform(F.sequence(F.lit(0), F.lit(settings.bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * settings.rows + 1, settings.rows)))
    found = cut(source.mapInPandas(lean(_features(settings)), FEATURES).select("doc_id", "row", "n", "node", F.when(F.col("node").isNotNull(), buckets).alias("buckets")))
    reps = found.where("node is not null").groupBy("node").agg(F.min(F.struct("row", "n", "buckets")).alias("rep"))
    banded = reps.select("node", "rep.row", "rep.n", F.explode("rep.buckets").alias("bucket"))
    # Written first, so that the join has a shuffle of its own on both sides and Spark can split hot buckets.
    shared = cut(banded.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("size")).where("size > 1").select("bucket", "centre"))
    members = cut(banded.join(shared, "bucket"))
    # Sets are rebuilt from the texts of one row per class that shares a bucket.
    wanted = members.groupBy("row").agg(F.min("node").alias("node"))
    texts = source.join(wanted, "row").dropDuplicates(["row"]).select("node", "text")
    sets = cut(texts.mapInPandas(lean(_sets(settings)), "node binary, items array<bigint>, signature array<int>, marks binary"))
    pairs = members.where("node <> centre").select("node", "centre").distinct()
    signed = sets.select("node", "signature")
    agreed = pairs.join(signed, "node").join(signed.select(F.col("node").alias("centre"), F.col("signature").alias("other")), "centre")
    agreed = cut(agreed.where(F.size(F.array_intersect("signature", "other")) >= settings.agree).select("node", "centre"))
    whole = sets.select("node", "items")
    checked = agreed.join(whole, "node").join(whole.select(F.col("node").alias("centre"), F.col("items").alias("other")), "centre")
    links = checked.where(close(F.col("items"), F.col("other"), settings.percent)).select("node", F.col("centre").alias("other"))
    stars = connected(links)
    more = cut(_residual(members.select("bucket", "node", "centre", "n"), stars.select(F.col("u").alias("node"), F.col("v").alias("root")), sets.select("node", "items", "marks"), settings))
    roots = connected(stars.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(more))
    return found, roots.select(F.col("u").alias("node"), F.col("v").alias("root"))


def decide(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The near-duplicate component of every row: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles and are linked with nothing.  component_id
    is the smallest doc_id reachable; a null doc_id is larger than any other, and a
    component of null ids has a null component_id and keeps all its rows.  Repeated rows share
    their result; :func:`deduplicate` returns one of them.
    """
    found, roots = classes(docs, settings)
    least = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    rows = found.join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "row").select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row"
    )


def deduplicate(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that stay, with all their columns; one row of each component."""
    kept = decide(docs, settings).where("kept").select(F.col("row").alias("_row"), F.col("n_shingles").alias("_n")).distinct()
    rows = docs.withColumn("_key", row_key(field(docs, "doc_id", "long"), field(docs, "text", "string"))).join(kept, F.col("_key") == F.col("_row"))
    return rows.dropDuplicates(["_key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
