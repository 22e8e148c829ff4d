"""Periodic runs of words by block convolution.

A run is a stretch of words with a smallest period that no neighbouring word extends and that
holds at least ``power`` periods.  At each dyadic scale a text is cut into blocks, and a run
whose period lies between one and two blocks contains a whole block and its copy one period
later.  The sum of squared differences between a block and every place of the window behind it
comes from one number-theoretic transform; it is 0 exactly where the block occurs again.  The
distance of such a place is a candidate period, and the block is the seed that is extended to
both sides.  Documents of a batch are laid end to end with separators that occur once, so one
transform serves many short texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import field, ship

ship(__name__)

BLOCK, LEAST, POWER = 8, 24, 3
#: Primes of 31 bits with a primitive root; their product exceeds every sum of squares, so a sum is 0 if all residues are.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
BATCH_WORDS, TRANSFORM_WORDS = 200_000, 1 << 19
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _powers(root: int, size: int, prime: int) -> np.ndarray:
    """root ** 0, 1, ... size - 1 modulo the prime, by doubling."""
    found, step = np.ones(1, dtype=np.uint64), root
    while len(found) < size:
        found = np.concatenate([found, found * np.uint64(step) % np.uint64(prime)])
        step = step * step % prime
    return found


def _forward(rows: np.ndarray, root: int, prime: int) -> np.ndarray:
    """Transform of every row; the result comes in bit-reversed order."""
    count, size = rows.shape
    p, x, half = np.uint64(prime), rows, size // 2
    while half:
        x = x.reshape(count, -1, 2, half)
        low, high = x[:, :, 0], x[:, :, 1]
        turned = (low + (p - high)) * _powers(pow(root, size // (2 * half), prime), half, prime) % p
        x, half = np.stack([(low + high) % p, turned], axis=2), half // 2
    return x.reshape(count, size)


def _backward(rows: np.ndarray, root: int, prime: int) -> np.ndarray:
    """The inverse of :func:`_forward`, from bit-reversed order."""
    count, size = rows.shape
    p, x, half, back = np.uint64(prime), rows, 1, pow(root, prime - 2, prime)
    while half < size:
        x = x.reshape(count, -1, 2, half)
        low, high = x[:, :, 0], x[:, :, 1] * _powers(pow(back, size // (2 * half), prime), half, prime) % p
        x, half = np.stack([(low + high) % p, (low + (p - high)) % p], axis=2), half * 2
    return x.reshape(count, size) * np.uint64(pow(size, prime - 2, prime)) % p


def _squared_differences(blocks: np.ndarray, windows: np.ndarray, lags: int, prime: int, generator: int) -> np.ndarray:
    """Sum of (block - window at lag)**2 modulo the prime, for every row and lag."""
    count, block = blocks.shape
    size = 1 << int(windows.shape[1] - 1).bit_length()
    p, root = np.uint64(prime), pow(generator, (prime - 1) // size, prime)
    left = np.zeros((count, size), dtype=np.uint64)
    left[:, 0], left[:, size - block + 1 :] = blocks[:, 0], blocks[:, :0:-1]
    right = np.zeros((count, size), dtype=np.uint64)
    right[:, : windows.shape[1]] = windows
    product = _backward(_forward(left, root, prime) * _forward(right, root, prime) % p, root, prime)[:, :lags]
    own = (blocks * blocks % p).sum(axis=1) % p
    running = np.concatenate([np.zeros((count, 1), dtype=np.uint64), np.cumsum(windows * windows % p, axis=1)], axis=1)
    theirs = (running[:, block : block + lags] - running[:, :lags]) % p
    return (own[:, None] + theirs + np.uint64(2) * (p - product)) % p


def _occurrences(x: np.ndarray, starts: np.ndarray, block: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of every exact copy of a block at a distance from low to high - 1."""
    width, found = block + high - low - 1, []
    bound, product, primes = int(x.max()) ** 2 * block, 1, []
    for prime in PRIMES:
        if product <= bound:
            primes.append(prime)
            product *= prime[0]
    rows = max(1, TRANSFORM_WORDS // (2 * width))
    for at in range(0, len(starts), rows):
        part = starts[at : at + rows]
        blocks = x[part[:, None] + np.arange(block)].astype(np.uint64)
        # Places behind the last word repeat its separator, which no block holds.
        windows = x[np.minimum(part[:, None] + np.arange(low, low + width), len(x) - 1)].astype(np.uint64)
        same = np.ones((len(part), high - low), dtype=bool)
        for prime, generator in primes:
            same &= _squared_differences(blocks, windows, high - low, prime, generator) == 0
        row, lag = np.nonzero(same)
        found.append((part[row], lag + low))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _agreeing(x: np.ndarray, at: int, period: int, step: int) -> int:
    """How many places from ``at`` on, in direction ``step``, equal the word one period later."""
    total, size = 0, 64
    while True:
        if step > 0:
            low, high = at + total, min(at + total + size, len(x) - period)
        else:
            low, high = max(0, at - total - size + 1), at - total + 1
        equal = (x[low:high] == x[low + period : high + period])[::step]
        if not equal.all():
            return total + int(equal.argmin())
        total += len(equal)
        if len(equal) < size:
            return total
        size *= 2


def _extend(x: np.ndarray, place: np.ndarray, period: np.ndarray, block: int, runs: list[tuple[int, int, int]], least: int, power: int) -> None:
    """Extend seeds to runs (start, end, period) and add the new ones.

    Seeds come scale by scale, so a run of a smaller period is known before a seed at a
    multiple of it, which lies inside that run and is passed over.
    """
    order = np.argsort(place, kind="stable")
    place, period = place[order], period[order]
    fresh = np.ones(len(place), dtype=bool)
    for start, end, known in runs:
        a, b = np.searchsorted(place, [start, end])
        if a < b:
            fresh[a:b] &= (place[a:b] + block + period[a:b] > end) | (period[a:b] % known != 0)
    place, period = place[fresh], period[fresh]
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    keys, at = period * (len(x) + 1) + place, 0
    while at < len(place):
        i, p = int(place[at]), int(period[at])
        start = i - _agreeing(x, i - 1, p, -1)
        stop = i + block + _agreeing(x, i + block, p, 1)
        if stop + p - start >= max(least, power * p):
            runs.append((start, stop + p, p))
        at = int(np.searchsorted(keys, p * (len(x) + 1) + stop))


def batch_runs(texts: list[list[bytes]], least: int = LEAST, power: int = POWER) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every text, by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return [[] for _ in texts]
    ids, vocabulary = pd.factorize(np.fromiter((w for t in texts for w in t), dtype=object, count=sizes.sum()))
    offsets = np.cumsum(sizes + 1) - sizes - 1
    x = np.empty(sizes.sum() + len(texts), dtype=np.int64)
    words = np.ones(len(x), dtype=bool)
    words[offsets + sizes] = False
    x[words], x[~words] = ids, len(vocabulary) + np.arange(len(texts))
    order = np.argsort(x, kind="stable")
    again = np.full(len(x), len(x) + 1)  # distance to the next place of the same word
    same = x[order[1:]] == x[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    runs: list[tuple[int, int, int]] = []
    block = BLOCK
    while True:
        # A run of this scale has at least ``power`` blocks, and ``least`` words.
        chosen = sizes >= max(least, power * block)
        if not chosen.any():
            break
        counts = sizes[chosen] // block
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(offsets[chosen], counts) + block * inside
        # A block with a word that does not come again within two blocks has no copy there.
        far = np.concatenate([[0], np.cumsum(again >= 2 * block)])
        starts = starts[far[starts + block] == far[starts]]
        place, period = _occurrences(x, starts, block, 1 if block == BLOCK else block, 2 * block)
        for low in (1, 2, 4, block) if block == BLOCK else (block,):
            now = (period >= low) & (period < 2 * low)
            _extend(x, place[now], period[now], block, runs, least, power)
        block *= 2
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, period in sorted(runs, key=lambda r: (r[0], r[2])):
        text = int(np.searchsorted(offsets, start, side="right")) - 1
        found[text].append((start - int(offsets[text]), end - start, period))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words without those behind the first period of a run, joined by one space."""
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, kept, strict=True) if k] if runs else words).decode("utf-8", "surrogatepass")


def _detect(least: int, power: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            while at < len(batch):
                texts, total, first = [], 0, at
                while at < len(batch) and (not texts or total < BATCH_WORDS):
                    texts.append((batch["text"].iloc[at] or "").encode("utf-8", "surrogatepass").split())  # bytes: splits at ASCII white space only
                    total += len(texts[-1])
                    at += 1
                found = batch_runs(texts, least, power)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[first:at].astype("Int64").to_numpy(), "n_words": [len(t) for t in texts],
                    "runs": [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], "text": [collapse(t, r) for t, r in zip(texts, found, strict=True)],
                })

    return run


def detect(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """The periodic runs of every text, and the text without their repetitions.

    One row per input row: doc_id, n_words, runs (by start, then period) and text, the kept
    words joined by one space.  A run has ``power`` periods and ``least`` words or more
    (``power`` of 3 and ``least`` of 24 or more, which the scales rely on).  Null, empty and blank texts
    have no words, no runs and an empty text.  Repeated rows give repeated results; other
    columns are not read.  Whole texts are searched, whatever their length.
    """
    if power < 3 or least < 3 * BLOCK:
        raise ValueError("runs need three periods and 24 words at least")
    source = docs.select(field(docs, "doc_id", "long").alias("doc_id"), field(docs, "text", "string").alias("text"))
    return source.mapInPandas(_detect(least, power), f"doc_id long, n_words long, runs {RUNS}, text string")


def best_run(runs):
    """The run with the greatest exact length / period; the first one of equals, null without runs."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda a, b: F.when(better(a, b), b).otherwise(a))
