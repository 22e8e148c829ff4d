"""Substring deduplication by sliding sentence spans.

From every sentence on, and up to every sentence, the shortest run of at least two consecutive
sentences with ``least`` words is hashed to 128 bits, so each whole sentence of a repeated
passage lies in a span as soon as the passage's whole sentences are several and have that many
words.  Hashes are grouped over all documents; the first occurrence of a hash stays, and
sentences covered by any other occurrence are removed.  A passage cut inside sentences shares
only its whole sentences.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import field, row_key, ship, stored

ship(__name__)

RUN, LEAST = 2, 25
#: A sentence ends at a full stop, question or exclamation mark before white space, or with its line.
END = re.compile(r"(?<![.!?…。！？])[.!?…。！？]++[\"'”’)\]]*+(?=\s)|\n")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence with a word; the gaps are white space."""
    found, start = [], 0
    for mark in END.finditer(text):
        end = mark.end()
        if text[start:end].strip():
            found.append((start, end))
        start = end
    if text[start:].strip():
        found.append((start, len(text)))
    return found


def runs(counts: list[int], run: int, least: int) -> list[tuple[int, int]]:
    """(first sentence, number) of the shortest runs from and up to every sentence, each once."""
    total, found = np.concatenate([[0], np.cumsum(counts)]).tolist(), set()
    n = len(counts)
    end, start = 0, 0
    for i in range(n):
        end = max(end, i + run)
        while end <= n and total[end] - total[i] < least:
            end += 1
        if end > n:
            break
        found.add((i, end - i))
    for j in range(run, n + 1):
        while start + 1 <= j - run and total[j] - total[start + 1] >= least:
            start += 1
        if total[j] - total[start] >= least:
            found.add((start, j - start))
    return sorted(found)


def spans(text: str, run: int, least: int) -> list[tuple[int, int, int, int]]:
    """(two halves of the hash, first sentence, number of sentences) of every span; white space counts as one space."""
    words = [text[a:b].split() for a, b in sentences(text)]
    plain = [" ".join(w).encode("utf-8", "surrogatepass") for w in words]
    found = []
    for first, n in runs([len(w) for w in words], run, least):
        digest = hashlib.blake2b(b"\n".join(plain[first : first + n]), digest_size=16).digest()
        found.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), first, n))
    return found


def _spans(run: int, least: int):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # bounded output batches
                part = batch.iloc[at : at + 256]
                found = [spans(t or "", run, least) for t in part["text"]]
                sizes = [len(f) for f in found]
                flat = np.array([x for f in found for x in f], dtype=np.int64).reshape(-1, 4)
                yield pd.DataFrame({
                    "hash": flat[:, 0], "hash2": flat[:, 1], "rank": np.repeat(part["rank"].to_numpy(), sizes), "row": np.repeat(part["row"].to_numpy(), sizes),
                    "first": flat[:, 2].astype(np.int32), "size": flat[:, 3].astype(np.int32),
                })

    return go


def remove(text: str, places: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(text without the covered sentences, sentences, removed); untouched texts come back as they are."""
    found = sentences(text)
    gone = np.zeros(len(found), dtype=bool)
    for first, size in places:
        gone[first : first + size] = True
    if not gone.any():
        return text, len(found), 0
    kept, before = [], 0
    for (a, b), g in zip(found, gone, strict=True):
        if not g:
            part = text[before:b]  # with the white space in front
            if kept and not kept[-1][-1].isspace() and not part[0].isspace():
                kept.append("\n")  # a removed line took its end along
            kept.append(part)
        before = b
    return "".join(kept).strip(), len(found), int(gone.sum())


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [remove(t or "", [(p["first"], p["size"]) for p in places] if places is not None else []) for t, places in zip(batch["text"], batch["places"], strict=True)]
        merged = pd.DataFrame(found, columns=["text", "n_sentences", "n_removed"])
        yield merged.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy(), spans=[[] if p is None else p for p in batch["places"]])[["doc_id", "text", "n_sentences", "n_removed", "spans"]]


def _rank(docs: DataFrame):
    return F.coalesce(field(docs, "doc_id", "long"), F.lit((1 << 63) - 1))


def repeats(docs: DataFrame, run: int = RUN, least: int = LEAST) -> DataFrame:
    """(rank, row, places) of rows with spans that occur earlier; places are (first, size) in sentences."""
    text = field(docs, "text", "string")
    source = docs.select(_rank(docs).alias("rank"), row_key(field(docs, "doc_id", "long"), text).alias("row"), text.alias("text"))
    found = source.mapInPandas(_spans(run, least), "hash long, hash2 long, rank long, row long, first int, size int")
    found = stored(found, "spans")
    place = F.struct("rank", "row", "first")
    firsts = found.groupBy("hash", "hash2").agg(F.min(place).alias("kept"), F.count("*").alias("times")).where("times > 1").select("hash", "hash2", "kept")
    firsts = stored(firsts, "firsts")  # the join then has a shuffle of its own on both sides, and Spark can split hot hashes
    later = found.join(firsts, ["hash", "hash2"]).where(place != F.col("kept")).select("rank", "row", "first", "size")
    return later.groupBy("rank", "row").agg(F.array_sort(F.collect_set(F.struct("first", "size"))).alias("places"))


def clean(docs: DataFrame, run: int = RUN, least: int = LEAST) -> DataFrame:
    """Every document without its repeated spans: doc_id, text, n_sentences, n_removed, spans.

    One row per input row.  First is the smallest (doc_id, place); null ids come last and
    are told apart by their text.  Null, empty and blank texts give an empty or unchanged
    text and no spans.  Repeated rows (same id and text) are one document: its spans are the
    first for each of them, and both rows stay.  A repeat inside one text is removed too.
    """
    key = row_key(field(docs, "doc_id", "long"), field(docs, "text", "string"))
    source = docs.select(field(docs, "doc_id", "long").alias("doc_id"), _rank(docs).alias("rank"), F.coalesce(field(docs, "text", "string"), F.lit("")).alias("text"), key.alias("row"))
    joined = source.join(repeats(docs, run, least), ["rank", "row"], "left").select("doc_id", "text", "places")
    return joined.mapInPandas(_remove, "doc_id long, text string, n_sentences long, n_removed long, spans array<struct<first: int, size: int>>")
