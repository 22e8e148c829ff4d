"""Exact deduplication with a heavy-hitter split.

Every text becomes one digest.  A Misra-Gries summary per partition, merged by
adding counters, finds the digests that may hold more than ``rows / (k + 1)`` of
all rows; there are at most ``k`` of them.  Their exact winners are computed with
map-side partial aggregation, verified against a second digest, and broadcast, so
rows of the largest groups are decided without a shuffle.  All other digests go
through an ordinary shuffle, where no group can be large.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, cut, field, ship

ship(__name__)

COUNTERS = 1000


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row per document: id, SHA-256 of the normalised text, and a second digest."""
    text = ascii_lower(field(docs, "text", "string"))
    plain = docs.select(field(docs, "doc_id", "long").alias("doc_id"), text.alias("text"))
    return plain.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size")).alias("second"))


def _summarise(counters: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, rows = pd.Series(dtype="int64"), 0
        for batch in batches:
            rows += len(batch)
            kept = kept.add(batch["digest"].value_counts(), fill_value=0)
            if len(kept) > counters:
                kept = kept.sort_values(ascending=False)
                kept = kept.iloc[:counters] - kept.iloc[counters]
                kept = kept[kept > 0]
        yield pd.DataFrame({"digest": [None, *kept.index], "seen": [rows, *kept.astype("int64")]})

    return run


def frequent(found: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that may hold more than rows / (counters + 1) rows; at most ``counters`` of them.

    A counter never exceeds the true count, and loses at most n / (counters + 1) in a
    partition of n rows, so the bound holds for the sums too.  Empty for an empty table.
    """
    partial = cut(found.select("digest").mapInPandas(_summarise(counters), "digest binary, seen long"))
    rows = partial.where("digest is null").agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("n")).first()["n"]
    # A sum may fall short of the count by rows / (counters + 1), so only digests of over twice that are sure to pass.
    return partial.where("digest is not null").groupBy("digest").agg(F.sum("seen").alias("seen")).where((F.col("seen") * (counters + 1) > rows) & (F.col("seen") > 1)).select("digest")


def winners(found: DataFrame, heavy: DataFrame) -> DataFrame:
    """Exact keeper and size of each frequent digest whose rows agree in the second digest."""
    rows = found.join(F.broadcast(heavy), "digest", "left_semi")
    summed = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.min("second").alias("low"), F.max("second").alias("high"))
    return summed.where("low = high").select("digest", "keep_id", "group_size")


def decide(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Which rows stay: one row per input row.

    Columns: doc_id, keep_id, group_size, kept, text_sha256.  Null text counts as
    empty, so null and empty texts are one group.  Among equal texts the largest
    doc_id stays; a null doc_id loses to any other, and in a group with null ids only
    keep_id is null and every row is kept.  Repeated rows (same id and text) count
    in group_size and share their decision; :func:`deduplicate` returns one of them.
    """
    found = cut(digests(docs))
    best = cut(winners(found, frequent(found, counters)))
    known = F.broadcast(best)  # at most ``counters`` rows
    heavy = found.join(known, "digest").select("doc_id", "digest", "keep_id", "group_size")
    light = found.join(known, "digest", "left_anti").select("doc_id", "digest")
    groups = light.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    rest = light.join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size")
    return heavy.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns; one row of each group of equal texts."""
    kept = decide(docs, counters).where("kept").select(F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_digest"), F.col("group_size").alias("_keep_size")).distinct()
    digest = F.sha2(ascii_lower(field(docs, "text", "string")), 256)
    rows = docs.withColumn("_digest", digest).join(kept, F.col("_digest").eqNullSafe(F.col("_keep_digest")) & field(docs, "doc_id", "long").eqNullSafe(F.col("_keep_id")))
    alone = rows.where("_keep_size = 1")
    several = rows.where("_keep_size > 1").dropDuplicates(["_digest"])
    return alone.unionByName(several).select(*[F.col(f"`{c}`") for c in docs.columns])
