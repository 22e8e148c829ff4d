"""A trie of conversation prefixes and what its nodes save.

A node is a distinct sequence of first turns.  Its key is its depth and the sum of 128-bit
digests of its turns, each salted with its place, so keys follow from running sums and no
conversation is gathered.  Nodes are named by their smallest member and their depth.  Leaf
counts and saved bytes are rolled up by :mod:`forest`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import running
from tidemark.llm import forest
from tidemark.llm.common import field, ship, stored

ship(__name__)

#: Ends of one node are joined in runs of this many conversation ids.
ID_RANGE = 65_536
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, bytes): numbered turns with a 128-bit digest of role and text.

    Order is by turn (null first), equal turns by role, then text.  Null role or text is empty;
    rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce(field(conversations, "role", "string"), F.lit("")), F.coalesce(field(conversations, "text", "string"), F.lit(""))
    turn = field(conversations, "turn", "long")
    rows = conversations.select(
        field(conversations, "conv_id", "long").alias("conv_id"), F.coalesce(turn, F.lit(-(1 << 63))).alias("at"), turn.isNotNull().alias("known"),
        role.alias("role"), text.alias("text"), F.lit(1).cast("long").alias("one"),
    ).where("conv_id IS NOT NULL")
    numbered = running(rows, ["conv_id"], "at", {"place": ("sum", "one")}, tie_breakers=["known", "role", "text"])
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    half = lambda i: F.conv(F.substring(digest, i, 15), 16, 10).cast("long")
    return numbered.select("conv_id", "place", half(1).alias("a"), half(16).alias("b"), F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(numbered: DataFrame, head_of, base_of) -> tuple[DataFrame, DataFrame]:
    """(turns of rebuilt conversations, (conv_id, turns of it)); both start from original turns.

    ``head_of`` and ``base_of`` map the column conv_id to the number of turns taken over and to the
    conversation they come from.  A conversation then continues with its own turns after
    as many of its first ones.  Heads are expected to be short: their turns are copied per conversation.
    """
    own = numbered.groupBy("conv_id").agg(F.count("*").alias("own"))
    base = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    plan = own.select("conv_id", "own", head_of(F.col("conv_id")).alias("head"), base_of(F.col("conv_id")).alias("base")).join(base.hint("merge"), "base", "left")
    plan = stored(plan.withColumn("taken", F.least("head", F.coalesce("base_turns", F.lit(0)))), "trie-plan")
    most = plan.agg(F.max("head")).first()[0] or 0
    heads = numbered.where(F.col("place") <= most).withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "head").hint("merge"), "base").where("place <= head")
    tails = numbered.join(plan.select("conv_id", "head", "taken").hint("merge"), "conv_id").where("place > head")
    rows = heads.select("conv_id", F.col("place").alias("depth"), "a", "b", "bytes").unionByName(
        tails.select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "a", "b", "bytes")
    )
    return rows, plan.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("turns"))


def prefixes(rows: DataFrame) -> DataFrame:
    """Every first-d-turns prefix of every conversation: conv_id, key, key of the prefix one turn shorter, bytes."""
    lane = lambda seed: F.xxhash64(F.lit(seed), "depth", "a", "b").cast("decimal(38,0)")
    salted = rows.select("conv_id", "depth", "bytes", lane(1).alias("x"), lane(2).alias("y"))
    summed = running(salted, ["conv_id"], "depth", {"sx": ("sum", "x"), "sy": ("sum", "y")})
    key = lambda d, x, y: F.concat_ws(":", d.cast("string"), x.cast("decimal(38,0)").cast("string"), y.cast("decimal(38,0)").cast("string"))
    before = F.when(F.col("depth") > 1, key(F.col("depth") - 1, F.col("sx") - F.col("x"), F.col("sy") - F.col("y"))).otherwise(F.lit("0"))
    return summed.select("conv_id", "depth", "bytes", key(F.col("depth"), F.col("sx"), F.col("sy")).alias("key"), before.alias("before"))


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One hash per key over its strings in order; a key may span batches, and only its hash is kept."""
    key, state = None, None
    for batch in batches:
        for k, ids in zip(batch["key"], batch["ids"], strict=True):
            if k != key:
                if key is not None:
                    yield pd.DataFrame({"key": [key], "ends_sha256": [state.hexdigest()]})
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if key is not None:
        yield pd.DataFrame({"key": [key], "ends_sha256": [state.hexdigest()]})


def ends(last: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end, from (key, conv_id) rows."""
    parts = last.groupBy("key", F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    parts = stored(parts, "trie-ends")
    several = parts.groupBy("key").agg(F.count("*").alias("n"), F.max("ids").alias("ids"))
    single = several.where("n = 1").select("key", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    many = parts.join(several.where("n > 1").select("key").hint("merge"), "key", "left_semi").repartition("key").sortWithinPartitions("key", "range")
    return single.unionByName(many.mapInPandas(_hash, "key string, ends_sha256 string"))


def trie(conversations: DataFrame, head_of=None, base_of=None) -> DataFrame:
    """All nodes of the trie of (rebuilt) conversations.

    Columns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256; see :func:`rebuilt` for the two functions, without which conversations stay
    as they are.  The root has depth 0 and every conversation as a member.  Rows without a conv_id are
    left out, null texts and roles are empty, repeated rows are turns of their own, and a table without
    conversations gives no nodes.
    """
    numbered = stored(turns(conversations), "trie-turns")
    rows, lengths = rebuilt(numbered, head_of or (lambda c: F.lit(0)), base_of or (lambda c: c))
    found = stored(prefixes(rows), "trie-prefixes")
    deep = found.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.min("before").alias("before"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit("0").alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("string").alias("before"))
    deep = stored(deep.select(root.columns).unionByName(root), "trie-nodes")
    children = deep.groupBy(F.col("before").alias("key")).agg(F.count("*").alias("n_children"))
    parents = deep.select(F.col("key").alias("before"), F.col("conv_id").alias("parent_conv_id"))
    nodes = deep.join(parents.hint("merge"), "before", "left").join(children.hint("merge"), "key", "left")
    nodes = stored(nodes.select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    ), "trie-named")
    name = lambda conv, depth: F.struct(conv.alias("conv_id"), depth.alias("depth"))
    edges = nodes.select(
        name(F.col("conv_id"), F.col("depth")).alias("id"), F.when(F.col("depth") > 0, name(F.col("parent_conv_id"), F.col("depth") - 1)).alias("parent"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"), F.col("saved").alias("saved_tokens"),
    )
    sums = forest.rollup(edges, ["n_leaves", "saved_tokens"]).select("id.conv_id", "id.depth", "n_leaves", "saved_tokens")
    at_end = found.join(lengths.hint("merge"), "conv_id").where("depth = turns").select("key", "conv_id")
    last = ends(at_end.unionByName(lengths.where("turns = 0").select(F.lit("0").alias("key"), "conv_id")))
    return nodes.join(sums.hint("merge"), ["conv_id", "depth"]).join(last.hint("merge"), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )
