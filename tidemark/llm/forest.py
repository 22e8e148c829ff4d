"""Subtree sums over a forest of parent edges by centroid decomposition.

Every node first gets its place in pre-order and the size of its subtree, both by doubling
ancestor pointers: the number of rounds is the logarithm of the depth.  A component then has
a centroid, the deepest node whose part of the component is at least half of it.  Its
ancestors in the component are just the nodes of that size, so one comparison finds the path
from the centroid to the top.  The total below the centroid is added along this path; the
centroid goes, and the component falls into the trees below it and the rest above.  Components
of more than ``bound`` nodes are split this way by Spark, all of a level at once; the smaller ones are finished in
tasks that hold whole components.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, ship

ship(__name__)

BOUND, RANGE, FEW = 20_000, 65_536, 10_000


def _doubled(state: DataFrame, value: str, down: bool, rounds: int | None = None) -> tuple[DataFrame, int]:
    """Sums of ``value`` over all ancestors (``down``) or over all descendants, the node itself included, and the number of rounds.

    ``rounds``, where known from the same forest, saves asking after each round whether a node is left.

    ``far`` is the ancestor 1, 2, 4, ... edges up.  A node with very many children is a hot key
    of the join; both its sides are shuffled from written rows, so Spark splits that key at run time.
    The merge hints keep tables that grow with the input from being broadcast through the driver.
    """
    done = 0
    while done < rounds if rounds is not None else not state.where("far IS NOT NULL").isEmpty():
        above = state.select(F.col("id").alias("above"), F.col("far").alias("next"), F.col(value).alias("high"))
        linked = state.where("far IS NOT NULL")
        stepped = linked.join(above.hint("merge"), F.col("far") == F.col("above"))
        if down:
            stepped = stepped.withColumn(value, F.col(value) + F.col("high"))
        # Nodes that have reached the top stay as they are.
        stepped = stepped.withColumn("far", F.col("next")).select(*state.columns).unionByName(state.where("far IS NULL"))
        if not down:
            more = linked.groupBy(F.col("far").alias("above")).agg(F.sum(value).alias("more"))
            stepped = stepped.join(more.hint("merge"), F.col("id") == F.col("above"), "left").withColumn(value, F.col(value) + F.coalesce("more", F.lit(0)))
        state, done = cut(stepped.select(*state.columns)), done + 1
    return state.drop("far"), done


def placed(nodes: DataFrame, bound: int = BOUND) -> DataFrame:
    """Every node with ``pre`` (place in pre-order from 1), ``up`` (that of its parent, 0 at the top) and ``full`` (subtree size)."""
    sizes, rounds = _doubled(nodes.select("id", F.col("parent").alias("far"), "parent", F.lit(1).cast("long").alias("full")), "full", False)
    widest = sizes.groupBy("parent").count().agg(F.max("count")).first()[0] or 0
    # Children of one node are summed in buckets of about ``bound``.
    dealt = sizes.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(-(-widest // bound) or 1)))
    inside = F.sum("full").over(W.partitionBy("parent", "bucket").orderBy("id").rowsBetween(W.unboundedPreceding, -1))
    buckets = dealt.groupBy("parent", "bucket").agg(F.sum("full").alias("width"))
    before = F.sum("width").over(W.partitionBy("parent").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    buckets = buckets.select(F.col("parent").alias("p"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("before"))
    dealt = dealt.withColumn("inside", F.coalesce(inside, F.lit(0)))
    offsets = dealt.join(buckets.hint("merge"), F.col("parent").eqNullSafe(F.col("p")) & (F.col("bucket") == F.col("b")))
    offsets = cut(offsets.select("id", F.col("parent").alias("far"), "full", (1 + F.col("inside") + F.col("before")).alias("own"), (1 + F.col("inside") + F.col("before")).alias("pre")))
    return _doubled(offsets, "pre", True, rounds)[0].select("id", "pre", (F.col("pre") - F.col("own")).alias("up"), "full")


def _split(active: DataFrame, values: Sequence[str], few: bool) -> DataFrame:
    """One level: every component loses its centroid, whose total goes to the path above it; ``few`` bounds the components for a broadcast."""
    part = lambda name: F.struct(F.col("pre"), F.col("full"), F.col("size")).getField(name)
    path = 2 * F.col("size") >= F.col("m")
    centre = active.where(path).groupBy("comp").agg(F.max(F.struct(part("pre").alias("pre"), part("full").alias("full"), part("size").alias("size"))).alias("c"))
    # One row per component of over ``bound`` nodes.
    small = F.broadcast if few else (lambda x: x)
    joined = active.join(small(centre), "comp")
    below = (F.col("pre") >= F.col("c.pre")) & (F.col("pre") < F.col("c.pre") + F.col("c.full"))
    totals = cut(joined.where(below).groupBy("comp", "c").agg(*[F.sum(v).alias(f"below_{v}") for v in values]))
    joined = active.join(small(totals), "comp")
    for v in values:
        joined = joined.withColumn(f"t_{v}", F.col(f"t_{v}") + F.when(path, F.col(f"below_{v}")).otherwise(0))
    # The tree below the centroid that holds a node starts at the last child before it in pre-order.
    child = F.when(F.col("up") == F.col("c.pre"), F.struct(F.col("pre").alias("pre"), F.col("size").alias("size")))
    joined = joined.withColumn("child", child).withColumn("range", F.floor(F.col("pre") / RANGE))
    ranges = joined.groupBy("comp", "range").agg(F.max("child").alias("last"))
    earlier = F.max("last").over(W.partitionBy("comp").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select("comp", "range", earlier.alias("earlier"))
    here = F.last("child", ignorenulls=True).over(W.partitionBy("comp", "range").orderBy("pre").rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = joined.withColumn("here", here).join(ranges.hint("merge"), ["comp", "range"]).withColumn("tree", F.coalesce("here", "earlier"))
    inner = below & (F.col("pre") != F.col("c.pre"))
    return cut(joined.select(
        "pre", "up", "full", *values, *[f"t_{v}" for v in values],
        F.when(F.col("pre") == F.col("c.pre"), 0).when(path, F.col("size") - F.col("c.size")).otherwise(F.col("size")).alias("size"),
        F.when(inner, F.col("tree.pre")).otherwise(F.col("comp")).alias("comp"), F.when(inner, F.col("tree.size")).otherwise(F.col("m") - F.col("c.size")).alias("m"),
    ))


def decompose(comp: np.ndarray, pre: np.ndarray, up: np.ndarray, full: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """What the levels left add to every node, for whole components sorted by (component, pre-order)."""
    added, rows, label = np.zeros_like(values), np.arange(len(pre)), np.unique(comp, return_inverse=True)[1]
    size = size.copy()
    while len(rows):
        count = np.bincount(label)
        path = np.flatnonzero(2 * size[rows] >= count[label])
        last = path[np.append(label[path][1:] != label[path][:-1], True)]  # deepest of each path
        centre = rows[last][label]  # every component has one, in order
        below = (pre[rows] >= pre[centre]) & (pre[rows] < pre[centre] + full[centre])
        starts = np.searchsorted(label, np.arange(len(count)))
        totals = np.add.reduceat(np.where(below, values[:, rows], 0), starts, axis=1)
        added[:, rows[path]] += totals[:, label[path]]
        size[rows[path]] -= size[rows[last]][label[path]]
        inner = below & (rows != centre)
        tree = np.where(inner, np.cumsum(inner & (up[rows] == pre[centre])), 0)
        keep = rows != centre
        rows, label, tree = rows[keep], label[keep], tree[keep]
        order = np.lexsort((tree, label))
        rows, label, tree = rows[order], label[order], tree[order]
        if len(rows):
            label = np.concatenate([[0], np.cumsum((label[1:] != label[:-1]) | (tree[1:] != tree[:-1]))])
    return added


def _finish(values: Sequence[str]):
    names = ["comp", "pre", "up", "full", "size"]

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        columns = [part[n].to_numpy(np.int64) for n in names]
        added = decompose(*columns, part[list(values)].to_numpy(np.int64).T.copy())
        return pd.DataFrame({"pre": part["pre"], **{v: part[f"t_{v}"] + a for v, a in zip(values, added, strict=True)}})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            kept = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            whole = int(np.searchsorted(kept["comp"].to_numpy(), kept["comp"].iloc[-1])) if len(kept) else 0
            if whole >= BOUND:
                yield solve(kept.iloc[:whole])
                kept = kept.iloc[whole:]
        if kept is not None and len(kept):
            yield solve(kept)

    return run


def rollup(nodes: DataFrame, values: Sequence[str], bound: int = BOUND) -> DataFrame:
    """(id, one sum per value): the sums over the subtree of every node, itself included.

    ``nodes`` has ``id`` (unique, of any orderable type), ``parent`` (null at the top of a tree)
    and whole-number columns ``values``.  An empty forest gives no rows.  Depth and
    number of children have no limit.  ``bound`` is the size up to which a component is finished in one task.
    """
    nodes = cut(nodes.select("id", "parent", *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in values]))
    total = nodes.count()
    order = cut(placed(nodes, bound))
    rows = nodes.join(order.hint("merge"), "id").select("pre", "up", "full", F.col("full").alias("size"), *values)
    top = nodes.sparkSession.range(1).select(F.lit(0).cast("long").alias("pre"), F.lit(-1).cast("long").alias("up"), *[F.lit(total + 1).cast("long").alias(c) for c in ("full", "size")], *[F.lit(0).cast("long").alias(v) for v in values])
    # One component: a node above all trees makes the forest a tree.
    active = rows.unionByName(top).select("*", *[F.lit(0).cast("long").alias(f"t_{v}") for v in values], F.lit(0).cast("long").alias("comp"), F.lit(total + 1).cast("long").alias("m"))
    ready, largest = [], total + 1
    while largest > bound:
        level = _split(active, values, (total + 1) // bound <= FEW)
        ready.append(level.where(f"size = 0 OR m <= {bound}"))
        active = level.where(f"size > 0 AND m > {bound}")
        largest = active.agg(F.max("m")).first()[0] or 0
    pending = active if not ready else None
    for part in ready:
        pending = part if pending is None else pending.unionByName(part)
    done = pending.where("size = 0").select("pre", *[F.col(f"t_{v}").alias(v) for v in values])
    left = pending.where("size > 0").repartition("comp").sortWithinPartitions("comp", "pre")
    finished = left.mapInPandas(_finish(values), "pre long, " + ", ".join(f"{v} long" for v in values))
    return order.select("id", "pre").join(done.unionByName(finished).hint("merge"), "pre").drop("pre")
