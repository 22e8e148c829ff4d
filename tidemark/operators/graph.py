"""Lineage graphs as node and edge tables, walked by frontier joins.

Each round joins only the new frontier with the edges and checkpoints it, so the
plan does not grow and an executor loss does not replay earlier rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut

UP, DOWN = "upstream_node_id", "downstream_node_id"


def cyclic_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on or behind a cycle: what is left after removing nodes without inputs."""
    left_edges = cut(edges.select(UP, DOWN).distinct())
    known = nodes.select("node_id").unionByName(edges.select(F.col(UP).alias("node_id"))).unionByName(edges.select(F.col(DOWN).alias("node_id")))
    left_nodes = cut(known.distinct())
    remaining = left_nodes.count()
    while remaining:
        fed = left_edges.select(F.col(DOWN).alias("node_id")).distinct()
        kept = cut(left_nodes.join(fed, "node_id", "left_semi"))
        now = kept.count()
        if now == remaining:
            break
        left_edges = cut(left_edges.join(kept.select(F.col("node_id").alias(UP)), UP, "left_semi"))
        left_nodes, remaining = kept, now
    return left_nodes


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every node reachable from the seed nodes, with its distance."""
    links = edges.select(UP, DOWN).distinct()
    seen = cut(seeds.select("node_id").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while True:
        depth += 1
        step = frontier.join(links, frontier.node_id == links[UP]).select(F.col(DOWN).alias("node_id")).distinct()
        frontier = cut(step.join(seen, "node_id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def unreachable(nodes: DataFrame, edges: DataFrame, *, source: str = "source", target: str = "metric") -> DataFrame:
    """Target nodes that no source node leads to."""
    found = reachable(edges, nodes.where(F.col("node_type") == source))
    return nodes.where(F.col("node_type") == target).join(found, "node_id", "left_anti")


def unknown_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges naming a node that does not exist."""
    ends = edges.select(UP, DOWN, F.explode(F.array_distinct(F.array(UP, DOWN))).alias("node_id"))
    return ends.join(nodes.select("node_id"), "node_id", "left_anti").select(UP, DOWN).distinct()


def graph_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Orphan nodes, repeated edges, self edges and unknown endpoints as ``code, subject``."""
    touched = edges.select(F.explode(F.array(UP, DOWN)).alias("node_id")).distinct()
    name = F.concat_ws("->", UP, DOWN)
    parts = [
        nodes.join(touched, "node_id", "left_anti").select(F.lit("lineage.orphan").alias("code"), F.col("node_id").alias("subject")),
        edges.groupBy(UP, DOWN).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("lineage.duplicate_edge").alias("code"), name.alias("subject")),
        edges.where(F.col(UP) == F.col(DOWN)).select(F.lit("lineage.self_edge").alias("code"), name.alias("subject")),
        unknown_endpoints(nodes, edges).select(F.lit("lineage.unknown_endpoint").alias("code"), name.alias("subject")),
    ]
    return reduce(DataFrame.unionByName, parts)


def trace(nodes: DataFrame, edges: DataFrame, node_id: str, direction: str = "both", depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges within ``depth`` steps up, down or both ways of one node."""
    if direction not in ("up", "down", "both") or not 1 <= depth <= 8:
        raise ValueError("direction is up, down or both; depth is 1 to 8")
    if nodes.where(F.col("node_id") == node_id).isEmpty():
        raise ValueError(f"unknown lineage node: {node_id}")
    ways = []
    if direction in ("down", "both"):
        ways.append(edges.select("edge_id", F.col(UP).alias("at"), F.col(DOWN).alias("to")))
    if direction in ("up", "both"):
        ways.append(edges.select("edge_id", F.col(DOWN).alias("at"), F.col(UP).alias("to")))
    links = reduce(DataFrame.unionByName, ways)
    seen = nodes.where(F.col("node_id") == node_id).select("node_id").distinct()
    frontier, used = seen, None
    for _ in range(depth):
        step = cut(frontier.join(links, frontier.node_id == links["at"]).select("edge_id", "to"))
        used = step.select("edge_id") if used is None else used.unionByName(step.select("edge_id"))
        frontier = cut(step.select(F.col("to").alias("node_id")).distinct().join(seen, "node_id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return nodes.join(seen.distinct(), "node_id", "left_semi"), edges.join(used.distinct(), "edge_id", "left_semi")
