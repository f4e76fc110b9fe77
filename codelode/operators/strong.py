"""Strongly connected components by forward and backward reachability with trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import cut_lineage


def _trim(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges whose start has an edge into it and whose end has one out of it; no other edge lies on a cycle."""
    entered = edges.select(*by, F.col("dst").alias("src")).distinct()
    left = edges.select(*by, F.col("src").alias("dst")).distinct()
    return edges.join(entered, [*by, "src"], "left_semi").join(left, [*by, "dst"], "left_semi")


def _reached(edges: DataFrame, by: list[str], turn: int) -> DataFrame:
    """``node, ahead, behind``: the highest-placed node that reaches each, and the highest-placed one it reaches, itself included.

    Places are drawn anew each turn, by hash.  Only nodes that changed send on.
    """
    key = [*by, "node"]
    nodes = edges.select(*by, F.col("src").alias("node")).unionByName(edges.select(*by, F.col("dst").alias("node"))).distinct()
    own = F.struct(F.xxhash64("node", F.lit(turn)).alias("place"), F.col("node").alias("of"))
    state = cut_lineage(nodes.select(*key, own.alias("ahead"), own.alias("behind"), F.lit(True).alias("news")))
    way = lambda node, to, down: edges.select(*by, F.col(node).alias("node"), F.col(to).alias("to"), F.lit(down).alias("down"))
    both = cut_lineage(way("src", "dst", True).unionByName(way("dst", "src", False)))
    while True:
        sent = state.where("news").join(both, key).groupBy(*by, F.col("to").alias("node")).agg(
            F.max(F.when(F.col("down"), F.col("ahead"))).alias("new_ahead"), F.max(F.when(~F.col("down"), F.col("behind"))).alias("new_behind")
        )
        better = lambda c: F.coalesce(F.col(f"new_{c}") > F.col(c), F.lit(False))
        best = lambda c: F.when(better(c), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        state = cut_lineage(state.join(sent, key, "left").select(*key, best("ahead"), best("behind"), (better("ahead") | better("behind")).alias("news")))
        if state.where("news").isEmpty():
            return state.select(*key, "ahead", "behind")


def strong_components(edges: DataFrame, by: list[str]) -> DataFrame:
    """``*by, node, component`` of nodes on cycles of ``edges (*by, src, dst)``; the component is named by one of its nodes.

    Each group of ``by`` is a graph of its own; all are searched at once.  A node that reaches itself over other nodes shares its
    component with exactly those on such ways; nodes on no cycle, and loops from a node to itself, are left out.
    Each turn finds for every node the highest-placed one before and behind it.  Where these are the same, that one reaches the
    node and is reached by it: its component.  Edges between nodes that differ in either lie on no cycle, so what is left
    falls apart; as places are drawn by hash, into halves on average, and turns grow with the logarithm of the longest row of components.
    """
    active = cut_lineage(_trim(edges.where("src <> dst").select(*by, "src", "dst").distinct(), by))
    done: list[DataFrame] = []
    while not active.isEmpty():
        state = _reached(active, by, len(done))
        done.append(state.where("ahead = behind").select(*by, "node", F.col("ahead.of").alias("component")))
        end = lambda name: state.select(*by, F.col("node").alias(name), F.struct("ahead", "behind").alias(f"{name}_state"))
        inside = active.join(end("src"), [*by, "src"]).join(end("dst"), [*by, "dst"])
        inside = inside.where("src_state = dst_state and src_state.ahead <> src_state.behind").select(*by, "src", "dst")
        active = cut_lineage(_trim(inside, by))
    if not done:
        return edges.limit(0).select(*by, F.col("src").alias("node"), F.col("src").alias("component"))
    labels = done[0]
    for more in done[1:]:
        labels = labels.unionByName(more)
    shared = labels.groupBy(*by, "component").count().where("count > 1").select(*by, "component")
    return labels.join(shared, [*by, "component"], "left_semi").select(*by, "node", "component")
