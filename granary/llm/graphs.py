"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_facts, materialize


def _with_least(edges: DataFrame, total: int, own: bool) -> DataFrame:
    """Every edge with m, the least neighbour of its end a (or a itself if ``own``); the edges of a hub meet in pieces."""
    least = F.least(F.min("b"), F.first("a")) if own else F.min("b")
    return join_facts(edges, edges.groupBy("a").agg(least.alias("m"), F.count(F.lit(1)).alias("_n")), ["a"], "_n", total, by=["b"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long): root is the component's least node.

    Large-star and small-star rounds until nothing changes: each round sends every edge to its ends' least neighbour,
    rows stay linear in the edges, and rounds grow with the logarithm of the graph. The edges of a node with very many
    are dealt over several tasks. Loops and repeated edges are harmless; an empty table gives an empty result.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.union(edges.select("b", "a"))
        large = _with_least(both, 2 * state[0], own=True).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # at most one edge for each of `edges`, so the bound on hubs holds with their number
        small = _with_least(large, state[0], own=False)
        ends = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = materialize(small.select(F.explode(ends).alias("e")).select("e.a", "e.b").filter("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
