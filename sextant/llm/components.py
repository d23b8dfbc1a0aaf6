"""Connected components of an edge list by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import discard, keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v), a written table, which is replaced by the result.

    Large: each node links its larger neighbours to its least neighbour. Small: each node links
    its smaller neighbours and itself to the least of them. Nodes with many edges are met by a
    join on a written table, whose skewed parts Spark can split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = both.join(least.hint("merge"), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    now = keep(out.where("u <> v").distinct(), "stars")
    discard(edges, least)
    return now


def _is_forest(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then v is the least node of its component."""
    n, nodes = edges.agg(F.count("*"), F.countDistinct("u")).first()
    return n == nodes and edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of each node of the edges (a, b) of type long: the least id reachable.

    Rounds grow with the logarithm of the number of nodes; nothing but two sums reaches the
    driver. Self loops and repeated edges do no harm; nodes without edges are not returned.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _is_forest(now):
            break
        now = _star(_star(now, True), False)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = keep(now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")
    discard(now)
    return out
