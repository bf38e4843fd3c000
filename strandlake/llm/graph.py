"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v). Large: links each larger neighbour of u to u's least; small: each smaller one and u itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (child, parent) are stars: each child has one parent, and no parent is a child."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("child")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("child")))
    roles = ends.groupBy("id").agg(F.sum("child").alias("as_child"), F.count("*").alias("all"))
    return roles.where("as_child > 1 OR (as_child = 1 AND all > 1)").isEmpty()


def components(edges: DataFrame, labels: DataFrame | None = None, most_rounds: int = 60) -> DataFrame:
    """(u, v) edges of longs to (id, root): root is the least id reachable. Ids without edges don't appear.

    labels: the result for earlier edges, to which these come; then only edges between its components count.
    Every round replaces edges by as many or fewer that reach further down; the number of rounds grows with
    the logarithm of the largest component. State is cut to the shared folder each round."""
    now = edges.select("u", "v")
    if labels is not None:
        for c in ("u", "v"):
            now = now.join(labels.select(F.col("id").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    now = cut(now.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        if _settled(now):
            break
        now = cut(_star(_star(now, large=True), large=False))
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    found = found.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    if labels is None:
        return found
    moved = labels.join(found.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left")
    kept = moved.select("id", F.coalesce("to", "root").alias("root"))
    return kept.unionByName(found.join(labels.select("id"), "id", "left_anti"))
