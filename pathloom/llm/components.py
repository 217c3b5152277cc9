"""Connected components over an edge table, by alternating star contractions.

Each round is two group-bys with partial aggregation and two joins; a hub of any degree
is therefore never gathered in one task.  Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.kernel import drop_table, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _flat(edges: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one: the edges are then the answer."""
    seen = edges.select(F.col("a").alias("node"), F.lit(1).alias("parents"), F.lit(0).alias("children")).union(edges.select("b", F.lit(0), F.lit(1)))
    return seen.groupBy("node").agg(F.sum("parents").alias("p"), F.max("children").alias("c")).where("p > 1 or p = 1 and c = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable. No edges give no rows."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _flat(now):
        now, before = materialize(_small_star(_large_star(now)), "edges"), now
        drop_table(before)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
