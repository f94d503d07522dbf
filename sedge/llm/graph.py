"""Connected components over an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step.  The minimum of each node is a pre-aggregated groupBy; the join back is an
    ordinary equi-join of the edges with a table unique in its key, which AQE can split where one node is hot."""
    if large:
        e = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = e.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        out = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges(a, b long).

    Alternating large-star and small-star contraction: each round at least halves the depth in practice, the edge count
    never grows beyond the input's, and every round ends in a table in the shared folder.  Self links and null ends are
    dropped; nodes without links do not appear.
    """
    now = scratch.save(edges.where("a is not null and b is not null and a != b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "edges")
    was = None
    for _ in range(most_rounds):
        new = scratch.save(_star(_star(now, True), False), "edges")
        scratch.drop(now)
        now = new
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(mark) == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
        was = tuple(mark)
    raise RuntimeError("components did not settle")
