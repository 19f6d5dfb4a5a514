"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum, which is written, and an equi-join with it, so a node with any number of
neighbours is a partially aggregated row and a join key that adaptive execution splits. Nothing is gathered on the
driver but one count and one checksum a round.

Edge cases: edges with a null end and edges of a node with itself are left out, so a node that has no other edge is
in no result; edges that repeat, in either direction, count once; the smallest id of a component names it, whatever
the order of edges; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import drop_materialized, materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). Returns id, component (the smallest id reachable) for every node."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.join(low, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        drop_materialized(low)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        hop = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(hop.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = _mark(new)
        drop_materialized(low)
        drop_materialized(large)
        drop_materialized(edges)
        edges = new
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
