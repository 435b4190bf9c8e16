"""Connected components of any size as joins and aggregations.

Alternates two steps until nothing changes: every node hands its larger
neighbours to its smallest neighbour, then its smaller ones. Each pass is one
aggregation and one join per step, written to the shared folder; no component
is ever gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import materialize


def _step(edges: DataFrame) -> DataFrame:
    """edges (u, v): v stands beside u. Links every v to the smallest of u and its v's."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return least.join(edges, "u").select(F.col("v").alias("b"), F.col("m").alias("a"), "u")


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, root): root is the smallest node of the component.

    Every node of the links appears once. No links give no rows; a link from a
    node to itself is taken as none; nulls are left out.
    """
    edges = materialize(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = _step(both).where("b > u").select("a", "b").where("a < b")
        down = large.distinct().select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = least.join(down, "u")
        small = joined.where("v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(
            least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = materialize(small.distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return leaves.union(edges.select(F.col("a"), F.col("a")).distinct())
