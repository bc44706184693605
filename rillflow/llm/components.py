"""Connected components by alternating star contractions; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators.tables import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node goes to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, go to the least of these neighbours. ``u > v`` in all edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component: the least id that links reach) of every id in ``links(u, v)``, both long.

    Each round is two aggregations and two joins of the edges, cut at a table in the shared folder; it ends when a
    round changes nothing, after about log(number of ids) rounds. Hubs only meet partial aggregates and joins that
    Spark may split, never a list of neighbours.
    """
    edges = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges, "edges")
    before = None
    while True:
        edges = cut(_small_star(_large_star(edges)), "edges")
        # The same set of edges as before: equal counts and equal sums of their hashes.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionAll(leaves.select(F.col("component").alias("id"), "component").distinct())
