"""Connected components by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _pull(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """edges (a, b) with the least b of each a, as m, and the table of these: one of its own, so that hot nodes can be split."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), f"{name}-min")
    return edges.join(least, "a"), least


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node that links reach) of every node with a link to another.

    Each turn is joins and aggregates over links, linear in their number; a logarithmic number of turns do.
    Links with a null end or to the node itself don't count. No links: no rows.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    now, before = written(now, "links"), None
    while True:
        print_now = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not print_now["n"] or (print_now["n"], print_now["s"]) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = (print_now["n"], print_now["s"])
        # Large star: each node's larger neighbours go to its least neighbour or itself.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, least = _pull(both, "large")
        large = large.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        large = written(large, "links")
        drop_written(least)
        # Small star: each node's smaller neighbours, and itself, go to the least of them.
        small, least = _pull(large, "small")
        small = small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        old, now = now, written(small, "links")
        for done in (old, large, least):
            drop_written(done)
