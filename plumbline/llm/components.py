"""Connected components of a distributed graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 40


def _minima(links: DataFrame) -> DataFrame:
    """For each u the least of u and its neighbours v."""
    return links.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node that can be reached.

    Each round hangs neighbours on lesser nodes; rounds grow with the logarithm of the longest path. Nodes with many
    neighbours are aggregated before they are shuffled. Each round is written to the shared folder.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v <> m").distinct(), "edges")
    last = None
    for _ in range(MAX_ROUNDS):
        both = current.select(F.col("v").alias("u"), F.col("m").alias("v")).union(current.select(F.col("m").alias("u"), F.col("v")))
        large = both.join(_minima(both), "u").filter("v > u").select("v", "m").distinct()
        down = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = down.join(_minima(down), "u")
        current = materialize(small.select(F.col("v"), "m").union(small.select(F.col("u").alias("v"), "m")).filter("v <> m").distinct(), "edges")
        mark = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("s")).first()
        if last == (mark["n"], mark["s"]):
            break
        last = (mark["n"], mark["s"])
    else:
        raise RuntimeError("components did not settle")
    members = current.select(F.col("v").alias("node"), F.col("m").alias("component"))
    return members.union(current.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
