"""Connected components of a graph held in a table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's larger (or smaller) neighbours are tied to the least node around it."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        return join_hot(around, least, ["u"], ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    tied = join_hot(edges, least, ["u"], ["v"])
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) of every node of ``edges`` (a long, b long).

    Least nodes are found map-side first and joined back; a node with very many links is dealt over several tasks;
    each round is written to the shared folder. Rounds grow with the logarithm of the nodes. Self-links
    and repeated links don't matter; a null end drops the link; no links give no rows.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), "a", "b").where("a <> b").select("u", "v").distinct()
    now, mark = cut(now), None
    while True:
        now = cut(_stars(cut(_stars(now, True)), False))
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (seen.n, seen.s) == mark or not seen.n:
            break
        mark = seen.n, seen.s
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
