"""Connected components of a table of links by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _digest(edges: DataFrame) -> tuple:
    """Number of distinct links and two sums of their hashes: one scan, equal for equal sets."""
    of = [F.sum(F.xxhash64("u", "v", F.lit(i)).cast("decimal(38,0)")) for i in (0, 1)]
    return tuple(edges.agg(F.count(F.lit(1)), *of).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, c): the smallest node that links (a, b) reach, for each node that has a link.

    Each round joins the links with one aggregated row per node, so a node with many links is never gathered; rounds
    grow with the logarithm of the longest path. Links of a node with itself are allowed.
    """
    edges = scratch.materialize_narrow(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _digest(edges)
    while seen[0]:
        # large star: every larger neighbour of u links to the least of u and its neighbours
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        new = scratch.materialize_narrow(small.where("u != v").distinct())
        scratch.drop(edges)
        edges, before, seen = new, seen, _digest(new)
        if seen == before:
            break
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("c"))
    return scratch.materialize_narrow(out.unionByName(edges.select("v", "v").toDF("node", "c").distinct()))


def extended(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components of connected() with more links (a, b): only the links between components are gone through."""
    known = comp.select(F.col("node").alias("m"), "c")
    at = lambda df, s: df.join(known, F.col(s) == F.col("m"), "left").withColumn(s, F.coalesce("c", s)).drop("m", "c")
    new = connected(at(at(links.select("a", "b"), "a"), "b"))
    moved = comp.join(new.select(F.col("node").alias("m"), F.col("c").alias("d")), F.col("c") == F.col("m"), "left").select("node", F.coalesce("d", "c").alias("c"))
    alone = new.join(known, F.col("node") == F.col("m"), "left_anti")
    out = scratch.materialize_narrow(moved.unionByName(alone))
    scratch.drop(new)
    return out
