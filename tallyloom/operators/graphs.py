"""Connected components by alternating large and small stars: few rounds, each a grouping and a join, no task holds a class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.scratch import dropped, kept


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself are linked to the least of them; a is the larger end."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """id, class: every node of edges (a, b) with the least node that it is linked to. Nodes without an edge are not in it."""
    now = kept(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _sum(now)
    while True:
        new = kept(_small(_large(now)), "edges")
        dropped(now)
        now, last, seen = new, seen, _sum(new)
        if seen == last:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("class")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("class")).distinct())
