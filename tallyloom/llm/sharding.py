"""Weighted rendezvous sharding, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

PER_SLOT_GROUP = 100_000  # rows of a shard that one window numbers


def rendezvous(key: str, weights: list[float]) -> Column:
    """Number of the shard with the least -ln(u) / weight, u being a hash of key and shard in (0, 1); ties to the first.

    A new shard takes keys only into itself; changing one weight moves keys only from or to that shard. A null key is a
    key like any other. Weights must be above zero.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above zero")
    unit = lambda s: (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(s)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    offers = [F.struct((-F.log(unit(s)) / F.lit(float(w))).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return (F.least(*offers) if len(offers) > 1 else offers[0])["shard"]


def shard(docs: DataFrame, shards: int = 24, weights: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to docs[key, text].

    slot numbers a shard's rows from 0 without gaps. A shard is numbered in groups by a hash of the whole row and its
    place in the input, each in its own window, and groups follow each other by their counts: no window holds a whole
    shard, or all rows of one key. grown_shard is the shard with one more of weight 1. Null or empty text: size 8, crc32
    0. Rows with a null key share a shard; repeated rows get slots of their own.
    """
    weights = weights or [1.0] * shards
    text_col = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.col(key).alias("doc_id"), text_col.alias("text"))
    row = F.pmod(F.monotonically_increasing_id(), F.lit(64))
    placed = keyed.select(
        "doc_id",
        (F.octet_length("text") + 8).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous("doc_id", weights).alias("shard"),
        rendezvous("doc_id", [*weights, 1.0]).alias("grown_shard"),
        F.xxhash64("doc_id", F.crc32("text"), row).alias("mixed"),
    )
    placed = written(placed, "placed")  # texts are read once, and both uses below see the same rows
    # a key may hold many of all rows, so groups follow the rows of the fullest shard
    fullest = placed.groupBy("shard").count().agg(F.max("count").alias("n")).first()["n"] or 0
    groups = max(16, fullest // PER_SLOT_GROUP)
    placed = placed.withColumn("part", F.pmod("mixed", F.lit(groups)).cast("int")).drop("mixed")
    counts = placed.groupBy("shard", "part").count()
    before = counts.select("shard", "part", F.expr("sum(count) over (partition by shard order by part) - count").alias("before"))
    numbered = placed.withColumn("at", F.expr("row_number() over (partition by shard, part order by doc_id, text_crc32, size) - 1"))
    return numbered.join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), "grown_shard")
