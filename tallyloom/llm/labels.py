"""Labelled rows for training: what the two classifiers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str = "doc_id") -> Column:
    """True for the fifth of the rows whose labels are never learned from; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def training(labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, y: one row for each labelled, not held-out document; of repeated labels the larger, nulls left out.

    `most` rows, give or take chance, by a hash of doc_id: so few that joins may broadcast them, whatever the corpus.
    """
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    y = y.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    n = y.count()
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)  # 53 bits, so that the share may be as small as the corpus is large
    return y.where(unit < F.lit(2**53 * most // n)) if n > most else y
