"""Content digests of rows and of sets of rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's canonical JSON: columns by name, nulls written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def tuple_hash(*fields: Column) -> Column:
    """SHA-256 of a tuple in which no delimiter can alias: each value with its length; null is a value of its own."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts += [F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")), F.lit(";")]
    return F.sha2(F.concat(*parts), 256)


def digest_tree(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """The leaves of each group's digest: keys, bucket, members, digest of the members in it.

    A member's bucket is the first two hex digits of its SHA-256, so equal sets have equal leaves, whatever their order, and
    two sets that differ do so in the buckets of what only one of them has.
    """
    bucket = F.substring(F.sha2(F.col(member).cast("string"), 256), 1, 2)
    text = F.array_join(F.array_sort(F.collect_list(F.col(member).cast("string"))), ";")
    return df.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("members"), F.sha2(text, 256).alias("digest"))


def tree_root(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """keys, members, digest of each group from its leaves (256 at most)."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: F.concat_ws("=", x["bucket"], x["digest"])), ";")
    return leaves.groupBy(*keys).agg(F.sum("members").alias("members"), F.sha2(whole, 256).alias("digest"))


def tree_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The leaves in which two digest trees differ: keys, bucket, left_members, right_members (0 where a side lacks it)."""
    side = lambda t, n: t.select(*keys, "bucket", F.col("members").alias(f"{n}_members"), F.col("digest").alias(f"__{n}"))
    j = side(left, "left").join(side(right, "right"), [*keys, "bucket"], "full_outer").where("not (__left <=> __right)")
    zero = F.lit(0).cast("long")
    return j.select(*keys, "bucket", F.coalesce("left_members", zero).alias("left_members"), F.coalesce("right_members", zero).alias("right_members"))


def set_digest(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Order-independent SHA-256 of each group's members, with their number: the root of `digest_tree`.

    Members are digested in buckets, and the buckets' digests then, so no task sorts a whole group.
    """
    return tree_root(digest_tree(df, keys, member), keys)


def cohort_digest(declaration: list[str]) -> Column:
    """SHA-256 of a family's declaration: its count and digest, and what it is of (election, layer, metric, version, ..)."""
    return row_hash(declaration)


def _shape(value) -> object:
    if isinstance(value, dict):
        return {k: _shape(value[k]) for k in sorted(value)}
    if isinstance(value, list):
        return [json.loads(x) for x in sorted({json.dumps(_shape(v), sort_keys=True) for v in value})]
    return "null" if value is None else "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "float" if isinstance(value, float) else "text"


def json_shape(payload: Column) -> Column:
    """Canonical shape of a JSON text: keys and types without values; null if it does not parse."""
    return F.pandas_udf(_json_shape, "string")(payload)


def _json_shape(payload: pd.Series) -> pd.Series:

    def one(text):
        try:
            return None if text is None else json.dumps(_shape(json.loads(text)), sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return payload.map(one)


def shape_fingerprint(payload: Column) -> Column:
    return F.sha2(json_shape(payload), 256)
