"""Parquet tables with checked columns, canonical writers, stores read as one."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.digest import row_hash, set_digest


def open_table(spark: SparkSession, path: str, columns: list[str], rows: int | None = None) -> DataFrame:
    """A Parquet table that has exactly these columns and, if said, this many rows."""
    df = spark.read.parquet(path)
    if set(df.columns) != set(columns):
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(columns))}")
    if rows is not None and df.count() != rows:
        raise ValueError("row count differs")
    return df.select(*columns)


def at_level(spark: SparkSession, path: str, level: str, columns: list[str], level_column: str = "level") -> DataFrame:
    """Rows of one level; the filter and the columns reach the scan."""
    return spark.read.parquet(path).where(F.col(level_column) == level).select(*columns)


def write_sorted(df: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """Parquet in key order over all files: zstd, no dictionaries."""
    n = [partitions] if partitions else []
    df.repartitionByRange(*n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


def export(df: DataFrame, path: str, fmt: str) -> DataFrame:
    """Writes columns by name and rows in their order as json, csv or parquet; one row with rows, schema and digest."""
    if fmt not in ("json", "csv", "parquet"):
        raise ValueError(fmt)
    cols = sorted(df.columns)
    out = df.select(*cols)
    w = out.orderBy(*cols).write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))
    d = set_digest(out.withColumn("__h", row_hash(cols)).withColumn("__a", F.lit(1)), ["__a"], "__h")
    return d.select(F.col("members").alias("rows"), F.lit(json.dumps([[f.name, f.dataType.simpleString()] for f in out.schema.fields])).alias("schema"), "digest")


def write_outputs(tables: dict[str, DataFrame], folder: str, formats: tuple[str, ...] = ("parquet", "json", "csv")) -> None:
    """Each research table in each format."""
    for name, df in tables.items():
        for fmt in formats:
            w = df.write.mode("overwrite")
            (w.option("header", True).csv(f"{folder}/{name}.csv") if fmt == "csv" else w.format(fmt).save(f"{folder}/{name}.{fmt}"))


def load_release(tables: dict[str, DataFrame], folder: str, partition: list[str]) -> None:
    """Tables partitioned by release and election, so that reads of one release prune the rest."""
    for name, df in tables.items():
        df.write.mode("append").partitionBy(*[p for p in partition if p in df.columns]).parquet(f"{folder}/{name}")


def to_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Bulk load into a relational store, by the driver that the caller puts on the class path."""
    df.write.mode("append").option("batchsize", 20_000).jdbc(url, table, properties=properties)


def federated(spark: SparkSession, stores: list[str], release_id: str | None = None) -> DataFrame:
    """Several stores as one table; a release id prunes to its partitions."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(s) for s in stores])
    return df.where(F.col("release_id") == release_id) if release_id is not None else df


def dataset_catalogue(manifests: DataFrame) -> DataFrame:
    """Datasets of release manifests with counts, sizes and hashes."""
    return manifests.select("release_id", F.explode("datasets").alias("d")).select("release_id", "d.*")
