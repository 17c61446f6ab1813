"""Corpus pipeline over the documents table: each stage works on all that the one before it kept.

Stages: quality classifier (rejected documents go), SimHash near-duplicates (the smallest doc_id of each group stays),
substring dedup (repeated passages are cut out), benchmark decontamination (contaminated documents go), packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, packing, quality, simhash, substring_dedup

TOKENIZER = "word_bpe_49k.json"
CACHED, SLICE_BYTES = 200_000, 1 << 20  # less than packing's own: four stages have used the executors before it


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", threshold=0.3)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(docs)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = out.select("doc_id", "text", *[F.col("rest")[c].alias(c) for c in rest])
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in rest else out).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return found.where(F.size("items") == 0).select("doc_id", "text", *[F.col("rest")[c].alias(c) for c in rest]).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, str(public_tokenizers.path(TOKENIZER)), capacity=4096, end_id=1, cached=CACHED, slice_bytes=SLICE_BYTES)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicates_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.shared import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # a classifier, fingerprints and a genetic algorithm: tested against brute force in tests/llm
