"""From raw documents to packed training sequences: quality, exact copies, near copies, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import stages, store

STAGES = [
    ("quality classifier", stages.quality_stage),
    ("exact dedup", stages.exact_dedup_stage),
    ("minhash near-dedup", stages.near_dedup_stage),
    ("mixing sources", stages.mixing_stage),
    ("packing", stages.packing_stage),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of sf_dir; each stage's result is written and read again, and lives until the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
