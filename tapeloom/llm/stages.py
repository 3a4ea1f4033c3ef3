"""The operators as filtering stages over a table of documents (doc_id, text, lang, source, n_chars).

Every stage decides about rows, not ids: rows are numbered and written first, operators carry the number along, and decisions are joined by it.

A stage decides when it is called, and returns a lazy result over its rows and its decisions, two tables that live as long as anything can read them. So
stages may be chained without writing between them, and several pipelines may run in one session. All other tables of a stage go with the next one.

Defined cases, for all stages: a null doc_id, and one that several rows share, is no other case than any; a null text is empty; rows that are equal in all
columns are rows of their own until a deduplicating stage keeps one of them; an empty table gives an empty result; extra columns are dropped, whatever
their names, and all stages but the last return exactly the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import chunk_dedup, dart_minhash, mixing, packing, quality, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "_row"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(run: Stage) -> Stage:
    @wraps(run)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        store.reclaim(spark, collect=True)
        return run(spark, docs, sf_dir)

    return begun


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row, written so that it is the same in every read."""
    return store.written(docs.select(COLUMNS).withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _where_decided(rows: DataFrame, decisions: DataFrame, keep: Column) -> DataFrame:
    """The documents whose row a decision keeps."""
    return rows.join(store.written(decisions.where(keep).select(ROW), "decisions"), ROW, "left_semi").select(COLUMNS)


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant predicts to be of quality 1. A row's fate depends on its text alone; without any label every row stays."""
    rows, labels = _numbered(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _where_decided(rows, quality.quality_scores(rows, labels, key=ROW), F.col("predicted") == 1)


@_stage
def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: most code points, then the smallest id, a null id last, then the first row. Blank texts are one group."""
    rows = _numbered(docs)
    return _where_decided(rows, chunk_dedup.duplicate_groups(rows, key=ROW), F.col("kept"))


@_stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the smallest id, a null id last, then the first row. A wordless text is a copy of no other id's."""
    rows = _numbered(docs)
    return _where_decided(rows, dart_minhash.near_duplicate_classes(rows, key=ROW), F.col("kept"))


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each reading of a document in the mix, in order of training time, which the files hold when the result is written.

    Documents are whole: of each source one reading at most is cut by its target, and it is kept if half of it or more is taken. So the words of a source
    differ from the mix's by half a document at most. A document without words is in no mix and goes.
    """
    rows = _numbered(docs)
    mixed = mixing.mixture(rows, key=ROW).select(ROW, F.explode("takes").alias("_take"), "size")
    readings = store.written(mixed.where(2 * F.col("_take.words") >= F.col("size")).select(ROW, F.col("_take.time").alias("_time")), "readings")
    return rows.join(readings, ROW).sort("_time", "doc_id", ROW).select(COLUMNS)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets. Sequences are packed within windows of the files' order, which is that of training
    time after the mixing stage, and numbered window by window."""
    return packing.packed_in_file_order(docs)
