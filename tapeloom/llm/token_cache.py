"""Token counts from a cache keyed by content and tokenizer digests.

A text's digest is the SHA-256 of its normalised content (null is the empty text; nothing else may be changed, since a
count depends on every character). The cache is a Parquet table (digest, n_tokens) in append mode with a folder for each `tokenizer`,
the SHA-256 of the model file and of the library's version, so another tokenizer's counts are not even opened. It lasts between runs. Counting
joins the batch's distinct digests to the cache, brings each missing text together once, encodes it, and appends the new counts; of the cache only what
the batch asks for is grouped and written.

Defined cases: a cache that does not exist is empty; a digest that two runs have added at once counts once; rows with equal text get equal counts, each its own row; null doc_id is kept; an empty table appends nothing;
extra columns are ignored; a long text is encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import store
from tapeloom.llm.kernels import text_chunks

COUNTS = "digest binary, n_tokens long"
LIMIT = 4096


def tokenizer_digest(model: str) -> str:
    import sentencepiece

    return hashlib.sha256(Path(model).read_bytes() + sentencepiece.__version__.encode()).hexdigest()


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_processors: dict[str, object] = {}


def _processor(model: str):
    """This process's tokenizer; workers are reused between tasks."""
    if model not in _processors:
        import sentencepiece

        _processors[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _processors[model]


def _encode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model)
        for batch in batches:
            texts, counts = batch.column(1).to_pylist(), []
            for a, b in text_chunks(texts, 500_000):
                counts += map(len, sp.encode(texts[a:b], num_threads=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def open_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """A tokenizer's counts (digest, n_tokens) in the cache below path."""
    place = f"{path}/tokenizer={version}"
    where = spark._jvm.org.apache.hadoop.fs.Path(place)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(place)


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def batch_counts(docs: DataFrame, cache_path: str, model: str | None = None) -> DataFrame:
    """digest and n_tokens of every distinct text of docs, from the cache where it has them. What it lacks is encoded, and appended to it."""
    model = model or model_path()
    version = tokenizer_digest(model)
    rows = _digested(docs)
    asked = store.written(rows.select("digest").distinct(), "digests")
    # two runs that fill the cache at once may both append a text: one count each is kept
    known = open_cache(docs.sparkSession, cache_path, version).join(asked, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    known = store.written(known, "known")
    # equal texts meet in one row before the shuffle and after it, so a text that fills a third of the table is no burden
    missing = rows.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")
    fresh = store.written(missing.mapInArrow(_encode(model), COUNTS), "counts")
    if not fresh.isEmpty():
        fresh.write.mode("append").parquet(f"{cache_path}/tokenizer={version}")
    return known.unionByName(fresh)


def count_tokens(docs: DataFrame, cache_path: str, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, the cache being filled with what it lacked."""
    # from written tables, a text that a third of all rows hold is a skewed side of the join, which Spark splits
    counts = batch_counts(docs, cache_path, model)
    rows = _digested(docs).select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
