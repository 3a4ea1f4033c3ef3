"""A regularised quadratic discriminant over document statistics.

Statistics of a text (letters, marks, capitals, word shapes, repetition) come from byte counts and word hashes of whole Arrow batches and are
transformed to be nearly normal. fit() needs, for each class, the count, the sum and the sum of outer products of its labelled rows;
executors add these up, so all labelled rows are used and the driver sees 2 × (1 + d + d²) numbers. Each class covariance is shrunk towards
the pooled one and that towards its diagonal; its Cholesky factor is computed once and kept in the model.
A score is the difference of the two Mahalanobis log-densities plus log priors, put through a logistic curve.

Defined cases: a null text is empty; empty and wordless texts are scored from the same statistics (all zero rates); labels that repeat a
doc_id count once, by their smallest label; null labels are not learnt from; with a class missing from the labels every text is
of the other class (score 0 or 1), and without any label every score is 0.5; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import store
from tapeloom.llm.kernels import U64, mix64, text_chunks, word_hashes

THRESHOLD = 0.3
#: Marks of ordinary prose and of junk.
PROSE_MARKS = b".,;:'\"-()?"
FEATURES = (
    "log_chars", "log_words", "mean_word", "capital", "digit", "prose_mark", "odd_mark", "exclaim", "bar", "non_ascii", "line",
    "long_word", "distinct_word", "same_line", "words_by_space", "doubled_word",
)


def _class_table() -> np.ndarray:
    """Byte to kind: 0 other, 1 capital, 2 digit, 3 prose mark, 4 exclamation, 5 bar, 6 odd mark, 7 above ASCII, 8 line end, 9 space, 10 small letter."""
    table = np.zeros(256, dtype=np.uint8)
    table[33:127] = 6
    table[65:91], table[97:123], table[48:58], table[128:] = 1, 10, 2, 7
    table[list(PROSE_MARKS)] = 3
    table[ord("!")], table[ord("|")], table[10], table[32] = 4, 5, 8, 9
    return table


_KIND = _class_table()
#: Usual rates in prose of kinds 1 to 8; a short text's rates are drawn towards them.
USUAL = np.array([0.015, 0.002, 0.02, 0.0005, 0.0005, 0.001, 0.03, 0.003])
USUAL_BYTES = 50.0


def statistics(texts: list[str]) -> np.ndarray:
    """len(texts) × len(FEATURES) transformed statistics."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    n_bytes = np.array([len(p) for p in parts], dtype=np.int64)
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    rows = np.repeat(np.arange(len(parts)), n_bytes)
    kinds = np.bincount(rows * 11 + _KIND[data], minlength=11 * len(parts)).reshape(-1, 11).astype(np.float64)
    hashes, n_words = word_hashes(texts)
    word_rows = np.repeat(np.arange(len(parts)), n_words)
    distinct = np.bincount((np.unique((hashes >> U64(24)) | (word_rows.astype(U64) << U64(40))) >> U64(40)).astype(np.int64), minlength=len(parts))
    size = np.maximum(n_bytes, 1)
    letters = kinds[:, 1] + kinds[:, 10] + kinds[:, 7]
    kinds[:, 1] = np.maximum(0, kinds[:, 1] - kinds[:, 3] - kinds[:, 8] - 1)  # capitals beyond those that may open a sentence
    rate = lambda k: np.log((kinds[:, k] + USUAL[k - 1] * USUAL_BYTES) / (size + USUAL_BYTES))
    same = (hashes[1:] == hashes[:-1]) & (word_rows[1:] == word_rows[:-1])
    doubled = np.bincount(word_rows[1:][same], minlength=len(parts))
    spaces = kinds[:, 9] + kinds[:, 8]
    lines = [t.split("\n") for t in texts]
    top = np.array([1 - len(set(x)) / len(x) for x in lines])
    return np.column_stack([
        np.log1p(n_bytes), np.log1p(n_words), np.log((letters + 25.0) / (n_words + 5.0)), *(rate(k) for k in (1, 2, 3, 6, 4, 5, 7, 8)),
        np.log((n_bytes + 30.0) / (spaces + 5.0)), np.log((distinct + 5.0) / (n_words + 5.0)), top, np.log((n_words + 5.0) / (spaces + 5.0)),
        np.log((doubled + 0.1) / (n_words + 10.0)),
    ])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in text_chunks(texts):
            x = statistics(texts[a:b])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            carried = [c.slice(a, b - a) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, *carried], names=["doc_id", "x", *batch.schema.names[2:]])


def measured(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id and x, the statistics of each text, and the column key, a number for each row, if named."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([key] if key else []))
    return rows.mapInArrow(_measure, "doc_id long, x array<double>" + (f", {key} long" if key else ""))


@dataclass
class Model:
    log_prior: np.ndarray  # of labels 0 and 1
    means: np.ndarray
    factors: list[np.ndarray]  # inverse Cholesky factors of the class covariances
    log_dets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; higher means that label 1 is likelier."""
        density = []
        for k in (0, 1):
            if not np.isfinite(self.log_prior[k]):
                density.append(np.full(len(x), -np.inf))
                continue
            z = (x - self.means[k]) @ self.factors[k].T
            density.append(self.log_prior[k] - 0.5 * (self.log_dets[k] + np.einsum("ij,ij->i", z, z)))
        gap = np.clip(density[1] - density[0], -35, 35)
        return 1.0 / (1.0 + np.exp(-gap))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for label, part in frame.groupby("label"):
            x = np.column_stack([np.ones(len(part)), np.stack(part["x"].to_numpy())])
            m = (x.T @ x).reshape(-1)
            yield pd.DataFrame({"label": np.int32(label), "i": np.arange(len(m), dtype=np.int32), "v": m})


def fit(labelled: DataFrame, shrink: float = 0.05, ridge: float = 0.02) -> Model:
    """labelled: label (0 or 1) and x. shrink: share of the pooled covariance in each class's; ridge: share of the diagonal."""
    d = len(FEATURES) + 1
    sums = labelled.select("label", "x").mapInPandas(_moments, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    moments = np.zeros((2, d * d))
    for r in sums:
        moments[r.label, r.i] = r.v
    moments = moments.reshape(2, d, d)
    n = moments[:, 0, 0]
    means = moments[:, 0, 1:] / np.maximum(n, 1)[:, None]
    scatter = [moments[k, 1:, 1:] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / max(n.sum() - 2, 1)
    factors, dets = [], []
    for k in (0, 1):
        c = (1 - shrink) * scatter[k] / max(n[k] - 1, 1) + shrink * pooled
        c = (1 - ridge) * c + ridge * np.diag(np.diag(c)) + 1e-6 * np.eye(d - 1)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    with np.errstate(divide="ignore"):
        return Model(np.log(n / n.sum() if n.sum() else np.full(2, 0.5)), means, factors, np.array(dets))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(model.scores(x), 6)), *batch.columns[2:]], names=["doc_id", "score", *batch.schema.names[2:]])

    return run


def held_out(doc_id):
    """Rows that labels are never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, and the column key, if named; labels (doc_id, quality) of rows not held out are learnt from."""
    rows = store.written(measured(docs, key), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    model = fit(rows.join(known, "doc_id"))
    scored = rows.mapInArrow(_score(model), "doc_id long, score double" + (f", {key} long" if key else ""))
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *([key] if key else []))
