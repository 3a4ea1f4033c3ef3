"""Weighted near-duplicates by DartMinHash signatures and banded joins.

A document is the weighted set of its five-word shingles, weighted by how often each occurs. Every unit of an element's weight is a
region on which darts fall at unit rate over time, all from hashes of the element, so equal regions receive equal darts in
every document. Each dart names a coordinate of the signature; the earliest dart on a coordinate stays. Two signatures
agree on a coordinate with the probability of the documents' weighted Jaccard similarity. Only about K log K darts fall before all K
coordinates are met, however long the document. (After Christiani, "DartMinHash: Fast Sketching for Weighted Sets", 2020.)

near_duplicate_classes() links documents of similarity 0.8 or more:
1. rows with the same sequence of words become one node, by a 128-bit digest;
2. nodes that share a band of the signature meet in a bucket;
3. in each bucket one leader (the member met most often over all buckets) is compared with the others; linked nodes become one class, and
   buckets whose members are all in one class are done;
4. what is left of small buckets is compared in pairs of different classes, of large ones in tiles of bounded size inside Python workers, where
   only links become rows; so no link between classes is lost.
A pair is first held against the estimate from the signatures (EST_SLACK below the threshold, more than five deviations), then compared
by its shingles, as multisets of 64-bit hashes.

Defined cases: a null, empty or wordless text has no shingles, links with nothing and is its own class; a text of one to four words is
one shingle; a null doc_id is linked like any other and has a null class only if no row of its class has an id; of each class one row is
kept, that of the smallest id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import components, store
from tapeloom.llm.kernels import U64, mix64, occurrence_cells, shingle_hashes, text_chunks, word_hashes

BANDS, BAND_ROWS = 24, 5
WIDTH, LEAST = 5, 0.8
EST_SLACK = 0.2


def regions(elements: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit regions of weighted elements: hash, row, and how much of the unit is covered (the last one may be a fraction)."""
    units = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), units)
    level = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    with np.errstate(over="ignore"):
        cells = np.where(level > 0, mix64(elements[at] + mix64(level)), elements[at])
    return cells, rows[at], np.minimum(1.0, weights[at] - level)


def dart_signatures(cells: np.ndarray, rows: np.ndarray, n_rows: int, k: int, covered: np.ndarray | None = None) -> np.ndarray:
    """n_rows × k signature of regions. A row without regions keeps zeros."""
    signature = np.zeros((n_rows, k), dtype=U64)
    weight = np.bincount(rows, weights=covered, minlength=n_rows)
    todo, reach = weight > 0, np.log(k) + 4.0
    horizon = np.zeros(n_rows)
    while todo.any():
        horizon[todo] = reach * k / weight[todo]
        live = todo[rows]
        _throw(signature, cells[live], rows[live], None if covered is None else covered[live], horizon, k)
        todo &= (signature == 0).any(axis=1)
        reach *= 2  # a few rows have a coordinate no dart has met: the same darts, watched for longer
    return signature


def _throw(signature: np.ndarray, cells: np.ndarray, rows: np.ndarray, covered: np.ndarray | None, horizon: np.ndarray, k: int) -> None:
    time = np.zeros(len(cells))
    place, when, dart = [], [], []
    number = 0
    while len(cells):
        with np.errstate(over="ignore"):
            u = mix64(cells + U64((number * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64)))
            time = time - np.log(((u >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            live = time <= horizon[rows]
            cells, rows, time, u = cells[live], rows[live], time[live], u[live]
            d = mix64(u + U64(0x2545F4914F6CDD1D)) | U64(1)
            hit = slice(None)
            if covered is not None:
                covered = covered[live]
                hit = (mix64(d) >> U64(11)).astype(np.float64) * 2.0**-53 < covered
            place.append(rows[hit] * k + ((d[hit] >> U64(32)) % U64(k)).astype(np.int64))
            when.append(time[hit])
            dart.append(d[hit])
        number += 1
    place, when, dart = np.concatenate(place), np.concatenate(when), np.concatenate(dart)
    first = np.full(signature.size, np.inf)
    np.minimum.at(first, place, when)
    earliest = when == first[place]
    signature.reshape(-1)[place[earliest]] = dart[earliest]


def band_keys(signature: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    key = np.zeros((len(signature), bands), dtype=U64) + np.arange(1, bands + 1, dtype=U64)
    with np.errstate(over="ignore"):
        for j in range(band_rows):
            key = mix64(key + signature[:, j : bands * band_rows : band_rows])
    return key.view(np.int64)


def _sketch(bands: int, band_rows: int, width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_chunks(texts):
                words, counts = word_hashes(texts[a:b])
                stops = np.cumsum(counts)
                digests = [hashlib.blake2b(words[x - n : x].tobytes(), digest_size=16).digest() if n else None for x, n in zip(stops, counts)]
                elements, rows = shingle_hashes(words, counts, width)
                signature = dart_signatures(occurrence_cells(elements, rows), rows, b - a, bands * band_rows)
                keys = band_keys(signature, bands, band_rows)
                short = [row.tobytes() for row in (signature >> U64(48)).astype("<u2")]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                doc_id, text, row = (c.slice(a, b - a) for c in batch.columns)
                cols = [doc_id, row, pa.array(digests, pa.binary()), lists, pa.array(short, pa.binary()), text]
                names = ["doc_id", "row", "digest", "bands", "signature", "text"]
                yield pa.RecordBatch.from_arrays(cols[: 5 + with_text], names=names[: 5 + with_text])

    return run


def _cells(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_chunks(texts):
                words, counts = word_hashes(texts[a:b])
                elements, rows = shingle_hashes(words, counts, width)
                at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=b - a))])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(occurrence_cells(elements, rows).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["node", "cells"])

    return run


def sketches(docs: DataFrame, bands: int = BANDS, band_rows: int = BAND_ROWS, width: int = WIDTH, key: str | None = None) -> DataFrame:
    """doc_id, a number of the row (the column key, if named), digest of the words (null without words), the band keys of the signature,
    16 bits of each of its coordinates, and, where rows are numbered as they are read, the text: write that table before it is read twice."""
    row = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row"))
    return rows.mapInArrow(_sketch(bands, band_rows, width, key is None), "doc_id long, row long, digest binary, bands array<long>, signature binary" + ", text string" * (key is None))


def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal coordinates of two signatures."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(v), dtype="<u2").reshape(len(v), -1) for v in (a, b))
    return pd.Series((x == y).mean(axis=1))


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    agreement = F.pandas_udf(_agreement, "double")
    rows = pairs.join(nodes.select(F.col("node").alias("a"), F.col("signature").alias("_x")).hint("merge"), "a")
    rows = rows.join(nodes.select(F.col("node").alias("b"), F.col("signature").alias("_y")).hint("merge"), "b")
    return rows.where(agreement("_x", "_y") >= least).select("a", "b")


def _similar(pairs: DataFrame, cells: DataFrame, least: float, per_task: int = 2000) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least `least`. A node of many pairs is read in several shares."""
    shares = store.written(pairs.groupBy("a").agg(F.ceil(F.count("*") / per_task).cast("int").alias("_shares")), "shares")
    left = cells.withColumnRenamed("node", "a").join(shares.hint("merge"), "a").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    right = pairs.join(shares.hint("merge"), "a").withColumn("_share", F.pmod(F.xxhash64("b"), F.col("_shares")).cast("int"))
    right = right.join(cells.select(F.col("node").alias("b"), F.col("cells").alias("_b")).hint("merge"), "b")
    both = right.join(left.select("a", "_share", F.col("cells").alias("_a")).hint("merge"), ["a", "_share"])
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(common >= least * (F.size("_a") + F.size("_b") - common)).select("a", "b")


def overlaps(lists: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of any two of the lists (each without repeats), over blocks of elements so that memory stays bounded."""
    sizes = np.array([len(x) for x in lists])
    rows = np.repeat(np.arange(len(lists)), sizes)
    values, column = np.unique(np.concatenate(lists), return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(lists), len(lists)), dtype=np.float32)
    for a in range(0, len(values), 4096):
        low, high = np.searchsorted(column, [a, a + 4096])
        dense = np.zeros((len(lists), 4096), dtype=np.float32)
        dense[rows[low:high], column[low:high] - a] = 1
        out += dense @ dense.T
    return out


def _links_in_tile(least: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lists = [np.asarray(x) for x in frame["cells"]]
        common, size = overlaps(lists), np.array([len(x) for x in lists])
        label, mine, node = (frame[c].to_numpy() for c in ("label", "mine", "node"))
        linked = common >= least * (size[:, None] + size[None, :] - common)
        linked &= (label[:, None] != label[None, :]) & (node[:, None] < node[None, :])
        if len(set(mine)) > 1:
            linked &= mine[:, None] != mine[None, :]  # pairs of one tile are met in that tile's own group
        x, y = np.nonzero(linked)
        return pd.DataFrame({"a": node[x], "b": node[y]})

    return run


def links(texts: DataFrame, nodes: DataFrame, least: float = LEAST, width: int = WIDTH) -> DataFrame:
    """(node, label) for all nodes (node, bands, signature) that are linked with another; a node is the row of texts (row, text) that holds its text,
    and label is the smallest node of the class."""
    members = nodes.select("node", F.explode("bands").alias("band"))
    rows = texts.select(F.col("row").alias("node"), "text")
    cells: list[DataFrame] = []

    def prepare(crowded: DataFrame) -> None:
        wanted = crowded.select("node").distinct()
        cells.append(store.written(rows.join(wanted.hint("merge"), "node", "left_semi").mapInArrow(_cells(width), "node long, cells array<long>"), "cells"))

    def similar(pairs: DataFrame) -> DataFrame:
        return _similar(store.written(_likely(pairs, nodes, least - EST_SLACK), "likely"), cells[0], least)

    def similar_in_tiles(tiled: DataFrame) -> DataFrame:
        with_cells = tiled.join(cells[0].hint("merge"), "node")
        return with_cells.groupBy("band", "i", "j").applyInPandas(_links_in_tile(least), "a long, b long").distinct()

    def sizes() -> DataFrame:
        return cells[0].select("node", F.size("cells").alias("size"))

    return components.linked_classes(members, similar, similar_in_tiles, prepare, sizes)


def near_duplicate_classes(docs: DataFrame, least: float = LEAST, width: int = WIDTH, bands: int = BANDS, band_rows: int = BAND_ROWS, key: str | None = None) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and kept for every row of docs, and the column key, if named: a number for each row of a
    table that is the same in every read."""
    sketched = store.written(sketches(docs, bands, band_rows, width, key), "sketches")
    # a wordless text is the node of its id, or of its row
    alone = F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.concat(F.lit("r"), F.col("row").cast("string"))).cast("binary")
    told = sketched.withColumn("_text", F.coalesce("digest", alone))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    shown = lambda c: F.first(F.when(F.col("digest").isNotNull(), F.col(c))).alias(c)
    nodes = told.groupBy("_text").agg(first.alias("_first"), shown("bands"), shown("signature"))
    nodes = store.written(nodes.select("_text", "_first", F.col("_first.row").alias("node"), "bands", "signature"), "nodes")
    texts = docs.select(F.col(key).cast("long").alias("row"), F.col("text").cast("string").alias("text")) if key else sketched.select("row", "text")
    labels = links(texts, nodes.where(F.col("bands").isNotNull()).select("node", "bands", "signature"), least, width)
    labelled = nodes.select("_text", "_first", "node").join(labels, "node", "left")
    labelled = store.written(labelled.select("_text", "_first", F.coalesce("label", "node").alias("label")), "labelled")
    best = store.written(labelled.groupBy("label").agg(F.min("_first").alias("_best")), "best")
    classes = store.written(labelled.join(best, "label").select("_text", F.col("_best.doc_id").alias("class_id"), F.col("_best.row").alias("_keep")), "classes")
    rows = told.select("doc_id", "row", "_text").join(classes, "_text")
    return rows.select("doc_id", "class_id", (F.col("row") == F.col("_keep")).alias("kept"), *([F.col("row").alias(key)] if key else []))
