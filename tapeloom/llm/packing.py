"""Sequences of at most `size` tokens by shortest-pack-first over the length histogram.

Every document is cut into pieces of `size` ids and one shorter rest. Full pieces are sequences of their own. For the rests,
the histogram of lengths is packed (at most size - 1 counts, whatever the corpus): lengths are placed longest first, each
into the pack pattern that is shortest so far (has most room), updating how often each pattern is used. Spark then joins
patterns back to documents: rests of one length are ranked, and each slot of a pattern owns a run of ranks.

Ranking is spread: a rest falls into a cell (length, salt), cells are counted, and a rest's rank is its place in the cell
after the counts of the cells before it. A length that holds a third of all rows is many cells, and so is a doc_id.

pack() may be given windows, runs of the training order: each has a histogram of its own and its sequences follow those of the window before.
in_file_order() makes windows of the files that a table is read from, which hold a sorted table in order.

Defined cases: a null text is empty and holds only the end id; rows with equal doc_id are separate documents; an empty table
packs into nothing; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import byte_bpe, store

SIZE = 1024
END_ID = 0
CELL_ROWS = 200_000
#: Least number of tokens of a window of in_file_order().
WINDOW_TOKENS = 1 << 22


def _cut(vocabulary: str, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_bpe.encoder(vocabulary)
        for batch in batches:
            doc_ids = np.array(batch.column(0).to_pylist(), dtype=object)
            for a in range(0, len(doc_ids), 512):
                ids, n = enc.encode([t or "" for t in batch.column(1).slice(a, 512).to_pylist()])
                ids = np.insert(ids, np.cumsum(n), END_ID).astype("<u4")
                n = n + 1
                pieces = -(-n // size)
                doc = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                length = np.minimum(size, n[doc] - start)
                at = (np.cumsum(n) - n)[doc] + start
                cols = [pa.array(doc_ids[a : a + 512][doc].tolist(), pa.int64()), pa.array(start), pa.array(length), pa.array([zlib.crc32(ids[x : x + k]) for x, k in zip(at, length)], pa.int64()), pa.array(n[doc])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.view("<i4"))))
                    names.append("ids")
                carried = [c.slice(a, 512).take(pa.array(doc)) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*cols, *carried], names=[*names, *batch.schema.names[2:]])

    return run


def token_pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, with_ids: bool = True, carry: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids of each piece, and the string column carry of its document."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + (f", {carry} string" if carry else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([carry] if carry else []))
    return rows.mapInArrow(_cut(vocabulary or byte_bpe.vocabulary_path(), size, with_ids), schema)


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns (their lengths in order of placing) and how many packs follow each. Works on counts alone."""
    by_room: dict[int, list[list]] = {}
    packed: list[tuple[list[int], int]] = []

    def put(pattern: list[int], times: int) -> None:
        room = size - sum(pattern)
        if room:
            by_room.setdefault(room, []).append([pattern, times])
        else:
            packed.append((pattern, times))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        grown: list[tuple[list[int], int]] = []
        while left:
            room = max(by_room, default=0)
            if room < length:
                # as many of this length as fit share one new pack
                each = min(size // length, left)
                grown.append(([length] * each, left // each))
                left %= each
                continue
            pattern, times = by_room[room][-1]
            each = min(room // length, -(-left // times))
            uses = min(times, left // each)
            by_room[room][-1][1] -= uses
            if not by_room[room][-1][1]:
                by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
            put(pattern + [length] * each, uses) if each * length == room else grown.append((pattern + [length] * each, uses))
            left -= each * uses
        for pattern, times in grown:
            put(pattern, times)
    for rest in by_room.values():
        packed += [(p, t) for p, t in rest]
    return packed


def pattern_slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset): the ranks of a length that each slot owns."""
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            slots.append((length, rank, rank + times, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    return slots


def _salted(df: DataFrame, keys: list[str], cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """df with a _cell of each row, and for each cell of the keys the number of rows in the cells before it: _before."""
    salts = max(8, -(-df.count() // cell_rows))
    df = df.withColumn("_cell", F.pmod(F.xxhash64(*ORDER), F.lit(salts)))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    return df, cells.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


#: Pieces of equal ids are told apart by their contents, as far as that makes a difference.
ORDER = ["doc_id", "start", "ids_crc32"]


def _ranked(df: DataFrame, keys: list[str], cell_rows: int) -> DataFrame:
    """Add rank: 0, 1, ... among the rows of each key, without bringing a key's rows together."""
    df, cells = _salted(df, keys, cell_rows)
    place = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*ORDER)) - 1
    return df.withColumn("rank", place).join(cells, [*keys, "_cell"]).withColumn("rank", F.col("rank") + F.col("_before")).drop("_cell", "_before")


def _slots(size: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        slots = pattern_slots(pack_histogram(dict(zip(frame["length"].tolist(), frame["n"].tolist())), size))
        out = pd.DataFrame(slots, columns=["length", "from", "to", "sequence", "offset"], dtype="int64")
        out.insert(0, "_window", frame["_window"].iloc[0])
        return out

    return run


def pack(pieces: DataFrame, size: int = SIZE, cell_rows: int = CELL_ROWS, window: str | None = None) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (doc_id, start, length up to size, ids_crc32, ...); window names a long column, or all are one window.

    pieces is read several times and must give the same rows each time: pass a written table.
    """
    columns = [c for c in pieces.columns if c != window]
    pieces = pieces.withColumn("_window", F.col(window) if window else F.lit(0).cast("long"))
    rest, full = pieces.where(F.col("length") < size), pieces.where(F.col("length") == size)
    # one histogram for each window: less than `size` rows; a few slots for each length come out
    histograms = rest.groupBy("_window", "length").agg(F.count("*").alias("n"))
    slots = store.written(histograms.groupBy("_window").applyInPandas(_slots(size), "_window long, length long, from long, to long, sequence long, offset long"), "slots")
    used = slots.groupBy("_window").agg(F.max(F.col("sequence") + F.col("to") - F.col("from")).alias("_used"))
    counted = full.groupBy("_window").agg(F.count("*").alias("_full")).join(used, "_window", "full")
    counted = counted.select("_window", F.coalesce("_used", F.lit(0)).alias("_used"), F.coalesce("_full", F.lit(0)).alias("_full"))
    earlier = Window.orderBy("_window").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each window
    bases = store.written(counted.select("_window", "_used", F.coalesce(F.sum(F.col("_used") + F.col("_full")).over(earlier), F.lit(0)).alias("_base")), "windows")
    by_length = store.written(slots.groupBy("_window", "length").agg(F.sort_array(F.collect_list(F.struct("from", "to", "sequence", "offset"))).alias("_slots")), "length-slots")
    slot = F.element_at(F.filter("_slots", lambda s: (s["from"] <= F.col("rank")) & (F.col("rank") < s["to"])), 1)
    rests = _ranked(rest, ["_window", "length"], cell_rows).join(by_length, ["_window", "length"]).withColumn("_slot", slot).join(bases, "_window")
    rests = rests.withColumn("sequence_id", F.col("_base") + F.col("_slot.sequence") + F.col("rank") - F.col("_slot.from")).withColumn("offset", F.col("_slot.offset"))
    # full pieces follow the rests of their window
    full = _ranked(full, ["_window"], cell_rows).join(bases, "_window")
    full = full.withColumn("sequence_id", F.col("_base") + F.col("_used") + F.col("rank")).withColumn("offset", F.lit(0).cast("long"))
    return rests.select(*columns, "sequence_id", "offset").unionByName(full.select(*columns, "sequence_id", "offset"))


def packed_documents(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """The pieces of docs with their sequences; the pieces are tokenised once, into a table without the ids."""
    return pack(store.written(token_pieces(docs, size, vocabulary, with_ids=False), "pieces"), size)


def in_file_order(docs: DataFrame) -> DataFrame:
    """docs with _file, whose order is that of the files docs was read from, by part number; rows that come from no file share one."""
    name = F.col("_metadata.file_name")
    part = F.lpad(F.regexp_extract(name, r"part-(\d+)", 1), 12, "0")
    try:
        return docs.withColumn("_file", F.concat_ws("/", part, name))
    except AnalysisException:  # not a plain scan of files
        return docs.withColumn("_file", F.lit(""))


def packed_in_file_order(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """packed_documents() in windows of files that hold window_tokens tokens or more, so that sequences follow the order of a sorted table."""
    pieces = store.written(token_pieces(in_file_order(docs), size, vocabulary, with_ids=False, carry="_file"), "pieces")
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each file
    before = F.coalesce(F.sum("_tokens").over(earlier), F.lit(0))
    files = pieces.groupBy("_file").agg(F.sum("length").alias("_tokens")).select("_file", F.floor(before / window_tokens).alias("_run"))
    placed = store.written(pieces.join(store.written(files, "files"), "_file").drop("_file"), "placed")
    return pack(placed, size, window="_run")
