"""Token ids in grammar-compressed shard files (Re-Pair), with random access.

Documents are range-partitioned by ascending id; each partition is a shard, written by Spark's Parquet writer as a run of
blocks. A block holds whole documents of about BLOCK_IDS ids: the sequence left after Re-Pair, the rules, the length of
each rule's expansion, and where each document starts. document_ids() and ids_between() read documents, or any run of ids, from the blocks
that hold them, without expanding the rest.

Re-Pair here replaces many pairs a round: every adjacent pair that occurs min_count times in the block competes, a place
goes to the more frequent of two overlapping pairs, and rounds repeat until no pair is frequent enough to pay for a rule. Pairs never cross the end of
a document. The block is the unit of memory: nothing larger than a block (or one document) is held.

Defined cases: a null text is empty and holds only the end id; rows with equal doc_id stay separate rows, ordered by
a hash of their text (so that they too may be spread over shards); a null doc_id comes first; an empty table gives no blocks and no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import byte_bpe, store
from tapeloom.llm.kernels import text_chunks

BLOCK_IDS = 1 << 20
END_ID = 0
_HEAD = struct.Struct("<4sIIIII")
_MAGIC = b"RPG1"
BLOCK_SCHEMA = "shard int, block int, start long, n_ids long, n_docs int, first_doc long, last_doc long, payload binary"


class Grammar:
    """n_terminals: ids below it stand for themselves. Rule k makes symbol n_terminals + k out of left[k] and right[k]."""

    def __init__(self, n_terminals: int, left: np.ndarray, right: np.ndarray, lengths: np.ndarray):
        self.n_terminals, self.left, self.right, self.lengths = n_terminals, left, right, lengths
        self._flat: np.ndarray | None = None

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Number of ids that each symbol expands to."""
        out = np.ones(len(symbols), dtype=np.int64)
        rule = symbols >= self.n_terminals
        out[rule] = self.lengths[symbols[rule] - self.n_terminals]
        return out

    def _by_levels(self, flat: np.ndarray) -> np.ndarray:
        """All ids of the symbols, one level of the rules at a time."""
        flat = flat.astype(np.uint32)
        while (rule := flat >= self.n_terminals).any():
            width = 1 + rule
            at = (np.cumsum(width) - width)[rule]
            k = flat[rule] - self.n_terminals
            flat = np.repeat(flat, width)
            flat[at], flat[at + 1] = self.left[k], self.right[k]
        return flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids of the symbols. A few are expanded by themselves; for many, the expansions of all rules are made once and copied."""
        if not len(symbols):
            return np.empty(0, dtype=np.uint32)
        sizes = self.sizes(symbols)
        if self._flat is None:
            if 4 * sizes.sum() < self.lengths.sum():
                return self._by_levels(symbols)
            self._flat = self._by_levels(np.arange(self.n_terminals, self.n_terminals + len(self.left)))
            self._first = np.cumsum(self.lengths) - self.lengths
        total = np.cumsum(sizes)
        out = np.repeat(symbols, sizes)
        rule = np.flatnonzero(symbols >= self.n_terminals)
        k = symbols[rule] - self.n_terminals
        # places of the rules' ids in the output, and where those ids stand in the flat expansions
        n = sizes[rule]
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(total[rule] - n, n) + run] = self._flat[np.repeat(self._first[k], n) + run]
        return out.astype(np.uint32)


def _frequent_pairs(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(at, len(ordered)))
    often = counts >= least
    return ordered[at[often]], counts[often]


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


def repair(ids: np.ndarray, last: np.ndarray, n_terminals: int, min_count: int = 16) -> tuple[np.ndarray, np.ndarray, Grammar]:
    """Compress ids; last marks the final id of each document. Returns the symbols, their own last marks, and the grammar.

    A pair that is not frequent stays so until one of its symbols is replaced, so a round looks only at the pairs that were
    frequent in the round before and at those beside a new symbol.
    """
    symbols = ids.astype(np.uint32)
    last = last.copy()
    left, right, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    grammar = Grammar(n_terminals, left[0], right[0], lengths[0])
    n_rules, bits = 0, 19
    places = np.flatnonzero(~last[:-1])
    while len(places):
        keys = (symbols[places].astype(np.uint64) << np.uint64(32)) | symbols[places + 1]
        slots = _slots(keys, bits)
        # only places in well-filled slots can hold a frequent pair; the rest is not sorted
        often = (np.bincount(slots, minlength=1 << bits) >= min_count)[slots]
        places, keys, slots = places[often], keys[often], slots[often]
        pairs, counts = _frequent_pairs(keys, min_count)
        if not len(pairs):
            break
        # more frequent pairs get higher marks; two pairs that share a slot meet again next round
        pairs = pairs[np.argsort(counts, kind="stable")]
        table = np.zeros(1 << bits, dtype=np.int32)
        table[_slots(pairs, bits)] = np.arange(1, len(pairs) + 1)
        marks = table[slots]
        true = (marks > 0) & (pairs[marks - 1] == keys)
        again = np.zeros(len(symbols), dtype=bool)
        again[places] = True
        places, marks = places[true], marks[true]
        mark = np.zeros(len(symbols) + 1, dtype=np.int32)
        mark[places] = marks
        # in a run of one pair over and over every other place counts
        begins = np.ones(len(places), dtype=bool)
        begins[1:] = (places[1:] != places[:-1] + 1) | (marks[1:] != marks[:-1])
        along = np.arange(len(places)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        chosen = (along % 2 == 0) & ((marks > mark[places - 1]) | ~begins) & (marks >= mark[places + 1])
        places, marks = places[chosen], marks[chosen]
        uses = np.bincount(marks, minlength=len(pairs) + 1)
        paid = uses >= max(2, min_count // 2)
        paid[0] = False
        if not paid.any():
            break
        name = np.cumsum(paid) - 1 + n_terminals + n_rules
        worth = paid[marks]
        at, marks = places[worth], marks[worth]
        new = pairs[np.flatnonzero(paid) - 1]
        left.append((new >> np.uint64(32)).astype(np.uint32))
        right.append((new & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        lengths.append(grammar.sizes(left[-1]) + grammar.sizes(right[-1]))
        symbols[at] = name[marks]
        last[at] = last[at + 1]
        again[at] = again[at[at > 0] - 1] = True
        stay = np.ones(len(symbols), dtype=bool)
        stay[at + 1] = False
        symbols, last = symbols[stay], last[stay]
        places = np.flatnonzero(again[stay][:-1] & ~last[:-1])
        n_rules += len(new)
        grammar = Grammar(n_terminals, np.concatenate(left), np.concatenate(right), np.concatenate(lengths))
    return symbols, last, grammar


def _planes(x: np.ndarray) -> bytes:
    """One plane for each byte compresses better. Symbols have 24 bits; a block whose grammar needs more is an error."""
    if len(x) and x.max() >= 1 << 24:
        raise OverflowError(f"A block of {len(x)} symbols has more than {1 << 24} terminals and rules")
    return b"".join(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, k]).tobytes() for k in range(3))


def _unplanes(data: memoryview, n: int) -> np.ndarray:
    out = np.zeros((n, 4), dtype=np.uint8)
    for k in range(3):
        out[:, k] = np.frombuffer(data[k * n : (k + 1) * n], dtype=np.uint8)
    return out.reshape(-1).view("<u4").astype(np.uint32)


def pack_block(doc_ids: list, counts: np.ndarray, ids: np.ndarray, n_terminals: int) -> bytes:
    """A block's bytes: header; rules (left, right) and expansion lengths; symbols; per document its id, validity and first symbol."""
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(counts) - 1] = True
    symbols, ends, g = repair(ids, last, n_terminals)
    first = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    return b"".join([
        _HEAD.pack(_MAGIC, n_terminals, len(g.left), len(symbols), len(doc_ids), 0),
        g.left.astype("<u4").tobytes(), g.right.astype("<u4").tobytes(), g.lengths.astype("<i8").tobytes(),
        _planes(symbols),
        np.array([d is not None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), first.astype("<u4").tobytes(),
    ])


class Block:
    """A block read back."""

    def __init__(self, payload: bytes):
        magic, n_terminals, n_rules, n_symbols, n_docs, _ = _HEAD.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a grammar block")
        view, at = memoryview(payload), _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        left, right, lengths = take("<u4", n_rules), take("<u4", n_rules), take("<i8", n_rules)
        self.grammar = Grammar(n_terminals, left, right, lengths)
        self.symbols = _unplanes(view[at : at + 3 * n_symbols], n_symbols)
        at += 3 * n_symbols
        valid, ids = take("u1", n_docs), take("<i8", n_docs)
        self.doc_ids = [int(d) if v else None for d, v in zip(ids, valid)]
        self.first_symbol = take("<u4", n_docs).astype(np.int64)
        self.stops = np.cumsum(self.grammar.sizes(self.symbols))

    def all_ids(self) -> np.ndarray:
        return self.grammar.expand(self.symbols)

    def doc_starts(self) -> np.ndarray:
        """Each document's first id, counted within the block."""
        return np.concatenate([[0], self.stops])[self.first_symbol]

    def decode_range(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop] of the block, expanding only the symbols that overlap the range."""
        a, b = np.searchsorted(self.stops, start, "right"), np.searchsorted(self.stops, stop, "left")
        skip = start - (self.stops[a - 1] if a else 0)
        return self.grammar.expand(self.symbols[a : b + 1])[skip : skip + max(0, stop - start)]

    def document(self, k: int) -> np.ndarray:
        starts = np.append(self.doc_starts(), self.stops[-1])
        return self.decode_range(int(starts[k]), int(starts[k + 1]))


def _write_blocks(path: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_bpe.encoder(path)
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, counts, parts, held, block, start
            n, ids = np.concatenate(counts), np.concatenate(parts)
            row = [shard, block, start, len(ids), len(docs), docs[0], docs[-1], pack_block(docs, n, ids, enc.n_symbols)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])
            block, start, docs, counts, parts, held = block + 1, start + len(ids), [], [], [], 0
            return out

        for batch in batches:
            ids_col, all_texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_chunks(all_texts, 1_000_000):
                ids, n = enc.encode(all_texts[a:b])
                n = n + 1
                ids = np.insert(ids, np.cumsum(n - 1), END_ID)
                ends, low = np.cumsum(n), 0
                while low < len(n):  # whole documents until the block is full
                    before = int(ends[low - 1]) if low else 0
                    high = min(int(np.searchsorted(ends, before + block_ids - held)) + 1, len(n))
                    docs += ids_col[a + low : a + high]
                    counts.append(n[low:high])
                    parts.append(ids[before : ends[high - 1]])
                    held += int(ends[high - 1]) - before
                    low = high
                    if held >= block_ids:
                        yield flush()
        if docs:
            yield flush()

    return run


def write_token_shards(docs: DataFrame, path: str, vocabulary: str, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append END_ID, and write the shards below path in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(_write_blocks(vocabulary, block_ids), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with start counted over all shards. The driver sees one number for each shard."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    base, before = {}, 0
    for shard in sorted(totals):
        base[shard], before = before, before + totals[shard]
    offsets = spark.createDataFrame(list(base.items()) or [(0, 0)], "shard int, base long")
    return blocks.join(F.broadcast(offsets), "shard").withColumn("start", F.col("start") + F.col("base")).drop("base")


def _read_documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = Block(payload.as_py())
                ids = block.all_ids().astype("<u4")
                at = np.append(block.doc_starts(), len(ids))
                cols = [pa.array(block.doc_ids, pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document from the files: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return read_blocks(spark, path).select("start", "payload").mapInArrow(_read_documents(with_ids), schema)


def _read_some(wanted: frozenset[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                block = Block(payload.as_py())
                ks = [k for k, d in enumerate(block.doc_ids) if d in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([block.doc_ids[k] for k in ks], pa.int64()), pa.array([block.document(k).astype(np.int32) for k in ks], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def document_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the documents asked for. Only blocks whose range of ids holds one of them are read, and only the documents are expanded."""
    wanted = frozenset(doc_ids)
    held = F.lit(False)
    for d in wanted:
        held = held | ((F.col("first_doc").isNull() | (F.col("first_doc") <= d)) & (F.col("last_doc") >= d))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).where(held)
    return blocks.select("payload").mapInArrow(_read_some(wanted), "doc_id long, ids array<int>")


def ids_between(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """start and ids of the run [start, stop) of all ids in order, one row for each block that holds a part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                a = max(start - first, 0)
                ids = Block(payload.as_py()).decode_range(a, stop - first).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([first + a]), pa.array([ids], pa.list_(pa.int32()))], names=["start", "ids"])

    blocks = read_blocks(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    return blocks.select("start", "payload").mapInArrow(run, "start long, ids array<int>")


def token_shards_report(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write docs to new shard files in the shared folder and read every document back."""
    path = store.fresh_path(spark, "token-shards")
    write_token_shards(docs, path, vocabulary or byte_bpe.vocabulary_path())
    return read_documents(spark, path, with_ids=False)
