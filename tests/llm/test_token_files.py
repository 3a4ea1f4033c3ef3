"""Tokens, token files and packing against the tokenizers library itself."""

import zlib

import numpy as np
import pytest

from tapeloom.llm import byte_bpe, grammar_store, packing, queries, store, token_cache
from tests.llm.conftest import ODD


def direct(texts):
    enc = byte_bpe.encoder(byte_bpe.vocabulary_path()).tokenizer
    return [np.array(e.ids, dtype="<u4") for e in enc.encode_batch([t or "" for t in texts], add_special_tokens=False)]


TRICKY = ["", " ", "a  b\n\n c", "x<|endoftext|> y", "a  b", "café 　 x", "it's  don't", " \t\n x\r\ny  ", "\x1c a!\x1c!b", "\x00a \x00", "a" * 5000, "퟿ \U0001f600"]


def test_units_give_the_library_ids():
    enc = byte_bpe.UnitEncoder(byte_bpe.vocabulary_path(), slots=64)
    texts = TRICKY * 3 + ["the cat sat on the mat. " * 20, "one two three four five six seven " * 9] * 4
    for _ in range(3):  # units push each other out of the memory
        ids, n = enc.encode(texts)
        parts = np.split(ids, np.cumsum(n)[:-1])
        assert all(np.array_equal(a, b) for a, b in zip(parts, direct(texts)))


def test_repair_round_trip_and_random_access():
    g = np.random.default_rng(0)
    for n_docs in (1, 7, 60):
        counts = g.integers(1, 400, n_docs)
        ids = np.minimum(g.zipf(1.5, counts.sum()), 900).astype(np.uint32)
        block = grammar_store.Block(grammar_store.pack_block(list(range(n_docs)), counts, ids, 1000))
        assert np.array_equal(block.all_ids(), ids)
        at = np.cumsum(counts) - counts
        for k in range(n_docs):
            assert np.array_equal(block.document(k), ids[at[k] : at[k] + counts[k]])
        for a, b in g.integers(0, len(ids) + 1, (20, 2)):
            a, b = sorted((int(a), int(b)))
            assert np.array_equal(block.decode_range(a, b), ids[a:b])
    run = np.full(100_000, 7, dtype=np.uint32)  # a long run takes as many rounds as it has doublings
    symbols, _, grammar = grammar_store.repair(run, np.arange(100_000) == 99_999, 10)
    assert len(symbols) < 40 and len(grammar.left) >= 12 and np.array_equal(grammar.expand(symbols), run)
    last = np.zeros(6000, dtype=bool)
    last[-1] = True
    symbols, _, grammar = grammar_store.repair(np.tile([5, 6, 7], 2000).astype(np.uint32), last, 10)
    assert len(symbols) < 100 and grammar.sizes(symbols).sum() == 6000 and len(grammar.left) > 3
    with pytest.raises(ValueError):
        grammar_store.Block(b"x" * 40)


def test_op1_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas().sort_values("doc_id")
    got = queries.op1_repair_token_store(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id")
    start = 0
    for ids, row in zip(direct(docs["text"]), got.itertuples()):
        ids = np.append(ids, 0).astype("<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_odd_rows(spark, odd, none):
    path = store.fresh_path(spark, "odd")
    grammar_store.write_token_shards(odd, path, byte_bpe.vocabulary_path(), block_ids=50)
    got = grammar_store.read_documents(spark, path).collect()
    assert len(got) == len(ODD)
    want = sorted((d is not None, d or 0, tuple(np.append(i, 0))) for (d, *_), i in zip(ODD, direct([r[1] for r in ODD])))
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r.ids)) for r in got) == want
    assert sorted(r.start for r in got)[0] == 0 and max(r.start + r.n_tokens for r in got) == sum(r.n_tokens for r in got)
    assert grammar_store.token_shards_report(spark, none).count() == 0


def test_reading_some_documents_and_runs(spark, sample):
    path = store.fresh_path(spark, "some")
    grammar_store.write_token_shards(sample.repartition(5), path, byte_bpe.vocabulary_path(), block_ids=2000)
    docs = sorted((r.doc_id, r.text) for r in sample.select("doc_id", "text").collect())
    ids = {d: [*e.tolist(), 0] for (d, _), e in zip(docs, direct([t for _, t in docs]))}
    assert spark.read.parquet(path).count() > 5
    wanted = [docs[3][0], docs[120][0], docs[-1][0], -77]
    got = {r.doc_id: r.ids for r in grammar_store.document_ids(spark, path, wanted).collect()}
    assert got == {d: ids[d] for d in wanted[:3]}
    whole = [x for d, _ in docs for x in ids[d]]
    for a, b in ((0, 10), (1500, 9000), (len(whole) - 3, len(whole) + 50), (5, 5)):
        parts = sorted((r.start, r.ids) for r in grammar_store.ids_between(spark, path, a, b).collect())
        assert [x for _, p in parts for x in p] == whole[a:b]


def test_null_ids_are_spread_over_shards(spark):
    frame = spark.createDataFrame([(None, f"text {i} " * 20) for i in range(2000)], "doc_id long, text string").repartition(4)
    path = store.fresh_path(spark, "nulls")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        grammar_store.write_token_shards(frame, path, byte_bpe.vocabulary_path(), block_ids=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = grammar_store.read_blocks(spark, path)
    assert blocks.select("shard").distinct().count() > 1
    rows = grammar_store.read_documents(spark, path, with_ids=False).collect()
    assert len(rows) == 2000 and max(r.start + r.n_tokens for r in rows) == sum(r.n_tokens for r in rows)


def packed_ok(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
    return by


def test_op5_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    rows = queries.op5_histogram_packing(spark, "/root/testdata/sf0.001").collect()
    by = packed_ok(rows)
    want = {d: np.append(i, 0).astype("<u4") for d, i in zip(docs["doc_id"], direct(docs["text"]))}
    seen = {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {d: len(i) for d, i in want.items()}
    waste = sum(1024 - n for n in (sum(r.length for r in p) for p in by.values()) if n & (n - 1))
    assert waste < 0.02 * sum(seen.values())


def test_packing_odd_rows(spark, odd, none):
    rows = packing.packed_documents(odd).collect()
    packed_ok(rows)
    assert sum(r.length for r in rows) == sum(len(i) + 1 for i in direct([r[1] for r in ODD]))
    assert packing.packed_documents(none).count() == 0


def test_hot_length_is_ranked_in_cells(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0L AS start", "cast(if(id % 3 = 0, 700, 1 + id % 300) AS long) AS length", "0L AS ids_crc32", "1L AS doc_tokens")
    rows = packing.pack(store.written(pieces, "p"), cell_rows=100).collect()
    packed_ok(rows)
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3000


def test_windows_follow_the_files(spark):
    """Files hold ascending ids; sequences of a later window come after those of an earlier one, and windows hold the tokens asked for."""
    texts = [(i, f"word{i} " * (1 + 37 * i % 1500)) for i in range(300)]
    path = store.fresh_path(spark, "sorted")
    spark.createDataFrame(texts, "doc_id long, text string").repartitionByRange(12, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    rows = packing.packed_in_file_order(docs, window_tokens=100_000).collect()
    packed_ok(rows)
    files = {r.doc_id: r._file for r in packing.in_file_order(docs).collect()}
    assert len(set(files.values())) == 12
    tokens, run, before = {}, {}, 0
    for r in rows:
        tokens[files[r.doc_id]] = tokens.get(files[r.doc_id], 0) + r.length
    for f in sorted(tokens):
        run[f] = before // 100_000
        before += tokens[f]
    spans = {}
    for r in rows:
        spans.setdefault(run[files[r.doc_id]], []).append(r.sequence_id)
    order = sorted(spans)
    assert len(order) > 2 and all(max(spans[a]) < min(spans[b]) for a, b in zip(order, order[1:]))
    assert {r.sequence_id for r in rows} == set(range(1 + max(r.sequence_id for r in rows)))
    memory = packing.packed_in_file_order(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    packed_ok(memory)
    assert sum(r.length for r in memory) == sum(r.length for r in rows)


def test_histogram_packs_everything():
    g = np.random.default_rng(2)
    for _ in range(20):
        histogram = {int(k): int(v) for k, v in zip(g.integers(1, 100, 40), g.integers(1, 50, 40))}
        used = {}
        for pattern, times in packing.pack_histogram(histogram, 100):
            assert sum(pattern) <= 100 and times > 0
            for x in pattern:
                used[x] = used.get(x, 0) + times
        assert used == histogram


def test_token_counts(spark, odd, none, sample):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_cache.model_path())
    path = store.fresh_path(spark, "cache")
    for docs in (sample, odd, odd, none):
        rows = token_cache.count_tokens(docs, path).collect()
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in docs.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)
    cache = spark.read.parquet(path)
    distinct = {r.text or "" for d in (sample, odd) for r in d.select("text").collect()}
    assert cache.count() == cache.select("digest").distinct().count() == len(distinct)  # each distinct text was encoded once


def test_cache_lasts_and_only_misses_are_encoded(spark, odd, none, tmp_path):
    path, model = str(tmp_path / "cache"), token_cache.model_path()
    docs = spark.createDataFrame([(i, f"text number {i % 7}") for i in range(30)], "doc_id long, text string")
    version = token_cache.tokenizer_digest(model)
    first = sorted(token_cache.count_tokens(docs, path).collect())
    held = lambda: {bytes(r.digest): r.n_tokens for r in token_cache.open_cache(spark, path, version).collect()}
    assert len(held()) == 7
    # counts that the cache holds are believed, so nothing known is encoded again
    doubled = token_cache.open_cache(spark, path, version).selectExpr("digest", "n_tokens * 100 AS n_tokens").collect()
    spark.createDataFrame(doubled, token_cache.COUNTS).write.mode("overwrite").parquet(f"{path}/tokenizer={version}")
    more = docs.unionByName(spark.createDataFrame([(99, "a new one")], "doc_id long, text string"))
    again = {r.doc_id: r for r in token_cache.count_tokens(more, path).collect()}
    assert [again[r.doc_id].n_tokens for r in first] == [100 * r.n_tokens for r in first] and again[99].n_tokens < 100
    assert len(held()) == 8
    spark.createDataFrame([(b"x", 5)], token_cache.COUNTS).write.parquet(f"{path}/tokenizer=other")
    assert len(held()) == 8 and token_cache.count_tokens(none, path).count() == 0
    assert token_cache.count_tokens(odd, path).count() == odd.count()
