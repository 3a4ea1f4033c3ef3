"""The pipeline and each of its stages, row by row, against plain Python on rows with null, shared and repeated ids."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import mixing, quality, stages, store
from tests.llm.conftest import DOCS, ODD
from tests.llm.test_duplicates import bare, brute_classes, near_family
from tests.llm.test_token_files import direct, packed_ok


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of the smallest tables, odd rows, and copies under null, shared and other ids; in file order of no meaning."""
    sf, made = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("sf"))
    g = random.Random(2)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()]
    long = [r for r in rows if len((r[1] or "").split()) > 60][:8]
    rows += ODD + ODD[:3]
    rows += [(None, long[0][1], "en", "a", 1), (None, long[0][1] + " ", "en", "a", 1), (long[0][0], long[0][1], "en", "a", 1), (long[1][0], "another text under a shared id", "en", None, 1)]
    rows += [(None if i % 2 else 10**6 + i, t, "en", "b", 1) for i, t in enumerate(near_family(g, long[2][1], 4, (0, 1)))]
    rows += [(None, f"no id {i} at all", "en", "hot", 1) for i in range(20)]
    frame = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(1) for n in ("_row", "_time", "_file", "_take", "label", "size")})
    frame.repartition(5).write.parquet(f"{made}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{made}/labels.parquet")
    return made


def rows_of(df):
    return [tuple(r) for r in df.select(stages.COLUMNS).collect()]


def same(got, want):
    assert Counter(map(str, got)) == Counter(map(str, want))


def text_order(d):
    return (d[0] is None, d[0] or 0)


def plain_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(bare(r[1]), []).append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), *text_order(r))) for g in groups.values()]


def plain_near(rows):
    """Copies of one id or none are told apart by their place in the list."""
    classes = brute_classes([(i, r[1]) for i, r in enumerate(rows)])
    groups = {}
    for i, r in enumerate(rows):
        # a wordless text goes with its own id only
        wordless = not re.search(r"\w", r[1] or "")
        groups.setdefault(("id", r[0]) if wordless and r[0] is not None else classes[i], []).append(r)
    return list(groups.values())


def check_near(got, rows):
    groups = plain_near(rows)
    best = [min(map(text_order, g)) for g in groups]
    assert len(got) == len(groups)
    left = Counter(map(str, got))
    for g, b in zip(groups, best):
        fits = [str(r) for r in g if text_order(r) == b]
        hit = next(f for f in fits if left[f] > 0)
        left[hit] -= 1


def readings(mixed):
    """(doc_id, size) of each reading of which half or more is taken, in order of time."""
    return [(r.doc_id, r.size) for r, t in sorted(((r, t) for r in mixed for t in r.takes), key=lambda x: x[1].time) if 2 * t.words >= r.size]


def test_each_stage_on_shared_null_and_repeated_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = rows_of(docs)
    scored = quality.quality_scores(docs.withColumn("_row", F.monotonically_increasing_id()), spark.read.parquet(f"{folder}/labels.parquet"), key="_row")
    good = {r.text: r.predicted for r in docs.withColumn("_row", F.monotonically_increasing_id()).select("text", "_row").join(scored.select("_row", "predicted"), "_row").collect()}
    now = store.written(stages.quality_stage(spark, docs, folder), "t")
    assert now.columns == stages.COLUMNS
    same(rows_of(now), [r for r in before if good[r[1]]])

    for at in (docs, now):  # on its predecessor's rows and on all
        same(rows_of(stages.exact_dedup_stage(spark, at, folder)), plain_exact(rows_of(at)))
        check_near(rows_of(stages.near_dedup_stage(spark, at, folder)), rows_of(at))

    mixed = mixing.mixture(docs).collect()
    out = store.written(stages.mixing_stage(spark, docs, folder), "t")
    assert out.columns == stages.COLUMNS
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = rows_of(out)
    assert Counter((str(r[0]), size(r[1])) for r in got) == Counter((str(d), n) for d, n in readings(mixed))
    assert set(map(str, got)) <= set(map(str, before))
    words, largest, target = Counter(), Counter(), {}
    for r in got:
        words[r[3]] += size(r[1])
    for r in mixed:
        target[r.source], largest[r.source] = r.target, max(largest[r.source], r.size)
    assert all(abs(words[s] - target[s]) <= largest[s] / 2 + 1 for s in target), (words, target)

    packed = stages.packing_stage(spark, docs, folder).collect()
    packed_ok(packed)
    assert sum(r.length for r in packed) == sum(len(i) + 1 for i in direct([r[1] for r in before]))


def test_training_time_reaches_the_sequences(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = store.fresh_path(spark, "mixed")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = store.written_to(stages.mixing_stage(spark, docs, folder), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    from tapeloom.llm import packing

    rows = packing.packed_in_file_order(mixed, window_tokens=1).collect()
    files = packing.in_file_order(mixed).groupBy("_file").agg(F.collect_set("doc_id").alias("ids")).orderBy("_file").collect()
    assert len(files) > 1
    only = [set(f.ids) - set().union(*[set(o.ids) for o in files if o is not f]) for f in files]
    spans = [[r.sequence_id for r in rows if r.doc_id in ids] for ids in only]
    spans = [s for s in spans if s]
    assert all(max(a) < min(b) for a, b in zip(spans, spans[1:]))


def test_stages_on_an_empty_table(spark, folder, none):
    for _, stage in pytest.importorskip("corpus_pipeline").STAGES:
        assert stage(spark, none, folder).count() == 0


def test_run(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = store.written(stage(spark, docs, folder), "stage")
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in got) == Counter((r.doc_id, r.start, r.ids_crc32) for r in docs.collect()) and got
    assert {r.sequence_id for r in got} == {r.sequence_id for r in docs.collect()}


def test_stages_chained_without_writing_between(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = stages.quality_stage(spark, docs, folder)
    both = stages.exact_dedup_stage(spark, first, folder)
    stages.near_dedup_stage(spark, docs, folder)  # called only
    want = plain_exact(rows_of(store.written(first, "t")))
    same(rows_of(both), want)
    same(rows_of(both.where("length(text) > 5")), [r for r in want if len(r[1] or "") > 5])
    assert first.count() >= both.count() > 0


def test_two_pipelines_in_one_session_and_one_that_fails(spark, folder, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    one = corpus_pipeline.run(spark, folder)
    two = corpus_pipeline.run(spark, folder)
    assert one.count() == two.count() > 0
    one = two = None
    left = store.reclaim(spark, collect=True)

    def broken(spark, docs, sf_dir):
        raise RuntimeError("midway")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("broken", broken)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, folder)
    assert store.reclaim(spark, collect=True) <= left


def test_tables_go_when_nothing_reads_them(spark):
    fs = spark._jvm.org.apache.hadoop.fs
    there = lambda path: fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs.Path(path))
    table = store.written(spark.range(10), "kept")
    path = table.inputFiles()[0].rpartition("/")[0]
    derived = table.where("id > 4").groupBy().count()
    table = None
    store.reclaim(spark, collect=True)
    assert there(path) and derived.first()[0] == 5
    derived, before = None, store.reclaim(spark, collect=True)
    for _ in range(8):
        store.written(spark.range(5), "other").count()
    assert store.reclaim(spark, collect=True) <= before + 3  # the driver holds on to the last plans that it made
