import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import merkle, mixing, quality, queries
from tests.llm.conftest import DOCS, ODD

# --- quality ----------------------------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    got = queries.op3_discriminant_quality(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id")["quality"]
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in got["held_out"].items())
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    unseen = got[got["held_out"]].join(labels, how="inner")
    assert (unseen["predicted"] == unseen["quality"]).mean() > 0.95


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_model_against_numpy(spark):
    g = np.random.default_rng(0)
    x = g.normal(0, 1, (300, len(quality.FEATURES))) @ g.normal(0, 1, (len(quality.FEATURES),) * 2)
    y = (x[:, 0] > 0).astype(int)
    model = quality.fit(spark.createDataFrame([(int(t), r.tolist()) for r, t in zip(x, y)], "label int, x array<double>").repartition(5), shrink=0.1, ridge=0.0)
    pooled = sum(np.cov(x[y == k].T) * ((y == k).sum() - 1) for k in (0, 1)) / 298
    dens = []
    for k in (0, 1):
        c = 0.9 * np.cov(x[y == k].T) + 0.1 * pooled + 1e-6 * np.eye(x.shape[1])
        d = x - x[y == k].mean(0)
        dens.append(np.log((y == k).mean()) - 0.5 * (np.linalg.slogdet(c)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)))
    np.testing.assert_allclose(model.scores(x), 1 / (1 + np.exp(-np.clip(dens[1] - dens[0], -35, 35))), rtol=1e-6, atol=1e-9)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, 0), (7, 0), (8, None), (None, 1)], "doc_id long, quality int")
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    unlabelled = quality.quality_scores(odd, labels.where("false")).collect()
    assert len(unlabelled) == len(ODD) and all((r.score, r.predicted) == (0.5, 1) for r in unlabelled)
    for quality_, score in ((0, 0.0), (1, 1.0)):
        one = quality.quality_scores(odd, labels.where("quality is not null").withColumn("quality", F.lit(quality_))).collect()
        assert all(abs(r.score - score) < 1e-6 and r.predicted == quality_ for r in one)
    assert quality.quality_scores(none, labels).count() == 0


# --- mixing -----------------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3.0, 1.0, 2.0)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check_mix(rows, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for d in docs:
        total[d[3]] += size(d[1])
    target, taken = brute_targets(total), defaultdict(int)
    assert Counter((str(r.doc_id), r.size) for r in rows) == Counter((str(d[0]), size(d[1])) for d in docs)
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9) and 0 <= r.taken <= 2 * r.size
        assert sum(t.words for t in r.takes) == r.taken and all(0 <= t.time <= 1 for t in r.takes)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_mixing_odd_rows(spark, odd, none):
    check_mix(mixing.mixture(odd).collect(), ODD)
    assert mixing.mixture(none).count() == 0


def test_mixing_hot_source_and_repeatability(spark):
    docs = [(i, "w " * (i % 40), "en", None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}", 0) for i in range(3000)]
    frame = spark.createDataFrame(docs, DOCS)
    a = mixing.mixture(frame, cell_rows=100).collect()
    check_mix(a, docs)
    b = mixing.mixture(frame.repartition(7), cell_rows=100).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    times = [r.position for r in mixing.curriculum(mixing.mixture(frame)).collect() if r.position is not None]
    assert times == sorted(times)


def test_mixing_crowded_id(spark):
    """Rows without an id are dealt to many cells, and each source's words come near its target within one document."""
    docs = [(None if i % 2 else i, f"w{i} " * (1 + i % 40), "en", "hot" if i % 3 else f"s{i % 7}", 0) for i in range(3000)]
    frame = spark.createDataFrame(docs, DOCS).repartition(4)
    mixed = mixing.mixture(frame, cell_rows=100)
    check_mix(mixed.collect(), docs)
    slices = frame.select((F.conv(F.substring(mixing._digest(), 1, 8), 16, 10).cast("long") * 256 / (1 << 32)).cast("int").alias("s")).groupBy("s").count()
    assert slices.agg(F.max("count")).first()[0] < 40


def test_due_time_inverts_the_schedule(spark):
    for tilt in (0.5, -0.5, 0.0):
        rows = spark.range(101).select((F.col("id") / 100).alias("share"), mixing.due_time(F.col("id") / 100, F.lit(tilt)).alias("t")).collect()
        assert all(abs((1 + tilt) * r.t - tilt * r.t**2 - r.share) < 1e-9 for r in rows)


# --- fixity -----------------------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def pages(n=700):
    return [(i * 3 - 50, f"http://h/{i}", f"<p>{'x' * (i % 90)}{i}</p>") for i in range(n)]


def damage(spark, a, b):
    rows = merkle.audit(spark.createDataFrame(a, PAGES).repartition(3), spark.createDataFrame(b, PAGES).repartition(5)).collect()
    return {(r.page_id, r.status) for r in rows}


def test_audit_finds_each_damage(spark):
    a = pages()
    b = [list(r) for r in a]
    b[10][2] += "!"
    b[300][1] = None
    b.append(b[20])
    b.append((100_000, "new", "page"))
    del b[500]
    assert damage(spark, a, b) == {(a[10][0], "altered"), (a[300][0], "altered"), (a[20][0], "repeated"), (100_000, "extra"), (a[500][0], "missing")}
    assert damage(spark, a, a[::-1]) == set()


def test_audit_odd_rows(spark):
    a = [(None, "u", "h"), (1, None, None), (1, None, None), (2, "", "x" * 200_000), (-5, "u", "h"), (10**12, "far", "h")]
    assert damage(spark, a, a) == set()
    assert damage(spark, a, a[1:]) == {(None, "missing")}
    assert damage(spark, a, []) == {(None, "missing"), (1, "missing"), (2, "missing"), (-5, "missing"), (10**12, "missing")}
    assert damage(spark, [], []) == set()


def test_audit_tells_every_record_of_an_id(spark):
    a = [(None, "u", f"null {i}") for i in range(9)] + [(1, "u", "x"), (1, "u", "y"), (2, "u", "x"), (2, "u", "y"), (3, "u", "x"), (3, "u", "z")]
    b = [(None, "u", f"null {i}" + "!" * (i < 5)) for i in range(6)] + [(1, "u", "x"), (1, "u", "v"), (1, "u", "w"), (2, "u", "x"), (2, "u", "w"), (3, "u", "x"), (3, "u", "x")]
    rows = merkle.audit(spark.createDataFrame(a, PAGES).repartition(3), spark.createDataFrame(b, PAGES).repartition(5)).collect()
    assert Counter((r.page_id, r.status) for r in rows) == {(None, "missing"): 8, (None, "extra"): 5, (1, "missing"): 1, (1, "extra"): 2, (2, "altered"): 1, (3, "repeated"): 1, (3, "missing"): 1}
    assert len({(r.primary_sha256, r.replica_sha256) for r in rows}) == len(rows)
    assert all((r.primary_copies, r.replica_copies) == {"missing": (1, 0), "extra": (0, 1), "altered": (1, 1), "repeated": (1, 2)}[r.status] for r in rows)


def test_leaf_hashes_are_of_ordered_lists(spark):
    """Sets of records whose hashes have equal sums, the same records under other ids, and other numbers of copies have different leaves."""
    row = lambda i, h, copies=1: (i, 0, f"{h:064x}", 5, copies)
    sets = [[row(1, 1), row(2, 3)], [row(1, 2), row(2, 2)], [row(1, 3), row(2, 1)], [row(1, 1), row(1, 3)], [row(1, 1, 2), row(2, 3)], [row(1, 1), row(2, 3, 2)]]
    hashes = [[r.hash for r in merkle.leaves(spark.createDataFrame(s, "page_id long, leaf long, sha256 string, n_bytes long, copies long").repartition(2)).collect()] for s in sets]
    assert all(len(h) == 1 for h in hashes) and len({h[0] for h in hashes}) == len(sets)


def test_audit_extreme_ids_and_clashing_columns(spark):
    least, most = -(1 << 63), (1 << 63) - 1
    ids = [least, least + 1, -(1 << 62), -1, 0, (1 << 53) + 1, most - 1, most, None]
    frame = spark.createDataFrame([(i, "u", f"h{i}") for i in ids], PAGES)
    frame = frame.withColumns({n: F.lit(1) for n in ("leaf", "sha256", "node", "hash", "copies", "n_bytes", "share", "up", "_id")})
    lost, spoiled = F.col("page_id").isin(*ids[1:-1:2]), F.col("page_id").isin(*ids[:-1:2]) | F.col("page_id").isNull()
    other = frame.where(F.col("page_id").isNull() | ~lost).withColumn("html", F.when(spoiled, "other").otherwise(F.col("html")))
    got = {(r.page_id, r.status) for r in merkle.audit(frame, other).collect()}
    assert got == {(i, "missing" if k % 2 else "altered") for k, i in enumerate(ids)}


def test_ranges_and_descent(spark):
    a = pages(300)
    b = [r if r[0] != a[40][0] else (r[0], r[1], "z") for r in a]
    (row,) = merkle.audit(spark.createDataFrame(a, PAGES), spark.createDataFrame(b, PAGES)).collect()
    size = lambda r: len(f"{r[0]}\n{r[1]}\n{r[2]}")
    leaf = a[40][0] // merkle.LEAF
    assert row.range_start == sum(size(r) for r in a if r[0] // merkle.LEAF < leaf)
    assert row.range_end - row.range_start == sum(size(r) for r in a if r[0] // merkle.LEAF == leaf)
