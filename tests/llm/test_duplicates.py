"""Exact and near duplicates, fingerprints and components against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm import chunk_dedup, components, dart_minhash, kernels, queries
from tests.llm.conftest import DOCS, ODD


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def check_exact(rows, docs):
    groups = {}
    for d in docs:
        groups.setdefault(bare(d[1]), []).append(d)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in rows)
    want = []
    for key, members in groups.items():
        order = lambda d: (-len(d[1] or ""), d[0] is None, d[0] or 0)
        best = min(members, key=order)
        want += [(str(d[0]), str(best[0]), len(members), order(d) == order(best), hashlib.sha256(key.encode()).hexdigest()) for d in members]
    assert got == sorted(want)


def test_one_id_with_two_spacings_keeps_the_longer_text(spark):
    docs = [(5, "a b c", "en", "s", 5), (5, "abc", "en", "s", 3), (7, "a bc", "en", "s", 4), (None, "a b  c", "en", "s", 6), (None, "abc", "en", "s", 3), (8, "x y", "en", "s", 3), (None, "xy", "en", "s", 2), (8, "x\ty", "en", "s", 3)]
    check_exact(chunk_dedup.duplicate_groups(spark.createDataFrame(docs, DOCS)).collect(), docs)
    check_exact(chunk_dedup.duplicate_groups(spark.createDataFrame(docs[:3], DOCS)).collect(), docs[:3])


def test_exact_odd_rows(spark, odd, none):
    check_exact(chunk_dedup.duplicate_groups(odd).collect(), ODD)
    assert chunk_dedup.duplicate_groups(none).count() == 0


def test_exact_long_and_spaced_copies(spark):
    g = random.Random(0)
    base = ["".join(g.choice("abc. ,\n") for _ in range(n)) for n in (10, 3000, 20_000, 60_000)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(base + [" " + t.replace("a", "a ") for t in base] + [t + "x" for t in base] + base)]
    check_exact(chunk_dedup.duplicate_groups(spark.createDataFrame(docs, DOCS)).collect(), docs)


def cut(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [list(r.c) for r in rows.select("i", chunk_dedup.chunks(chunk_dedup.normalised(F.col("t"))).alias("c")).orderBy("i").collect()]


def test_chunks_cover_the_text(spark):
    texts = ["ab." * 2000 + "c" * 20_000 + "d", "漢字かな😀" * 3000, "\x00é" * 1000, "x"]
    for text, parts in zip(texts, cut(spark, *texts)):
        assert "".join(parts).encode("latin-1").decode() == text and max(map(len, parts)) <= chunk_dedup.MAX_CHUNK
        assert all(len(p) >= chunk_dedup.MIN_CHUNK for p in parts[:-1])


def test_an_insertion_changes_few_chunks(spark):
    """In texts without any punctuation, in two scripts."""
    g = random.Random(8)
    for letters in ("abcdefghijklmnopqrstuvwxyz", [chr(0x4E00 + i) for i in range(2000)]):
        text = "".join(g.choice(letters) for _ in range(60_000))
        other = text[:20_000] + "XYZ" + text[20_000:]
        a, b = cut(spark, text, other)
        assert len(a) > 20 and len(set(a) - set(b)) <= 3 and len(set(b) - set(a)) <= 3


def test_exact_extreme_ids_and_clashing_identifiers(spark):
    least, most = -(1 << 63), (1 << 63) - 1
    docs = [(least, "a b", "en", "s", 3), (most, "ab ", "en", "s", 3), (None, "a  b", "en", "s", 4), (None, "x", "en", "s", 1), (most, " x", "en", "s", 2), (0, "x ", "en", "s", 2), (least, "y", "en", "s", 1), (1, "y", "en", "s", 1)]
    check_exact(chunk_dedup.duplicate_groups(spark.createDataFrame(docs, DOCS)).collect(), docs)
    cut = chunk_dedup.chunked(spark.createDataFrame(docs, DOCS))
    rows = cut.select("doc_id", "text_sha256", F.array(F.lit(b"same")).alias("recipe"))
    apart = chunk_dedup.told_apart(rows, cut, spark.createDataFrame([(b"same",)], "digest binary"))
    assert apart.select("recipe").distinct().count() == 3 and apart.count() == len(docs)


def test_exact_plan_is_native(spark, sample):
    out = chunk_dedup.duplicate_groups(sample)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def weighted_jaccard(a, b):
    common = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


def brute_classes(docs, least=0.8):
    sets, up = [shingles(t) for _, t in docs], list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if docs[i][0] == docs[j][0] or weighted_jaccard(sets[i], sets[j]) >= least:
            a, b = sorted((top(i), top(j)))
            up[b] = a
    out = {}
    for i in range(len(docs)):
        out.setdefault(top(i), []).append(docs[i][0])
    return {d: min(m) for m in out.values() for d in m}


def near_family(g, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(g.randint(*edits)):
            w[g.randrange(len(w))] = f"new{g.random()}"
        out.append(" ".join(w))
    return out


def test_near_classes_match_brute_force(spark):
    g = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(g.choice(words) for _ in range(n)) for n in (60, 150, 150, 400)]
    texts = [*base, *near_family(g, base[1], 90, (1, 4)), *near_family(g, base[3], 10, (1, 12)), "one two three", "one two three", "One, two! three", *["tick tock " * 40] * 2, "tick tock " * 41]
    texts += [" ".join(g.choice(words) for _ in range(80)) for _ in range(40)]
    docs = [(i * 3, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicate_classes(spark.createDataFrame(docs, DOCS).repartition(3)).collect()}
    assert got == brute_classes([(d[0], d[1]) for d in docs])


def test_near_odd_rows(spark, odd, none):
    rows = dart_minhash.near_duplicate_classes(odd).collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(ODD) and got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, None: None, 7: 7, 8: 8, 9: 9}
    assert dart_minhash.near_duplicate_classes(none).count() == 0


def test_near_null_ids_among_copies(spark):
    g = random.Random(6)
    text, other = (" ".join(f"{k}{g.randrange(10**6)}" for _ in range(120)) for k in "ab")
    near, far = near_family(g, text, 1, (1, 1))[0], near_family(g, other, 1, (1, 1))[0]
    docs = [(None, text), (5, text), (6, text), (9, near), (None, other), (None, other), (None, far), (None, "..."), (None, "..."), (3, "...")]
    rows = dart_minhash.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    got = Counter((r.doc_id, r.class_id, r.kept) for r in rows)
    assert got == {(None, 5, False): 1, (5, 5, True): 1, (6, 5, False): 1, (9, 5, False): 1, (None, None, True): 3, (None, None, False): 2, (3, 3, True): 1}


def test_op8_query(spark, sample):
    docs = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in queries.op8_dart_minhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute_classes(docs)


def test_signatures_estimate_weighted_jaccard():
    g = np.random.default_rng(1)
    elements = g.integers(0, 2**63, 200).astype(np.uint64)
    a = g.uniform(0.1, 3, 200)
    for share in (0.1, 0.4, 0.8):
        b = np.where(g.random(200) < share, g.uniform(0, 3, 200), a)
        keep = np.concatenate([a, b]) > 0
        cells, rows, covered = dart_minhash.regions(np.tile(elements, 2)[keep], np.concatenate([a, b])[keep], np.repeat([0, 1], 200)[keep])
        s = dart_minhash.dart_signatures(cells, rows, 2, 4096, covered)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - true) < 5 * np.sqrt(true * (1 - true) / 4096) + 1e-9
    one = dart_minhash.dart_signatures(np.array([7], np.uint64), np.array([1]), 3, 120)
    assert (one[1] != 0).all() and (one[[0, 2]] == 0).all()


def test_word_hashes_match_a_plain_split():
    texts = ["The cat, the CAT", "", "été_1 x", "  ", "a" * 300 + " b"]
    hashes, counts = kernels.word_hashes(texts)
    words = [re.findall(r"[0-9a-z_\x80-\U0010ffff]+", t.lower()) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for x in words for w in x]
    assert [flat[i] == flat[j] for i in range(len(flat)) for j in range(len(flat))] == [bool(hashes[i] == hashes[j]) for i in range(len(flat)) for j in range(len(flat))]


def test_components(spark):
    g = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(g.randrange(200, 300), g.randrange(200, 300)) for _ in range(70)] + [(1000, 1000 + i) for i in range(50)]
    up = {}
    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {r.node: r.label for r in components.smallest_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in {n for a, b in edges if a != b for n in (a, b)}}
    assert components.smallest_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overlaps():
    g = np.random.default_rng(0)
    lists = [g.choice(9000, n, replace=False).astype(np.int32) for n in (1, 50, 3000, 8000)]
    out = dart_minhash.overlaps(lists)
    assert all(out[i, j] == len(set(lists[i]) & set(lists[j])) for i in range(4) for j in range(4))


def test_links_are_contracted_in_tasks(spark, monkeypatch):
    """A table that fits one share is settled without star rounds; of several shares, each task hands on stars, and labels are the same."""
    g = random.Random(2)
    edges = [(i, i + 1) for i in range(400) if i % 50] + [(g.randrange(1000, 1400), g.randrange(1000, 1400)) for _ in range(200)] + [(7, 7)]
    links = spark.createDataFrame(edges, "a long, b long").repartition(5)
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges[:-1]:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    want = {i: top(i) for i in up if top(i) != i or any(top(j) == i for j in up if j != i)}
    rounds, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda now, large: rounds.append(large) or star(now, large))
    labels = lambda: {r.node: r.label for r in components.smallest_labels(links).collect()}
    assert labels() == want and not rounds
    monkeypatch.setattr(components, "LINKS_PER_TASK", 90)
    assert labels() == want and rounds
