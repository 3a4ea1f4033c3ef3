"""The edit embedding against a walk that goes character by character and time by time."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tapeloom.llm import edit_embedding, queries
from tests.llm.conftest import DOCS, ODD

MASK = (1 << 64) - 1


def mixed(x):
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


_BITS = {}


def moves(kind, time):
    time %= 4096
    if (kind, time) not in _BITS:
        _BITS[kind, time] = time == 4095 or mixed(kind * 4096 + time + (1 << 40)) >> 63 == 1
    return _BITS[kind, time]


def embedding(text):
    """The kind of the character stood on at each time."""
    out, at = [], 0
    kinds = [((ord(c) * 0x9E3779B97F4A7C15) & MASK) >> 56 for c in text]
    while at < len(kinds):
        out.append(kinds[at])
        at += moves(kinds[at], len(out) - 1)
    return out


def sample_times(level):
    low, wide = (0, 256) if level == 0 else (128 << level, 128 << level)
    times = [low + int((k + (mixed(k + 1000 * level) >> 11) * 2.0**-53) * (wide / 64)) for k in range(64)]
    return times if level else [0, *times[1:]]


def fingerprint(text):
    walked, out, level = embedding(text), "", 0
    while walked and (level == 0 or 128 << level < len(walked)):
        out += "".join("0123456789abcdef"[walked[t] & 15] if t < len(walked) else "-" for t in sample_times(level))
        level += 1
    return out


def likeness(a, b):
    """Equal samples over samples that either text reaches, each weighted by the times it stands for."""
    if not a or not b:
        return float(a == b)
    right = all_ = 0.0
    for k in range(max(len(a), len(b))):
        x, y = (v[k] if k < len(v) else "-" for v in (a, b))
        weight = 256 if k < 64 else 128 << k // 64
        right += weight * (x == y != "-")
        all_ += weight * (x != "-" or y != "-")
    return right / all_


def order(d):
    tie = xxhash.xxh64_intdigest((d[1] or "").encode(), 42)
    return (d[0] is None, -(d[0] or 0), tie - (1 << 64) if tie >> 63 else tie)


def check(rows, docs):
    docs = sorted(docs, key=order)
    want = []
    for k, (doc_id, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        marks = [fingerprint(t) for t in (text, edited, after)]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], round(likeness(*marks[:2]), 9), round(likeness(marks[0], marks[2]), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_op4_query_against_the_naive_walk(spark, sample):
    rows = queries.op4_edit_embedding(spark, "/root/testdata/sf0.001").collect()
    check(rows, [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()])
    assert np.mean([r.near_edited for r in rows]) > 0.6 > 0.2 > np.mean([r.near_next for r in rows])


def test_odd_rows(spark, odd, none):
    for per in (2, 500):
        check(edit_embedding.edit_fingerprints(odd, rows_per_bucket=per).collect(), [(d[0], d[1]) for d in ODD])
    assert edit_embedding.edit_fingerprints(none).count() == 0
    one = spark.createDataFrame([(7, "alone")], "doc_id long, text string")
    check(edit_embedding.edit_fingerprints(one).collect(), [(7, "alone")])


def test_extreme_and_crowded_ids(spark):
    g = random.Random(9)
    ids = [-(1 << 63), -(1 << 63) + 1, (1 << 63) - 1, (1 << 63) - 2, 0, 1 << 53, (1 << 53) + 1]
    docs = [(i, f"text of {i} " * 9) for i in ids] + [(None, f"{g.random()}") for _ in range(60)] + [(5, f"{g.random()}") for _ in range(60)] + [(i, f"{g.random()}") for i in range(10, 70)]
    docs += [(5, "same"), (5, "same"), (1, "same"), (1, "same")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check(edit_embedding.edit_fingerprints(frame, rows_per_bucket=4).collect(), docs)
    tied = edit_embedding._in_buckets(frame.selectExpr("doc_id", "text", "xxhash64(text) AS _tie"), len(docs), 4)
    assert max(r["count"] for r in tied.groupBy("_bucket").count().collect()) < 30


def test_walks_side_by_side():
    g = np.random.default_rng(0)
    kinds = [g.integers(0, 256, n).astype(np.uint8) for n in [0, 1, 5000, *g.integers(0, 300, 150)]]
    begin = g.integers(0, 9000, len(kinds))
    out = edit_embedding.walks(np.concatenate(kinds), np.array([len(k) for k in kinds]), begin)
    at = 0
    for k, t in zip(kinds, begin.tolist()):
        for x in k.tolist():
            while not moves(x, t):
                t += 1
            t += 1
            assert out[at] == t
            at += 1


def test_likenesses():
    g = random.Random(1)
    marks = [fingerprint("".join(g.choice("ab cd") for _ in range(n))) for n in (3, 40, 41, 200, 900, 905, 3000)]
    table = edit_embedding.likenesses(marks)
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            assert abs(table[i, j] - likeness(a, b)) < 1e-12 and abs(edit_embedding.likeness(a, b) - likeness(a, b)) < 1e-12
    assert edit_embedding.likeness("", "") == 1 and edit_embedding.likeness("", marks[0]) == 0


def edited(g, text, edits):
    for _ in range(edits):
        at, kind = g.randrange(len(text)), g.random()
        text = text[:at] + ("" if kind < 0.3 else g.choice("abcdefghij klmno.")) + text[at + (kind < 0.7) :]
    return text


def test_recall_of_similar_classes(spark):
    """Of pairs of likeness 0.8 or more, nearly all share a band; classes are those of brute force over the pairs that do."""
    g = random.Random(4)
    found = met = 0
    for n in (20, 60, 130, 300, 900, 2000, 5000):
        for _ in range(60):
            text = "".join(g.choice("abcdefghij klmno.") for _ in range(g.randint(n, 2 * n)))
            a, b = edit_embedding.fingerprints([text, edited(g, text, g.randint(1, max(1, n // 60)))])
            if likeness(a, b) >= 0.8:
                met += 1
                found += bool(set(edit_embedding.band_keys(a)) & set(edit_embedding.band_keys(b)))
    assert met > 150 and found >= 0.99 * met, (met, found)


def test_similar_fingerprints(spark, none):
    g = random.Random(4)
    texts = ["".join(g.choice("abcdefghij klmno.") for _ in range(900)) for _ in range(6)]
    family = ["".join(g.choice("abcdefghij klmno.") for _ in range(700))]
    family += [edited(g, family[0][:-60], 0) + "".join(g.choice("xyz") for _ in range(60)) for _ in range(80)]
    texts += [texts[0][:880] + "ZZ" + texts[0][882:], texts[0], "", None, *family]
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[1], "en", "s", 0), (None, "quite alone in the world", "en", "s", 0)]
    rows = edit_embedding.similar_classes(edit_embedding.text_fingerprints(spark.createDataFrame(docs, DOCS).repartition(3))).collect()
    got = {(r.doc_id, r.class_id) for r in rows}
    assert len(rows) == len(docs) and got >= {(0, 0), (1, 1), (2, 2), (5, 5), (6, 0), (7, 0), (8, 8), (9, 8), (None, 1), (None, None)}
    assert {c for d, c in got if d is not None and d > 9} == {10}
    assert edit_embedding.similar_classes(edit_embedding.text_fingerprints(none)).count() == 0


def test_classes_of_the_sample(spark, sample):
    """Every pair that shares a band and is alike is in one class, and classes hang together by such pairs."""
    docs = [(r.doc_id, r.text or "") for r in sample.select("doc_id", "text").collect()]
    marks = edit_embedding.fingerprints([t for _, t in docs])
    keys, up = [set(edit_embedding.band_keys(m)) if m else {""} for m in marks], list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if marks[i] == marks[j] or (keys[i] & keys[j] and likeness(marks[i], marks[j]) >= 0.8):
                up[max(top(i), top(j))] = min(top(i), top(j))
    want = {}
    for i, (d, _) in enumerate(docs):
        want.setdefault(top(i), []).append(d)
    got = {r.doc_id: r.class_id for r in queries.edit_embedding_classes(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: min(m) for m in want.values() for d in m}


def test_marks_turn_away_no_pair_that_is_alike(spark):
    """The bound holds for all pairs, and turns away nearly all that share a band but are not alike."""
    g = random.Random(7)
    texts = []
    for n in (3, 30, 90, 128, 200, 500, 900, 1800, 4000):
        for _ in range(5):
            text = "".join(g.choice("abcdefghij klmno.") for _ in range(g.randint(n, 2 * n)))
            texts += [text, edited(g, text, max(1, n // 40)), text[: int(len(text) * g.uniform(0.7, 1))]]
    marks = edit_embedding.fingerprints(texts)
    rows = spark.createDataFrame([(i, m, edit_embedding.mark_of(m)) for i, m in enumerate(marks)], f"i long, f string, mark {edit_embedding.MARK}")
    other = rows.toDF("j", "g", "other")
    for least in (0.5, 0.8, 0.95):
        kept = {(r.i, r.j) for r in rows.crossJoin(other).where(edit_embedding.may_be_alike(least)(F.col("mark"), F.col("other"))).select("i", "j").collect()}
        alike = {(i, j) for i in range(len(marks)) for j in range(len(marks)) if likeness(marks[i], marks[j]) >= least}
        assert alike <= kept
        assert len(kept) < len(alike) + 0.1 * (len(marks) ** 2 - len(alike)) or least < 0.8


def test_fingerprints_are_fetched_for_likely_pairs_only(spark, sample, monkeypatch):
    g = random.Random(3)
    texts = ["".join(g.choice("ab") for _ in range(g.randint(300, 600))) for _ in range(150)]
    marks = edit_embedding.fingerprints(texts)
    keys = [set(edit_embedding.band_keys(m)) for m in marks]
    met = sum(bool(keys[i] & keys[j]) for i in range(len(marks)) for j in range(i))
    seen, plain = [], edit_embedding.components.linked_classes

    def noted(members, similar, *more, **named):
        def counted(pairs):
            seen.append(pairs.count())
            return similar(pairs)

        return plain(members, counted, *more, **named)

    monkeypatch.setattr(edit_embedding.components, "linked_classes", noted)
    rows = spark.createDataFrame(list(enumerate(marks)), "doc_id long, fingerprint string")
    assert edit_embedding.similar_classes(rows).count() == len(texts)
    assert met > 1000 and sum(seen) < met / 20
