"""The filter audit against applying the filters one after another, order by order."""

import re
from itertools import permutations

from tapeloom.llm import filter_audit, queries
from tests.llm.conftest import DOCS, ODD

LABELS = "doc_id long, quality int, toxic int"


def failures(docs):
    low = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            low[text] = min(low.get(text, doc_id), doc_id)
    out = []
    for doc_id, text, part in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": bool(set(text) & set("#$%&*|")), "E": doc_id is not None and doc_id > low[text]}
        out.append((doc_id, part, {k for k, v in fails.items() if v}))
    return out


def plain(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    docs, rows = failures([(i, t or "", s or "") for i, t, s in docs]), {}
    for part in {p for _, p, _ in docs}:
        own, total = [d for d in docs if d[1] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                gone, stay = [d for d in left if x in d[2]], [d for d in left if x not in d[2]]
                fails = [d for d in own if x in d[2]]
                rows[part, order, k + 1] = [len(stay), len(gone), len(fails) - len(gone), sum(d[2] == {x} for d in own), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
                total[x] += len(gone)
                left = stay
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                rows[part, order, k + 1].append(total[x])
    return rows


def check(found, docs, labels):
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in found} == plain(docs, labels)


def test_defined_cases(spark, odd, none):
    labels = [(1, 1, 0), (2, 1, 1), (5, 0, 1), (5, 1, None), (None, 1, 1), (7, None, 1), (77, 1, 1)]
    told = spark.createDataFrame(labels, LABELS)
    known = [x for x in labels if x[0] is not None]
    found = filter_audit.interaction_audit(odd, told).collect()
    check(found, [(d[0], d[1], d[3]) for d in ODD], known)
    assert filter_audit.interaction_audit(none, told).count() == 0


def test_every_filter_alone_and_together(spark):
    words = " ".join(f"w{i}" for i in range(200))
    texts = [words, words, words + " #", "short", "short", "AAAA " * 300, "a " * 300, words.upper(), words.upper() + " $", "A" * 5 + " " + words[:-6], None, "", " \v\f ", words + " x", "é " * 250]
    docs = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", 1) for i, t in enumerate(texts)] + [(None, "short", "en", "", 5), (3, "short", "en", "s1", 5)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(12)]
    found = filter_audit.interaction_audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    check(found, [(d[0], d[1], d[3]) for d in docs], labels)


def test_query_at_the_smallest_tables(spark, sample):
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    check(queries.op13_filter_interactions(spark, "/root/testdata/sf0.001").collect(), [tuple(r) for r in sample.select("doc_id", "text", "source").collect()], labels)
