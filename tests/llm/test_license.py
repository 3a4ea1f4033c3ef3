"""License rules against a plain scan with every rule and no keywords."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tapeloom.llm import license_rules, license_signatures, queries
from tests.llm.conftest import ODD


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text):
    """(labels, score) by every rule on the whole text and suppression pair by pair."""
    w = words_of(text)
    line, found = " ".join(w), []
    for r in license_rules.rules():
        for m in r.pattern.finditer(line):
            first = line[: m.start()].count(" ")
            found.append((r.base, r.priority, first, first + len(m[0].split()), r.label, r.weight))
    free = sorted((d for d in found if not d[0]), key=lambda d: (-d[1], d[2] - d[3], d[2], d[4]))
    kept = []
    for d in free:
        if not any(k[2] <= d[2] and d[3] <= k[3] for k in kept):
            kept.append(d)
    kept += [d for d in found if d[0]]
    miss = 1.0
    for d in kept:
        miss *= 1 - d[5]
    return ",".join(sorted({d[4] for d in kept})), miss


def check_all(rows, docs):
    want = sorted((str(i), plain(t)[0]) for i, t in docs)
    assert sorted((str(r.doc_id), r.labels) for r in rows) == want
    scores = {str(i): plain(t)[1] for i, t in docs}
    assert all(abs(r.score - (1 - scores[str(r.doc_id)])) < 1e-6 for r in rows)


def check_base(rows, docs):
    want = []
    for doc_id, text in docs:
        w, at, labels = words_of(text), [], set()
        for phrase, label, _ in license_rules.BASE:
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        want.append((str(doc_id), len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in rows)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_license_base_places(spark, odd, none):
    rows = queries.op6_license_rules(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check_base(rows, docs)
    check_base(license_rules.license_scan(odd).collect(), [(d[0], d[1]) for d in ODD])
    assert license_rules.license_scan(none).count() == 0
    hard = [(0, "CC-BY, cc by; ccby cc  by"), (1, "All rights\n\nRESERVED all rights reservedé"), (2, "the GENERAL Public-License. cc by cc by"), (3, "cc by x cc by  cc by, cc by")]
    check_base(license_rules.license_scan(spark.createDataFrame(hard, "doc_id int, text string")).collect(), hard)


def test_query_against_plain_scan(spark, sample):
    rows = queries.op6_license_rules(spark, "/root/testdata/sf0.001").collect()
    check_all(rows, [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()])


def test_rules_are_many_and_each_has_an_example():
    rules = license_rules.rules()
    own = sum(len(g) for _, _, g in license_signatures.GROUPS)
    assert own > 400 and len(rules) == own + len(license_signatures.SPDX) + 3
    assert len({r.pattern.pattern for r in rules}) > 480
    for r in rules:
        m = r.pattern.search(r.example)
        assert m, r.example
        assert set(m[0].split()) & set(r.keywords), r.example


def test_every_example_is_found_between_any_separators(spark):
    g = random.Random(11)
    separators = (" ", "\n", "  ", " - ", ", ", "\t", "/*\n * ", " \"", ".")
    docs = []
    for i, r in enumerate(license_rules.rules()):
        words = [w.upper() if g.random() < 0.3 else w.title() if g.random() < 0.3 else w for w in r.example.split()]
        docs.append((i, "Filler text before: " + "".join(w + g.choice(separators) for w in words) + "and after it"))
    rows = license_rules.license_scan(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    check_all(rows, docs)
    check_base(rows, docs)
    assert all(r.labels for r in rows)


ALPHABET = st.characters(codec="ascii", categories=("Ll", "Nd"), include_characters=" ")


@pytest.mark.parametrize("group", range(len(license_signatures.GROUPS)))
def test_keywords_stand_in_every_match(group):
    """Whatever a pattern can match holds one of its keywords as a word."""
    _, _, rules = license_signatures.GROUPS[group]
    for label, keywords, pattern, _ in rules:
        anything = license_rules._whole_words(pattern)

        @settings(max_examples=6, deadline=None, database=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(pattern, fullmatch=True, alphabet=ALPHABET))
        def holds(text):
            line = " ".join(words_of(text))
            m = anything.search(line)
            if m:
                assert set(m[0].split()) & set(keywords.split("|")), (label, m[0])

        holds()


def test_suppression_is_by_priority_and_containment():
    g = random.Random(3)
    for _ in range(50):
        found = []
        for _ in range(40):
            a = g.randrange(60)
            found.append(license_rules.Detection(g.choice("abcd"), a, a + g.randint(1, 12), g.choice((40, 50, 90)), 0.5, g.random() < 0.1))
        want = []
        for d in sorted((d for d in found if not d.base), key=lambda d: (-d.priority, d.first_word - d.end_word, d.first_word, d.label)):
            if not any(k.first_word <= d.first_word and d.end_word <= k.end_word for k in want):
                want.append(d)
        assert license_rules.settled(found) == [d for d in found if d.base] + want


def labels(text):
    w = words_of(text)
    return [(d.label, d.first_word, d.end_word) for d in license_rules.settled(license_rules.detections(w, list(license_rules.rules()))) if not d.base]


def test_longer_and_stronger_rules_win():
    assert labels("This work is licensed under the MIT license, and not otherwise") == [("mit", 3, 8)]
    assert labels("the GNU General Public License v2") == [("gpl-2.0", 1, 6)]
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == [("gpl-2.0-or-later", 0, 8)]
    assert [x[0] for x in labels("mit license or isc license")] == ["mit", "isc"]
    assert labels("http://www.apache.org/licenses/LICENSE-2.0") == [("apache-2.0", 1, 8)]


def test_many_notices_in_one_text():
    text = "Copyright (c) 2001 all rights reserved. see www.gnu.org/licenses/gpl.html " * 4000
    rows = license_rules._rows([1], [text], False)
    assert rows["n_base"] == [4000] and "gpl-family" in rows["labels"][0]
