"""License detection by ordered signature rules.

Rules (license_signatures.py) are hand-written regular expressions over a text's words (lower-case, one space between). A rule names keywords of which any
text it matches holds one as a word. The hashes of all words of a batch are held against those of the keywords at once, and a text is searched only for
the rules whose keywords it holds; most texts hold none. Detections are settled in order of priority, then length: one whose words lie within
those of a stronger detection is suppressed.

Base phrases have rules of their own which nothing suppresses. Identifiers after "SPDX-License-Identifier:" have one rule each.

Defined cases: a null or empty text has no words, no detections, empty labels and score 0; null ids and repeated rows keep their own rows; an
empty table gives no rows; extra columns are ignored; of equal detections (same words, priority and label order) all keep their label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import license_signatures
from tapeloom.llm.kernels import span_hashes, text_chunks

#: Base phrases, their labels and keywords.
BASE = (("cc by", "cc-by", "cc"), ("general public license", "gpl", "license"), ("all rights reserved", "reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    label: str
    keywords: tuple[str, ...]
    priority: int
    weight: float
    base: bool = False
    example: str = ""


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _whole_words(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules, strongest first."""
    made = [Rule(_whole_words(phrase), label, (keyword,), 100, 0.6, True, phrase) for phrase, label, keyword in BASE]
    for priority, weight, group in license_signatures.GROUPS:
        made += [Rule(_whole_words(p), label, tuple(k.split("|")), priority, weight, False, example or p) for label, k, p, example in group]
    for name in license_signatures.SPDX:
        said = "spdx license identifier " + " ".join(WORD.findall(name.lower()))
        made.append(Rule(_whole_words(said), name.lower(), ("spdx",), 95, 1.0, False, said))
    return tuple(sorted(made, key=lambda r: -r.priority))


@lru_cache(1)
def _keywords() -> tuple[np.ndarray, list[list[int]]]:
    """The keywords' hashes in order, and the rules that each of them wakes."""
    woken: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        for k in rule.keywords:
            woken.setdefault(k, []).append(i)
    sizes = np.array([len(k) for k in woken])
    stops = np.cumsum(sizes)
    hashes = span_hashes(np.frombuffer("".join(woken).encode(), dtype=np.uint8), stops - sizes, stops)
    order = np.argsort(hashes)
    waking = list(woken.values())
    return hashes[order], [waking[i] for i in order]


@dataclass(frozen=True)
class Detection:
    label: str
    first_word: int
    end_word: int
    priority: int
    weight: float
    base: bool


def detections(words: list[str], wanted: list[Rule]) -> list[Detection]:
    """Every match of the wanted rules, unsettled."""
    line = " ".join(words)
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    found = []
    for rule in wanted:
        spans = [m.span() for m in rule.pattern.finditer(line)]
        if spans:
            ends = np.searchsorted(starts, np.array(spans), side="left")
            found += [Detection(rule.label, int(a), int(b), rule.priority, rule.weight, rule.base) for a, b in ends]
    return found


def settled(found: list[Detection]) -> list[Detection]:
    """Base detections, and of the others those that lie in no stronger one: a higher priority, or the same and longer.

    The farthest end of the kept detections that start at or before a word is kept in a tree of prefix maxima, so each detection is settled in
    logarithmic time, however many a text has.
    """
    firsts = {a: i for i, a in enumerate(sorted({d.first_word for d in found}))}
    reach = [0] * (len(firsts) + 1)
    kept: list[Detection] = []
    for d in sorted((d for d in found if not d.base), key=lambda d: (-d.priority, d.first_word - d.end_word, d.first_word, d.label)):
        i, end = firsts[d.first_word] + 1, 0
        while i:
            end = max(end, reach[i])
            i &= i - 1
        if end >= d.end_word:
            continue
        kept.append(d)
        i = firsts[d.first_word] + 1
        while i < len(reach):
            reach[i] = max(reach[i], d.end_word)
            i += i & -i
    return [d for d in found if d.base] + kept


def _scan(with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_chunks(texts):
                yield pa.RecordBatch.from_pydict(_rows(ids[a:b], texts[a:b], with_spans), schema=_ARROW if with_spans else pa.schema(list(_ARROW)[:-1]))

    return run


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("priority", pa.int32()), ("base", pa.bool_())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(_SPAN))])


def _words_and_keywords(lowered: list[bytes]) -> tuple[np.ndarray, list[set[int]]]:
    """The number of words of each text, and the rules that its words wake."""
    data = np.frombuffer(b"\n".join(lowered) + b"\n", dtype=np.uint8)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[1:] = _WORD_BYTE[data]
    step = np.diff(inside)
    opens, closes = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    counts = np.diff(np.searchsorted(opens, np.cumsum([len(x) + 1 for x in lowered])), prepend=0)
    known, waking = _keywords()
    hashes = span_hashes(data, opens, closes)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = np.flatnonzero(known[at] == hashes)
    woken: list[set[int]] = [set() for _ in lowered]
    pairs = np.unique(np.column_stack([np.searchsorted(np.cumsum(counts), hit, side="right"), at[hit]]), axis=0)
    for row, keyword in pairs.tolist():
        woken[row].update(waking[keyword])
    return counts, woken


def _rows(ids: list, texts: list[str], with_spans: bool) -> dict:
    lowered = [t.encode("utf-8", "replace").lower() for t in texts]
    out: dict[str, list] = {name: [] for name in _ARROW.names[: None if with_spans else -1]}
    for doc_id, raw, n, woken in zip(ids, lowered, *_words_and_keywords(lowered)):
        found: list[Detection] = []
        if woken:
            found = settled(detections(WORD.findall(raw.decode("utf-8", "replace")), [rules()[i] for i in sorted(woken)]))
        base = [d for d in found if d.base]
        miss = 1.0
        for d in found:
            miss *= 1 - d.weight
        row = [doc_id, int(n), len(base), min((d.first_word for d in base), default=None), max((d.first_word for d in base), default=None), ",".join(sorted({d.label for d in base})), ",".join(sorted({d.label for d in found})), round(1 - miss, 6)]
        if with_spans:
            row.append([{"label": d.label, "first_word": d.first_word, "end_word": d.end_word, "priority": d.priority, "base": d.base} for d in found])
        for name, v in zip(out, row):
            out[name].append(v)
    return out


def license_scan(docs: DataFrame, with_spans: bool = True) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score and, if asked for, all settled detections."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    if with_spans:
        schema += ", detections array<struct<label string, first_word long, end_word long, priority int, base boolean>>"
    return rows.mapInArrow(_scan(with_spans), schema)
