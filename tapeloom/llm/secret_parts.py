"""Secrets in texts, and weak parts of credentials that count only together.

Strong kinds are reported wherever they stand: `assign` (a secret's name with a value), `access` (an access key's identifier) and `hex` (a long run of
hexadecimal digits). Weak kinds are common by themselves: `login` (an account's name or key id with a value), `opaque` (a long mixed run of letters and
digits) and `endpoint` (where a credential would be used). Every part has a role: identifier, secret or place. Parts and scopes are intervals of code
points; a scope is a block of text between blank lines. A weak part is reported only if the roles that it needs stand in its scope, at most REACH code
points away: a login needs a secret, an opaque run an identifier, an endpoint both.

The interval join makes no pairs. Within a batch all texts lie one behind the other on one axis; of the intervals of a role, those that meet a window are
as many as start at or before its end less those that end before its start, which two binary searches tell for all parts at once.

A text is searched only if it holds a keyword, the key prefix or a hexadecimal run, which whole batches are asked for at once; no other text can have a
strong part, or a weak one with an identifier beside it.

Defined cases: a null or empty text has no parts; null ids and repeated rows keep their own rows; an empty table gives no rows; extra columns are ignored;
parts of one kind never overlap, parts of two kinds may, but an opaque run that meets another part is no part of its own; parts of equal start are in the
order of KINDS.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.kernels import text_chunks

# The strong kinds' patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "login", "opaque", "endpoint")
STRONG = KINDS[:3]

IDENTIFIER, SECRET, PLACE = 1, 2, 4
ROLE = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET, "login": IDENTIFIER, "opaque": SECRET, "endpoint": PLACE}
NEEDS = {"login": SECRET, "opaque": IDENTIFIER, "endpoint": IDENTIFIER | SECRET}
REACH = 300
ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
LOGIN = re.compile(r"""(?<![a-z0-9])(?:user(?:_?name)?|login|account(?:_?(?:id|name))?|client_?id|(?:access_?)?key_?id)["']?[ \t]*[:=][ \t]*["']?([a-z0-9][a-z0-9._@-]{2,})""", re.IGNORECASE | re.ASCII)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,128}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(
    r"""\b(?:https?|s3|ftps?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|jdbc:[a-z]+)://[^\s"'<>]{4,}|(?<![a-z0-9])(?:host|endpoint|server|bucket)["']?[ \t]*[:=][ \t]*["']?[a-z0-9][a-z0-9.-]*[a-z0-9](?::[0-9]+)?""",
    re.IGNORECASE | re.ASCII,
)
BLANK_LINE = re.compile(r"\n[ \t\r\f\v]*\n")
#: Bytes that any text with a strong part or an identifier holds, in lower case.
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"akia", b"user", b"login", b"account", b"client", b"keyid", b"key_id")
_HEX_BYTE = np.zeros(256, dtype=bool)
_HEX_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def mixed(run: str, bits: float = 3.5) -> bool:
    """Whether a run of characters looks drawn at random: lower and upper case, digits, and `bits` of entropy a character."""
    if not (any("a" <= c <= "z" for c in run) and any("A" <= c <= "Z" for c in run) and any("0" <= c <= "9" for c in run)):
        return False
    n = len(run)
    return -sum(k / n * math.log2(k / n) for k in Counter(run).values()) >= bits


def found_parts(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all parts, weak ones too, in order."""
    parts = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    for number, pattern in ((1, ACCESS), (2, HEX), (3, LOGIN), (5, ENDPOINT)):
        parts += [(m.start(), number, m.end()) for m in pattern.finditer(text)]
    parts.sort()
    reach = list(np.maximum.accumulate([p[2] for p in parts])) if parts else []
    starts = [p[0] for p in parts]
    for m in OPAQUE.finditer(text):
        before = np.searchsorted(starts, m.end()) if parts else 0  # parts that start before its end
        if mixed(m[0]) and not (before and reach[before - 1] > m.start()):
            parts.append((m.start(), 4, m.end()))
    return sorted(parts)


def candidates(encoded: list[bytes]) -> np.ndarray:
    """Which texts may hold a strong part or an identifier."""
    ends = np.cumsum([len(t) + 1 for t in encoded])
    joined = b"\n".join(encoded) + b"\n"
    hit = np.zeros(len(encoded), dtype=bool)
    low = joined.lower()
    for keyword in KEYWORDS:
        at = low.find(keyword)
        while at >= 0:
            row = int(np.searchsorted(ends, at, side="right"))
            hit[row] = True
            at = low.find(keyword, int(ends[row]))  # one hit a text is enough
    run, width = _HEX_BYTE[np.frombuffer(joined, dtype=np.uint8)], 1
    while width < HEX_LEAST and len(run):  # from runs of `width` to runs of as many more
        more = min(width, HEX_LEAST - width)
        run, width = run[: max(len(run) - more, 0)] & run[more:], width + more
    hit[np.searchsorted(ends, np.flatnonzero(run), side="right")] = True
    return hit


def reported(starts: np.ndarray, stops: np.ndarray, kinds: np.ndarray, scope_starts: np.ndarray, scope_stops: np.ndarray) -> np.ndarray:
    """Which parts count: strong ones, and weak ones with all roles that they need in reach and scope. Scopes are in order and apart."""
    roles = np.array([ROLE[k] for k in KINDS])[kinds]
    needs = np.array([NEEDS.get(k, 0) for k in KINDS])[kinds]
    scope = np.searchsorted(scope_starts, starts, side="right") - 1
    low, high = np.maximum(starts - REACH, scope_starts[scope]), np.minimum(stops + REACH, scope_stops[scope] - 1)
    met = np.zeros(len(starts), dtype=np.int64)
    for role in (IDENTIFIER, SECRET):
        own = roles == role
        opened, closed = np.sort(starts[own]), np.sort(stops[own])
        met |= role * (np.searchsorted(opened, high, side="right") > np.searchsorted(closed, low, side="left"))
    return (needs & ~met) == 0


def _batch_parts(texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of the parts that count, for each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    rows, base, parts, scopes = [], 0, [], []
    for row in np.flatnonzero(candidates([t.encode("utf-8", "replace") for t in texts])).tolist():
        text = texts[row]
        if own := found_parts(text):
            cuts = [0, *[m.end() for m in BLANK_LINE.finditer(text)]]
            scopes += [(base + a, base + b) for a, b in zip(cuts, [*cuts[1:], len(text)])]
            parts += [(base + a, kind, base + b) for a, kind, b in own]
            rows += [(row, base)] * len(own)
            base += len(text) + REACH + 1
    if parts:
        starts, kinds, stops = np.array(parts, dtype=np.int64).T
        keep = reported(starts, stops, kinds, *np.array(scopes, dtype=np.int64).T)
        for (row, at), (a, kind, b), good in zip(rows, parts, keep.tolist()):
            if good:
                out[row].append((KINDS[kind], a - at, b - at))
    return out


_PART = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("parts", pa.list_(_PART))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in text_chunks(texts):
            found = [[{"kind": k, "start": s, "end": e, "secret": texts[i][s:e]} for k, s, e in parts] for i, parts in enumerate(_batch_parts(texts[a:b]), a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(found, _ARROW.field("parts").type)], schema=_ARROW)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id and parts (kind, start, end, secret) in order, for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, parts array<struct<kind string, start long, end long, secret string>>")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda part: part["kind"] == kind


def spans_report(scanned: DataFrame) -> DataFrame:
    """Counts of the strong kinds, a digest of their spans, and all spans, without the secrets."""
    listed = lambda parts: F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")
    strong = F.filter("parts", lambda p: p["kind"].isin(*STRONG))
    counts = [F.size(F.filter("parts", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in STRONG]
    return scanned.select("doc_id", *counts, F.sha2(listed(strong).cast("binary"), 256).alias("base_sha256"), listed(F.col("parts")).alias("spans"))
