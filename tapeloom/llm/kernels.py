"""Numpy kernels that work on a whole Arrow batch of texts at once, inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=U64) + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE_CODE = mix64(np.arange(256))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept for the next batch."""
    if not _powers or len(_powers[0]) < n:
        m = max(1 << 20, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            up, down = np.full(m, _BASE, U64), np.full(m, pow(_BASE, -1, 1 << 64), U64)
            up[0] = down[0] = 1
            _powers[:] = [np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)]
    return _powers[0], _powers[1]


def text_chunks(texts: list[str], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about limit characters; one long text makes a range of its own."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans data[start:stop]: a polynomial over the bytes of each, read off one running sum over data."""
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        running = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=running[1:])
        return mix64((running[stops] - running[starts]) * down[starts] + (stops - starts).astype(U64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words (runs of letters, digits and underscores) of the texts in order, and the number of words of each text."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[1:] = _WORD_BYTE[data]
    step = np.diff(inside)
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    hashes = span_hashes(data, starts, stops)
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words in each text, and the row of each; a text of fewer words is one shingle, a text without words none."""
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(len(words)) - np.repeat(first, counts)
    starts = np.flatnonzero(place <= np.repeat(np.maximum(counts - width, 0), counts))
    with np.errstate(over="ignore"):
        total = np.zeros(len(starts), dtype=U64)
        room = np.repeat(counts, counts)[starts] - place[starts]
        for k in range(width):
            at = np.minimum(starts + k, max(len(words) - 1, 0))
            total += np.where(k < room, words[at], U64(k + 1)) * U64(2 * int(mix64(k + 77)) % (1 << 64) | 1)
    return mix64(total), rows[starts]


def occurrence_cells(elements: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distinct hashes for the first, second, ... occurrence of an element in its row.

    The weighted Jaccard similarity of two rows by occurrence counts is the plain Jaccard similarity of their cells.
    """
    with np.errstate(over="ignore"):
        key = mix64(elements + mix64(rows.astype(U64)))
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        at = np.flatnonzero(new)
        nth = np.empty(len(key), dtype=U64)
        nth[order] = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
        return np.where(nth > 0, mix64(elements + mix64(nth)), elements)
