"""Byte-level BPE ids by the tokenizers library, with a per-process memory of units already encoded.

The vocabulary's split pattern never joins a word to white space that follows it, nor ASCII letters, digits and marks to one another
(but for an apostrophe and the letters after it), so a text may be cut at those places and its units encoded one by one. Units
are found for a whole batch at once; the memory is a direct-mapped table, so its size is fixed: a slot holds one unit of up to
KEY_WORDS * 8 bytes, kept byte for byte, and its ids. Other units are encoded each time they come.
Texts in which such cuts would be unsafe (added-token strings, other white space) are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from tapeloom.llm.kernels import U64, mix64, text_chunks

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_OTHER_SPACE = re.compile("[\u0085   -     　]")
SLOTS = 1 << 21
KEY_WORDS = 3
IDS_KEPT = 8

#: Kinds of bytes: white space, letter, digit, apostrophe, other ASCII, part of another character.
SPACE, LETTER, DIGIT, APOSTROPHE, MARK, OTHER = range(6)


def _kinds() -> np.ndarray:
    kind = np.full(256, MARK, dtype=np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[[*range(65, 91), *range(97, 123)]] = LETTER
    kind[48:58] = DIGIT
    kind[39] = APOSTROPHE
    kind[128:] = OTHER
    return kind


def _cuts() -> np.ndarray:
    """Whether a unit ends between two kinds of bytes."""
    cut = np.zeros((6, 6), dtype=bool)
    cut[1:, SPACE] = True
    for a in (LETTER, DIGIT, APOSTROPHE, MARK):
        for b in (LETTER, DIGIT, APOSTROPHE, MARK):
            cut[a, b] = a != b
    cut[APOSTROPHE, MARK] = cut[MARK, APOSTROPHE] = cut[APOSTROPHE, LETTER] = False
    return cut.reshape(-1)


_KIND, _CUT = _kinds(), _cuts()
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitEncoder:
    """encode(texts) gives what Tokenizer.encode(text, add_special_tokens=False).ids gives for each text.

    slots: units remembered, a power of two.
    """

    def __init__(self, path: str, slots: int = SLOTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.n_symbols = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.n_bytes = np.zeros(self.n_symbols, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.n_bytes[i] = len(token)
        self.keys = np.zeros((slots, KEY_WORDS), dtype=U64)
        self.key_bytes = np.zeros(slots, dtype=np.uint8)
        self.ids = np.zeros((slots, IDS_KEPT), dtype=np.uint16 if self.n_symbols <= 1 << 16 else np.uint32)
        self.n_ids = np.zeros(slots, dtype=np.uint8)

    def _learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units one after the other, and each unit's number of ids."""
        space = b" \t\n\v\f\r"
        led = [i for i, u in enumerate(units) if u[0] in space and u[-1] not in space]
        alone = [i for i, u in enumerate(units) if not (u[0] in space and u[-1] not in space)]
        groups = [b"".join(units[i] for i in led[a : a + 128]).decode() for a in range(0, len(led), 128)]
        out = self.tokenizer.encode_batch_fast([*groups, *(units[i].decode() for i in alone)], add_special_tokens=False)
        flat = np.concatenate([np.asarray(e.ids, dtype=np.uint32) for e in out])
        # a token never spans two units, so the bytes read so far tell where each unit's ids end
        order = np.array(led + alone)
        sizes = np.cumsum([len(units[i]) for i in order])
        counts = np.diff(np.searchsorted(np.cumsum(self.n_bytes[flat]), sizes) + 1, prepend=0)
        back = np.empty(len(units), dtype=np.int64)
        back[order] = np.arange(len(units))
        firsts = (np.cumsum(counts) - counts)[back]
        counts = counts[back]
        return flat[np.repeat(firsts - np.cumsum(counts) + counts, counts) + np.arange(len(flat))], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other (unsigned 32-bit), and each text's number of ids."""
        flat, counts = [np.empty(0, dtype=np.uint32)], [np.empty(0, dtype=np.int64)]
        for a, b in text_chunks(texts):
            ids, n = self._chunk(texts[a:b])
            flat.append(ids)
            counts.append(n)
        return np.concatenate(flat), np.concatenate(counts)

    def _units(self, parts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all texts, where each unit starts, its number of bytes, and the number of units of each text."""
        data = b"".join(parts)
        kinds = _KIND[np.frombuffer(data, dtype=np.uint8)]
        cut = np.ones(len(data), dtype=bool)
        cut[1:] = _CUT[kinds[:-1] * np.uint8(6) + kinds[1:]]
        ends = np.cumsum([len(p) for p in parts])
        cut[ends[ends < len(data)]] = True
        starts = np.flatnonzero(cut)
        return data, starts, np.diff(starts, append=len(data)), np.diff(np.searchsorted(starts, ends), prepend=0)

    def _ids(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, and each unit's number of ids."""
        padded = np.frombuffer(data + bytes(8 * KEY_WORDS), dtype=np.uint8)
        words = np.ndarray((len(data) + 8 * (KEY_WORDS - 1) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        key = np.empty((len(starts), KEY_WORDS), dtype=U64)
        mixed = sizes.astype(U64)
        for k in range(KEY_WORDS):
            key[:, k] = words[starts + 8 * k] & _MASKS[np.clip(sizes - 8 * k, 0, 8)]
            mixed = mix64(mixed ^ key[:, k])
        slot = (mixed & U64(len(self.keys) - 1)).astype(np.int64)
        short = sizes <= 8 * KEY_WORDS
        known = short & (self.key_bytes[slot] == sizes) & (self.keys[slot] == key).all(axis=1)
        n = self.n_ids[slot].astype(np.int64)
        rows = self.ids[slot]
        missing = np.flatnonzero(~known)
        if not len(missing):
            return rows[np.arange(IDS_KEPT) < n[:, None]].astype(np.uint32), n
        place: dict[bytes, int] = {}
        at = np.array([place.setdefault(data[s : s + k], len(place)) for s, k in zip(starts[missing].tolist(), sizes[missing].tolist())])
        flat, counts = self._learn(list(place))
        firsts = np.cumsum(counts) - counts
        n[missing] = counts[at]
        # the first place of each new unit that fits takes its slot
        _, first = np.unique(at, return_index=True)
        fits = (counts <= IDS_KEPT) & short[missing[first]]
        new, into = missing[first[fits]], slot[missing[first[fits]]]
        kept = np.zeros((fits.sum(), IDS_KEPT), dtype=self.ids.dtype)
        mask = np.arange(IDS_KEPT) < counts[fits][:, None]
        kept[mask] = flat[np.repeat(fits, counts)]
        # of several new units of one slot the last takes it whole
        into, last = np.unique(into[::-1], return_index=True)
        last = len(new) - 1 - last
        self.keys[into], self.key_bytes[into], self.n_ids[into], self.ids[into] = key[new[last]], sizes[new[last]], counts[fits][last], kept[last]
        out = np.empty(n.sum(), dtype=np.uint32)
        begin = np.cumsum(n) - n
        seen = np.flatnonzero(known)
        out[np.repeat(known, n)] = rows[seen][np.arange(IDS_KEPT) < n[seen, None]]
        m = n[missing]
        run = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        out[np.repeat(begin[missing], m) + run] = flat[np.repeat(firsts[at], m) + run]
        return out, n

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added) or not t.isascii() and _OTHER_SPACE.search(t)]
        odd = set(whole)
        data, starts, sizes, units = self._units([b"" if i in odd else t.encode("utf-8", "replace") for i, t in enumerate(texts)])
        flat, n = self._ids(data, starts, sizes)
        counts = np.diff(np.concatenate([[0], np.cumsum(n)])[np.cumsum(units)], prepend=0)
        if not whole:
            return flat, counts
        rows = np.split(flat, np.cumsum(counts)[:-1])
        for i, e in zip(whole, self.tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False)):
            rows[i] = np.asarray(e.ids, dtype=np.uint32)
        return np.concatenate(rows), np.array([len(r) for r in rows], dtype=np.int64)


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The encoder of this process for a vocabulary file; Spark reuses its Python workers, so later tasks find it filled."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]
