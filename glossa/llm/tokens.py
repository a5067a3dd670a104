"""Ids of whole texts by a public tokenizer file and the tokenizers library, each distinct word encoded once.

Byte-pair merges never cross the words that a tokenizer's split rule makes. For texts of characters on which the
library's rule and the tables below agree beyond doubt, many texts at once are cut into words in numpy, equal words are
found by 64-bit hashes, the library encodes each word that is new, and a bounded cache keeps its ids. All
other texts, texts that may hold a special token's string, and tokenizers with another split rule go through the library
whole; both ways give the same ids. Null and empty texts have no ids; a very long text is cut before white space, where
no word goes on. The cache holds the words of one process; two of them with one hash (chance below 1e-7) would be taken
for one.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import chain

import numpy as np

from .common import UPPER_TO_LOWER, mix, range_hash, slices

CACHE, STEP = 1_500_000, 1 << 19
CLIP_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

BLANK, ALPHA, DIGIT, OTHER, INNER, STRANGE = range(6)
#: Class of each byte of UTF-8. Two-byte characters after C3 to C5 are letters, those after C2 and E2 signs, with the exceptions below.
CLASS = np.full(256, STRANGE, np.uint8)
CLASS[0x20:0x7F] = OTHER
CLASS[[0x09, 0x0A, 0x0D, 0x20]] = BLANK
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, 0xC4, 0xC5]] = ALPHA
CLASS[0x30:0x3A] = DIGIT
CLASS[[0xC2, 0xE2]] = OTHER
CLASS[0x80:0xC0] = INNER
#: Second bytes after C2, C4, C5, third ones after E2 80 and E2 82: which characters are known.
SIGNS = np.isin(np.arange(256), [ord(c) for c in "¡«»¿"])
NOT_C4, NOT_C5 = (0xB0, 0xB1), 0xBF  # dotted and dotless i, long s: their case and composition are left to the library
DASHES = np.isin(np.arange(256), [c.encode()[2] for c in "–—‘’“”…"])
LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LETTER_FOLDED = LETTER[UPPER_TO_LOWER]
APOSTROPHE = 0x27


def strange(data: np.ndarray) -> np.ndarray:
    """Positions of bytes that keep a text from being cut into words here."""
    one, two = data[1:], data[2:]
    bad = CLASS[data] == STRANGE
    if len(data) > 1:
        first = data[:-1]
        bad[:-1] |= (first == 0x3C) & (one == 0x7C)
        high = np.flatnonzero(first >= 0xC2)
        a, b = first[high], one[high]
        c = np.concatenate([two, np.zeros(1, np.uint8)])[high]
        bad[high] |= ((a == 0xC2) & ~SIGNS[b]) | ((a == 0xC4) & ((b == NOT_C4[0]) | (b == NOT_C4[1]))) | ((a == 0xC5) & (b == NOT_C5))
        bad[high] |= (a == 0xE2) & ~(((b == 0x80) & DASHES[c]) | ((b == 0x82) & (c == 0xAC)))
    return np.flatnonzero(bad)


def byte_classes(data: np.ndarray) -> np.ndarray:
    kind = CLASS[data]
    inner = np.flatnonzero(kind == INNER)
    for _ in range(2):
        kind[inner] = kind[inner - 1]
    cross = inner[(data[inner - 1] == 0xC3) & ((data[inner] == 0x97) | (data[inner] == 0xB7))]  # × and ÷
    kind[cross] = kind[cross - 1] = OTHER
    return kind


def endings(data: np.ndarray, kind: np.ndarray, at: np.ndarray, stop: np.ndarray, folded: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of apostrophes that stand alone, those that begin an English ending, and where the ending stops."""
    low = UPPER_TO_LOWER if folded else np.arange(256, dtype=np.uint8)
    room = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b = low[room[at + 1]], low[room[at + 2]]
    a, b = np.where(at + 1 < stop, a, 0), np.where(at + 2 < stop, b, 0)
    short = np.isin(a, list(b"stmd"))
    long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    hit = short | long
    return at[hit], at[hit] + np.where(short, 2, 3)[hit]


def word_bounds(data: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of all words of texts end to end.

    spaced: a word takes one blank before it, digits make runs, and all other white space is words too; else white space
    is dropped, every digit is a word, and letters' case doesn't matter.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = byte_classes(data)
    blank = kind == BLANK
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    edge = first[:-1].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    begin = edge if spaced else (edge | (kind == DIGIT)) & ~blank
    quote = np.flatnonzero(edge & (data == APOSTROPHE))
    alone = (quote + 1 >= n) | edge[np.minimum(quote + 1, n - 1)]
    if spaced:
        alone &= first[quote] | (data[np.maximum(quote - 1, 0)] != 0x20)
    quote = quote[alone]
    stop = offsets[np.searchsorted(offsets, quote, "right")] if len(quote) else quote
    quote, after = endings(data, kind, quote, stop, not spaced)
    if spaced:
        begin = begin.copy()
        last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~first[1:-1])  # white space before a word of the same text
        begin[last] = True
        begin[last[data[last] == 0x20] + 1] = False
    begin[quote + 1] = False
    inside = after < n
    go_on = after[inside]
    begin[go_on[(kind[go_on] == ALPHA) & ~first[go_on]]] = True
    start = np.flatnonzero(begin)
    if spaced:
        return start, np.append(start[1:], n)
    ends = ~blank
    ends[:-1] &= begin[1:] | blank[1:]
    return start, np.flatnonzero(ends) + 1


def byte_characters() -> dict[int, str]:
    """The character by which byte-level models write each byte: itself if it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as arrays of ``self.dtype``. The cache of words: their hashes, sorted, and where in ``pool`` their ids
    lie; about 25 bytes a word."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.vocab = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")
        self.spaced, self.written = None, byte_characters()
        before, norm = rules["pre_tokenizer"] or {}, rules["normalizer"]
        if rules["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and norm is None:
            self.spaced = True
        elif rules["model"]["type"] == "BPE" and [p.get("type") for p in before.get("pretokenizers", ())] == ["Split", "ByteLevel"] and before["pretokenizers"][0]["pattern"].get("Regex") == CLIP_SPLIT and [n["type"] for n in (norm or {}).get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]:
            self.spaced = False
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.many = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32)
        self.pool, self.size = np.empty(1 << 16, self.dtype), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def add(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Ids of new words (their hashes sorted) by the library's model, at the end of the pool."""
        if not self.spaced:
            words = [w.lower() if w.isascii() else w.decode().lower().encode() for w in words]
        end = np.cumsum([len(w) for w in words]).tolist()
        letters, tokenize = b"".join(words).decode("latin-1").translate(self.written), self.library.model.tokenize
        got = [[t.id for t in tokenize(letters[a:b])] for a, b in zip([0, *end], end)]  # noqa: B905
        many = np.array([len(g) for g in got], np.uint32)
        ids = np.fromiter(chain.from_iterable(got), self.dtype, int(many.sum()))
        while self.size + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.size : self.size + len(ids)] = ids
        at = (self.size + np.cumsum(many) - many).astype(np.uint32)
        self.size += len(ids)
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.many = (np.insert(x, place, y) for x, y in ((self.hashes, hashes), (self.at, at), (self.many, many)))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of known characters end to end, and the n + 1 offsets."""
        start, stop = word_bounds(data, offsets, self.spaced)
        hashes, first, inverse = np.unique(range_hash((LETTER if self.spaced else LETTER_FOLDED)[data], start, stop), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE:
            self.clear()
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == hashes[inside]
        if not known.all():
            raw, new = data.tobytes(), first[~known]
            self.add(hashes[~known], [raw[a:b] for a, b in zip(start[new].tolist(), stop[new].tolist(), strict=True)])
            place = np.searchsorted(self.hashes, hashes)
        at, many = self.at[place][inverse].astype(np.int64), self.many[place][inverse].astype(np.int64)
        end = np.cumsum(many)
        total = int(end[-1]) if len(end) else 0
        ids = self.pool[np.repeat(at - (end - many), many) + np.arange(total)]
        return ids, np.concatenate([[0], end])[np.searchsorted(start, offsets)]

    def long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text of known characters in pieces of about STEP bytes, each cut before white space."""
        blank, out, a = CLASS[data] == BLANK, [], 0
        cuts = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        while a < len(data):
            k = int(np.searchsorted(cuts, a + STEP))
            b = int(cuts[k]) if k < len(cuts) else len(data)
            out.append(self.words(data[a:b], np.array([0, b - a]))[0])
            a = b
        return np.concatenate(out)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (with the end id behind each), and the n + 1 offsets."""
        out, sizes = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        for i, j in slices(offsets, STEP):
            part, base = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            odd = np.ones(j - i, bool) if self.spaced is None else np.zeros(j - i, bool)
            odd[np.searchsorted(base, strange(part), "right") - 1] = True
            change = np.flatnonzero(np.diff(odd)) + 1
            for a, b in zip([0, *change], [*change, j - i], strict=True):
                text = part[base[a] : base[b]]
                if odd[a]:
                    got = [self.whole(part[base[k] : base[k + 1]].tobytes().decode()) for k in range(a, b)]
                    ids, at = np.concatenate(got), np.concatenate([[0], np.cumsum([len(g) for g in got])])
                elif len(text) > 2 * STEP:
                    ids = self.long(text)
                    at = np.array([0, len(ids)])
                else:
                    ids, at = self.words(text, base[a : b + 1] - base[a])
                if end is not None:
                    ids, at = np.insert(ids, at[1:], end), at + np.arange(len(at))
                out.append(ids)
                sizes.append(np.diff(at))
        return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode(data, np.array([0, len(data)]))[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each path and process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
