"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared lower-cased, with every run of characters that are neither letters nor digits as one
space. An item of m characters may differ from a passage by k = floor(m * rate) edits. Cut into k + 1 pieces, at least
one piece must occur exactly in any such passage; an Aho-Corasick automaton finds all pieces in one scan of the text.
Around each hit, Myers' bit-parallel algorithm computes the smallest edit distance of the whole item to any part of
the text there. An item of fewer than ``MIN_ITEM`` characters has no budget for an edit and is found as a run of whole
words. The items are a stated, small set: they are read in blocks of bounded size, and each block scans all documents,
without a shuffle.

Edge cases: null and empty texts match nothing, empty items nothing; rows are judged one by one, whether they repeat a
doc_id or have none; repeated items are each reported; an empty table on either side gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import shielded, tidy

RATE, MIN_ITEM, BLOCK_CHARS = 0.08, 16, 1_000_000
APART = regex.compile(r"[^\p{L}\p{N}]+")


def normalised(text: str | None) -> str:
    return APART.sub(" ", (text or "").lower()).strip()


def pieces(item: str, k: int) -> Iterator[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return ((a, item[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True))


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of pattern to any part of text, and the part's end (the first one)."""
    m, masks = len(pattern), defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    masks = dict(masks)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | (full & ~(d0 | vp))
        hn = vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        x = (hp << 1) & full
        vp = ((hn << 1) | ~(d0 | x)) & full
        vn = x & d0
        if score < best:
            best, end = score, j + 1
    return best, end


def best_match(item: str, k: int, text: str, places: list[int]) -> tuple[int, int, int] | None:
    """(distance, start, end) of the item's best passage near the places where it could begin, if within k edits."""
    places.sort()
    found, a = None, 0
    while a < len(places):
        b = a
        while b + 1 < len(places) and places[b + 1] - places[b] <= 2 * k + 1:
            b += 1
        lo, hi = max(0, places[a] - k), min(len(text), places[b] + len(item) + k)
        distance, end = myers(item, text[lo:hi])
        if distance <= k and (found is None or distance < found[0]):
            found = distance, lo, lo + end
            if distance == 0:
                break
        a = b + 1
    if found is None:
        return None
    distance, lo, end = found
    return distance, end - myers(item[::-1], text[lo:end][::-1])[1], end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(len(t) * rate) if len(t) >= MIN_ITEM else -1) for i, t in items]
        by = defaultdict(list)
        for n, (_, t, k) in enumerate(self.items):
            if k < 0:
                by[f" {t} "].append((n, 0))
            else:
                for at, piece in pieces(t, k):
                    by[piece].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in by.items():
            self.automaton.add_word(piece, (len(piece), places))
        if by:
            self.automaton.make_automaton()
        self.any = bool(by)

    def begins(self, text: str) -> dict[int, set[int]]:
        """Where in the normalised text each item could begin, by the pieces found; short items are found whole."""
        out = defaultdict(set)
        if self.any and text:
            for end, (size, places) in self.automaton.iter(f" {text} "):
                for n, at in places:
                    out[n].add(end - size - at + (self.items[n][2] < 0))
        return out

    def match(self, n: int, text: str, places: set[int]) -> tuple[int, int, int] | None:
        _, pattern, k = self.items[n]
        return best_match(pattern, k, text, list(places)) if k >= 0 else (0, min(places), min(places) + len(pattern))

    def find(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) for every item that the text holds."""
        text = normalised(raw)
        return [(self.items[n][0], *hit) for n, places in self.begins(text).items() if (hit := self.match(n, text, places)) is not None]

    def holds_any(self, raw: str | None) -> bool:
        text = normalised(raw)
        return any(self.match(n, text, places) is not None for n, places in self.begins(text).items())


def blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for item, text in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if plain := normalised(text):
            block.append((item, plain))
            size += len(plain)
            if size >= limit:
                yield block
                block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, distance, and the passage in the normalised text."""
    schema = docs.select("doc_id").schema.add("item_id", "long").add("distance", "integer").add("start", "integer").add("stop", "integer")
    parts = []
    for items in blocks(benchmark, limit):

        def run(batches, items=items):
            matcher = Matcher(items, rate)
            for batch in batches:
                ids, hits = [], []
                for i, text in enumerate(batch.column(1)):
                    found = matcher.find(text.as_py())
                    ids += [i] * len(found)
                    hits += found
                columns = list(zip(*hits, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *[pa.array(c, f.type) for c, f in zip(columns, (pa.field("", t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32())), strict=True)]], names=schema.names)

        parts.append(docs.select("doc_id", "text").mapInArrow(tidy(run), schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def clean(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that hold a test item; a block of items judges what the one before has left."""
    for items in blocks(benchmark, limit):

        def run(batches, items=items):
            matcher = Matcher(items, rate)
            for batch in batches:
                text = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not matcher.holds_any(t.as_py()) for t in text], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a test item go.

    Null and empty texts stay; each row is judged by its own text; an empty table gives an empty one; columns of any other
    name pass through.
    """
    plain, restore = shielded(docs, "text")
    return restore(clean(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
