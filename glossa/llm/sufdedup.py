"""Removal of byte strings of ``LENGTH`` that also start earlier, by bucket-pointer refinement of suffixes.

Sorting every suffix of a corpus would move far more than the corpus. Equal strings of LENGTH bytes have the same
smallest ``GRAM``-gram hash at the same place, so each window of LENGTH bytes is filed under that gram, its anchor:
the initial q-gram bucket. A run of neighbouring windows with one anchor makes one row: bucket, a 64-bit hash of the
run's bytes, doc_id, start, number of windows; about one row in thirty bytes, without text.

1. Anchors: one scan, one shuffle by bucket. As rows of a bucket stream by in the order of (bytes' hash, doc_id,
   start), every run but the first of its bytes is marked repeated. Within a batch of documents that is done before
   the shuffle, so a hot bucket sends one row a batch. First runs of buckets that hold several kinds of bytes go on.
2. Refinement: the bytes of those runs only are dealt by bucket, end to end as one text per batch of buckets, and
   suffixes are sorted: positions start in buckets of their first 8 bytes; buckets of several positions are refined by
   the bucket identifiers of the positions 8, 16, 32 bytes later, each round using the identifiers that the one before
   has updated, until 100 bytes are told apart. Of equal windows all but the first (doc_id, start) are repeated. Buckets
   of more than ``HOT`` runs are dealt by window instead, with the first of each window found by pre-aggregation.
3. One pass over all texts with their repeated windows takes the bytes out; windows that repeat a run inside one
   document are found there again.

Edge cases: null and empty texts and those of fewer bytes than LENGTH keep everything; very long texts are scanned in
blocks; rows equal in doc_id and text count as one document; rows of a doc_id that has several texts, and rows without
doc_id, have no place in the order: they lose only what they repeat themselves and give nothing to others; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, discard, flat, join_sized, materialize, mix, powers, slices, text_print, tidy

LENGTH, GRAM, HOT, BATCH = 100, 32, 2_000, 2 << 20
SMALL = 4 << 20  # bytes of spans that may be broadcast; beyond that texts are dealt by doc_id
BLOCK = 1 << 19
PLACE_BITS = np.uint64(22)
PLACES = np.uint64((1 << 22) - 1)
ODD = [np.uint64(pow(BASE, 2 * k + 3, 1 << 64) | 1) for k in range(GRAM // 8)]


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position that has them."""
    n = len(data) - 7
    eight = np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
    m = len(data) - GRAM + 1
    out = mix(eight[:m] * ODD[0])
    for k in range(1, GRAM // 8):
        out += eight[8 * k : 8 * k + m] * ODD[k]
        out ^= out >> np.uint64(29)
        out *= ODD[-k]
    return mix(out)


def block_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, bucket, hash of the run's bytes.

    data holds texts that end at ends; windows that cross texts are left out.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = grams(data)
    least = (h & ~PLACES) | np.arange(len(h), dtype=np.uint64)
    span, width = 1, LENGTH - GRAM + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    anchor = (least & PLACES).astype(np.int64)
    for end in ends[:-1]:
        anchor[max(0, end - LENGTH + 1) : end] = -1
    change = np.flatnonzero(np.diff(anchor, prepend=-2))
    many = np.diff(change, append=n)
    inside = anchor[change] >= 0
    start, many = change[inside], many[inside]
    up, down = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    stop = start + many - 1 + width  # grams of the run's bytes
    whole = mix((total[stop] - total[start]) * down[start] + (anchor[start] - start).astype(np.uint64) * ODD[1] + many.astype(np.uint64))
    return start, many, h[anchor[start]], whole


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """block_runs of texts end to end, with the text of each run; starts are in the text."""
    out = [tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))]
    for i, j in slices(offsets, BLOCK):
        a, b = offsets[i], offsets[j]
        if j == i + 1:  # a text that may be longer than a block
            for at in range(0, max(1, b - a - LENGTH + 1), BLOCK):
                start, *rest = block_runs(data[a + at : min(b, a + at + BLOCK + LENGTH - 1)], np.array([b]))
                out.append((np.full(len(start), i), start + at, *rest))
        else:
            start, *rest = block_runs(data[a:b], offsets[i + 1 : j + 1] - a)
            row = np.searchsorted(offsets[i : j + 1] - a, start, "right") - 1
            out.append((row + i, start - (offsets[i:j] - a)[row], *rest))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def beyond_first(new: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows of sorted groups (new: a group begins) are at another place than their group's first row."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc != doc[first]) | (start != start[first])


def earlier_first(bucket: np.ndarray, whole: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which runs come after another of the same bytes in the order of (doc, start)."""
    order = np.lexsort((start, doc, whole, bucket))
    bucket, whole = bucket[order], whole[order]
    new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (whole[1:] != whole[:-1])])[: len(order)]
    out = np.zeros(len(order), bool)
    out[order] = beyond_first(new, doc[order], start[order])
    return out


NEW, REPEATED = 0, 1


def anchored(docs: DataFrame) -> DataFrame:
    """(bucket, whole, doc_id, start and number of windows): runs that are first in their batch, and repeated ones of other documents."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = flat(batch.column(1))
            parts = []
            for i, j in slices(offsets, 4 << 20):
                row, start, many, bucket, whole = runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts.append((ids[i + row], start, many, bucket, whole))
            if not parts:
                continue
            doc, start, many, bucket, whole = (np.concatenate(c) for c in zip(*parts, strict=True))
            again = earlier_first(bucket, whole, doc, start)
            # a run that its own document has before is found again in the last pass; only other documents' need a row
            order = np.lexsort((start, whole, bucket, doc))
            own = np.zeros(len(order), bool)
            own[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (bucket[order[1:]] == bucket[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])
            keep = ~own
            salt = mix(doc.astype(np.uint64) * ODD[0] + start.astype(np.uint64))
            bucket = np.where(again, salt, bucket)[keep].view(np.int64)
            size = (start << 8 | many << 1 | again)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(whole[keep].view(np.int64)), pa.array(doc[keep]), pa.array(size)], names=["bucket", "whole", "doc_id", "size"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "bucket long, whole long, doc_id long, size long")


def marked(rows: DataFrame) -> DataFrame:
    """Repeated runs, and the first runs of buckets with several kinds of bytes, from rows streaming by in order."""

    def run(batches):
        # last row's (bucket, whole), its kind's first place, a bucket's first run until a second kind turns up
        last, head, held = None, (0, 0), None
        for batch in batches:
            if not len(batch):
                continue
            bucket, whole, doc, size = (batch.column(k).to_numpy() for k in range(4))
            known = (size & 1).astype(bool)
            new_bucket = np.concatenate([[last is None or bucket[0] != last[0]], bucket[1:] != bucket[:-1]])
            new_whole = new_bucket | np.concatenate([[last is None or whole[0] != last[1]], whole[1:] != whole[:-1]])
            start = size >> 8
            again = beyond_first(new_whole, doc, start)
            if not new_whole[0]:
                lead = int(np.argmax(new_whole)) if new_whole.any() else len(new_whole)
                again[:lead] = (doc[:lead] != head[0]) | (start[:lead] != head[1])
            if new_whole.any():
                at = len(new_whole) - 1 - int(np.argmax(new_whole[::-1]))
                head = (doc[at], start[at])
            again |= known
            second = new_whole & ~new_bucket  # a further kind of bytes in the bucket
            first = np.flatnonzero(new_bucket & ~known)
            number = np.cumsum(new_bucket)
            several = np.zeros(number[-1] + 1, bool)
            several[number[second]] = True
            out = again | second
            out[first[several[number[first]]]] = True
            extra = held if held is not None and several[0] else None
            if extra is not None:
                held = None
            tail = first[number[first] == number[-1]]
            if number[-1] > 0:
                held = None
                if len(tail) and not several[number[-1]]:
                    held = (bucket[tail[0]], doc[tail[0]], size[tail[0]])
            last = (bucket[-1], whole[-1])
            columns = [bucket[out], doc[out], size[out] >> 8, (size[out] >> 1) & 127, again[out].astype(np.int64)]
            if extra is not None:
                columns = [np.append(c, x) for c, x in zip(columns, (extra[0], extra[1], extra[2] >> 8, (extra[2] >> 1) & 127, NEW), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "doc_id", "start", "many", "kind"])

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "whole", "doc_id", "size")
    return dealt.mapInArrow(tidy(run), "bucket long, doc_id long, start long, many long, kind long")


def refined(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket identifiers of all positions of text: equal just where the next length bytes are (zeros follow the end)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    initial = np.ndarray((n + length,), "<u8", padded, strides=(1,))
    _, bucket, sizes = np.unique(initial, return_inverse=True, return_counts=True)
    bucket = bucket.astype(np.int64)
    live = np.flatnonzero(sizes[bucket] > 1)
    depth, after = 8, int(bucket.max(initial=0)) + 1
    while depth < length and len(live):
        step = min(depth, length - depth)
        later = bucket[np.minimum(live + step, n + length - 1)]  # identifiers that earlier rounds have updated
        order = np.lexsort((later, bucket[live]))
        one, two = bucket[live][order], later[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        rank = np.cumsum(new) - 1
        bucket[live[order]] = after + rank
        counts = np.bincount(rank)
        after += len(counts)
        live = np.sort(live[order][counts[rank] > 1])
        depth += step
    return bucket[:n]


def repeated_windows(doc: np.ndarray, start: np.ndarray, many: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For the windows of runs (their bytes in data) end to end: whether an equal one has a smaller (doc, start)."""
    bucket = refined(data)
    first = np.repeat(np.cumsum(many) - many, many)
    step = np.arange(len(first)) - first
    here = bucket[np.repeat(offsets[:-1], many) + step]
    place, owner = np.repeat(start, many) + step, np.repeat(doc, many)
    order = np.lexsort((place, owner, here))
    new = np.concatenate([[True], here[order[1:]] != here[order[:-1]]])[: len(order)]
    out = np.zeros(len(order), bool)
    out[order] = beyond_first(new, owner[order], place[order])
    return out


def spans(doc: np.ndarray, start: np.ndarray, many: np.ndarray, repeated: np.ndarray) -> list[np.ndarray]:
    """Runs of repeated windows as doc, first window, number of windows."""
    owner = np.repeat(np.arange(len(doc)), many)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    at = np.flatnonzero(repeated)
    new = np.concatenate([[True], (owner[at[1:]] != owner[at[:-1]]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
    head = at[new]
    return [doc[owner[head]], start[owner[head]] + step[head], np.diff(np.flatnonzero(new), append=len(at))]


def own_repeats(text: np.ndarray, start: np.ndarray, many: np.ndarray, bucket: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """First window (plus base) and number of windows of the runs of windows that one text repeats itself."""
    _, inverse, counts = np.unique(bucket, return_inverse=True, return_counts=True)
    start, many = (x[counts[inverse] > 1] for x in (start, many))
    if not len(start):
        return start, many
    data = np.concatenate([text[a : a + n + LENGTH - 1] for a, n in zip(start, many, strict=True)])
    repeated = repeated_windows(np.zeros(len(start), np.int64), start, many, data, np.concatenate([[0], np.cumsum(many + LENGTH - 1)]))
    _, first, number = spans(np.zeros(len(start), np.int64), start, many, repeated)
    return base + first, number


SPAN = "doc_id long, start long, many long"


def refine(runs_: DataFrame, docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Repeated windows of the given first runs, told apart by their bytes; and the work tables behind them."""
    sizes = materialize(runs_.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT).withColumn("hot", F.lit(1)).select("bucket", "hot"), "hot", light=True)
    flagged = join_sized(runs_, sizes, "bucket", "hot")
    lists = materialize(flagged.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "start", "many", F.coalesce("hot", F.lit(0)).alias("hot"))).alias("runs")), "lists")
    texts = join_sized(docs.select("doc_id", "text"), lists, "doc_id", "runs", limit=SMALL).where("runs IS NOT NULL")

    def cut(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = flat(batch.column(1))
            lists = batch.column(2)
            at = lists.offsets.to_numpy().astype(np.int64)
            bucket, start, many, hot = (lists.values.field(k).to_numpy() for k in range(4))
            out: list[list] = [[] for _ in range(7)]
            held = 0
            for i in range(len(ids)):
                for k in range(at[i], at[i + 1]):
                    a = offsets[i] + start[k]
                    raw = data[a : a + many[k] + LENGTH - 1].tobytes()
                    if hot[k]:
                        for w in range(many[k]):
                            one = xxhash.xxh3_128_intdigest(raw[w : w + LENGTH])
                            row = (0, ids[i], start[k] + w, 1, None, (one >> 64) - (1 << 63), (one & ((1 << 64) - 1)) - (1 << 63))
                            for column, value in zip(out, row, strict=True):
                                column.append(value)
                    else:
                        for column, value in zip(out, (bucket[k], ids[i], start[k], many[k], raw, None, None), strict=True):
                            column.append(value)
                        held += len(raw)
                if held >= BATCH or len(out[0]) >= 100_000 or i + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == 4 else pa.int64()) for n, c in enumerate(out)], names=["bucket", "doc_id", "start", "many", "raw", "one", "two"])
                    out, held = [[] for _ in range(7)], 0

    rows = materialize(texts.mapInArrow(tidy(cut), "bucket long, doc_id long, start long, many long, raw binary, one long, two long"), "runs")

    def sort(batches):
        held, size, last = [], 0, None

        def flush():
            doc, start, many, data, lens = (np.concatenate(c) for c in zip(*held, strict=True))
            repeated = repeated_windows(doc, start, many, data, np.concatenate([[0], np.cumsum(lens)]))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in spans(doc, start, many, repeated)], names=["doc_id", "start", "many"])

        for batch in batches:
            if not len(batch):
                continue
            bucket = batch.column(0).to_numpy()
            data, offsets = flat(batch.column(4))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            i = 0
            for j in cuts[1:]:
                ends = j == cuts[-1]
                if offsets[j] - offsets[i] >= BATCH or ends:
                    if held and size >= BATCH and bucket[i] != last:
                        yield flush()
                        held, size = [], 0
                    held.append(tuple(batch.column(k).to_numpy()[i:j] for k in (1, 2, 3)) + (data[offsets[i] : offsets[j]], np.diff(offsets[i : j + 1])))
                    size, last, i = size + offsets[j] - offsets[i], bucket[j - 1], j
        if held:
            yield flush()

    cold = rows.where("raw IS NOT NULL").select("bucket", "doc_id", "start", "many", "raw")
    out = cold.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(sort), SPAN)
    hot = rows.where("raw IS NULL").select("doc_id", "start", "one", "two")
    first = hot.groupBy("one", "two").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = hot.join(first, ["one", "two"]).where(~F.struct("doc_id", "start").eqNullSafe(F.col("first")))
    return out.unionByName(later.select("doc_id", "start", F.lit(1).cast("long").alias("many"))), [sizes, lists, rows]


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text_print()).alias("one"), F.max(text_print()).alias("two"))
    several = materialize(prints.where("one <> two").select("doc_id", F.lit(True).alias("alone")), "several", light=True)
    docs = join_sized(docs, several, "doc_id", "alone").withColumn("alone", F.col("doc_id").isNull() | F.coalesce("alone", F.lit(False)))
    keyed = docs.where("NOT alone AND text IS NOT NULL").drop("alone")
    found = materialize(marked(anchored(keyed)), "marked")
    more, work = refine(found.where(F.col("kind") == NEW).drop("kind"), keyed)
    more = materialize(more, "refined")
    discard(*work)
    gone = found.where(F.col("kind") == REPEATED).select("doc_id", "start", "many").unionByName(more)
    lists = materialize(gone.groupBy("doc_id").agg(F.collect_list(F.struct("start", "many")).alias("gone")), "gone")
    discard(found, more)
    joined = join_sized(docs, lists, "doc_id", "gone", limit=SMALL).select("doc_id", "text", "alone", "gone")

    def take(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            lists, alone = batch.column(3), batch.column(2).to_numpy(zero_copy_only=False)
            at, rows = lists.offsets.to_numpy().astype(np.int64), lists.is_valid().to_numpy(zero_copy_only=False)
            first, number = (lists.values.field(k).to_numpy() for k in (0, 1))
            for i, j in slices(offsets, 1 << 20):
                raw, base = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                row, start, many, bucket, whole = runs(raw, base)
                again = earlier_first(bucket ^ mix(row.astype(np.uint64)), whole, row, start)
                mine = np.arange(at[i], at[j])
                owner = np.repeat(np.arange(j - i), np.where(rows[i:j], np.diff(at[i : j + 1]), 0))
                own = [own_repeats(raw[base[k] : base[k + 1]], start[row == k], many[row == k], bucket[row == k], base[k]) for k in np.flatnonzero(alone[i:j])]
                begin = np.concatenate([base[row[again]] + start[again], base[owner] + first[mine], *(x[0] for x in own)])
                length = np.concatenate([many[again], number[mine], *(x[1] for x in own)]) + LENGTH - 1
                edge = np.bincount(begin, minlength=len(raw) + 1) - np.bincount(begin + length, minlength=len(raw) + 1)
                bad = np.cumsum(edge[:-1]) > 0
                opens = bad.copy()
                opens[1:] &= ~bad[:-1]
                opens[base[:-1][np.diff(base) > 0]] = bad[base[:-1][np.diff(base) > 0]]
                total = [np.concatenate([[0], np.cumsum(x)]) for x in (bad, opens)]
                kept = [raw[a:b][~bad[a:b]].tobytes() for a, b in zip(base[:-1], base[1:], strict=True)]
                columns = [np.diff(base), *[t[base[1:]] - t[base[:-1]] for t in total]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(tidy(take), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
