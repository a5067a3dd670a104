"""Harmonic packing of documents' ids into sequences of ``CAPACITY``.

Lengths are classed by the reciprocal of the capacity C: class k holds lengths in (C / (k + 1), C / k], and each of its
sequences takes exactly k of them. As documents may be cut, cuts are made at the classes' upper bounds floor(C / k):
whole sequences first, then the rest by the bounds that cost the least, a piece counting as ``PIECE`` ids of padding
(1,023 ids are 512 + 341 + 170). A sequence of class k has fewer than k ids of padding. Each worker numbers the pieces
of each class in its own part of the table; only the counts by part and class are summed up over all parts, and from
them every worker knows its sequences: no piece moves. What a class has left over, fewer than k pieces, is a number of
pieces bounded by C alone; the classes' left pieces fill common sequences, the longest first, each where it fits first.

Edge cases: null and empty texts have one piece, the end id; repeated doc_ids and rows without doc_id are packed each;
a very long text is cut like any other; an empty table gives no pieces; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import flat, materialize, tidy
from .tokens import encoder, ids_crc32

CAPACITY, END, PIECE = 1024, 0, 8


@lru_cache
def rests(capacity: int) -> list[tuple[int, ...]]:
    """For each length below the capacity, the class bounds that it is cut into at the least cost, in falling order."""
    bounds = sorted({capacity // k for k in range(2, capacity + 1)})
    padding = {s: (capacity % s) / (capacity // s) for s in bounds}
    cost, last = [0.0], [0]
    for n in range(1, capacity):
        best = min(((cost[n - s] + PIECE + padding[s], -s) for s in bounds if s <= n))
        cost.append(best[0])
        last.append(-best[1])
    out: list[tuple[int, ...]] = [()]
    for n in range(1, capacity):
        out.append(tuple(sorted((last[n], *out[n - last[n]]), reverse=True)))
    return out


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, then the rest by class bounds."""
    whole = n // capacity * capacity
    out = [(a, capacity) for a in range(0, whole, capacity)]
    for size in rests(capacity)[n - whole]:
        out.append((whole, size))
        whole += size
    return out


def pieces(docs: DataFrame, path: str, *, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its checksum, its part of the table, and its number in its part and class."""
    schema = docs.select("doc_id").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens", "part", "number"):
        schema = schema.add(name, "long")

    def run(batches):
        encode, part = encoder(path), TaskContext.get().partitionId()
        seen = dict.fromkeys((capacity // k for k in range(1, capacity + 1)), 0)
        for batch in batches:
            row, out = [], []
            ids, at = encode.encode(*flat(batch.column(1)), end)
            ids = ids.astype("<u4")
            for i, (first, stop) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                for a, size in cuts(stop - first, capacity):
                    row.append(i)
                    out.append((a, size, ids_crc32(ids[first + a : first + a + size]), stop - first, part, seen[size]))
                    seen[size] += 1
            columns = np.array(out, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *map(pa.array, np.ascontiguousarray(columns))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def shared_sequences(left: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(length, slot, sequence, offset) of each class's left pieces (their number by length), first fit, longest first."""
    free, out = [], []
    for size in sorted(left, reverse=True):
        at = 0
        for slot in range(left[size]):
            while at < len(free) and free[at] < size:
                at += 1
            if at == len(free):
                free.append(capacity)
            out.append((size, slot, at, capacity - free[at]))
            free[at] -= size
    return out


def pack(docs: DataFrame, path: str, *, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    made = materialize(pieces(docs, path, end=end, capacity=capacity), "pieces")
    counts = materialize(made.groupBy("part", "length").agg(F.count("*").alias("n")), "counts", light=True)
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a class
    rest = shared_sequences({size: n % (capacity // size) for size, n in totals.items()}, capacity)
    bounded = docs.sparkSession.createDataFrame(rest, "length long, slot long, shared long, at long")  # bounded by the capacity
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    whole = docs.sparkSession.createDataFrame([(size, n // (capacity // size) * (capacity // size)) for size, n in totals.items()], "length long, whole long")
    counts = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")).join(F.broadcast(whole), "length")
    k = (F.lit(capacity) / F.col("length")).cast("long")
    placed = made.join(counts, ["part", "length"]).withColumns({"k": k, "rank": F.col("before") + F.col("number")})
    placed = placed.withColumn("slot", F.when(F.col("rank") >= F.col("whole"), F.col("rank") - F.col("whole")))
    placed = placed.join(F.broadcast(bounded), ["length", "slot"], "left")
    bin_ = F.floor(F.col("rank") / F.col("k")).cast("long")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(F.col("slot").isNull(), bin_ * (capacity + 1) + F.col("length")).otherwise(F.col("shared") * (capacity + 1)).alias("sequence_id"),
        F.when(F.col("slot").isNull(), F.col("rank") % F.col("k") * F.col("length")).otherwise(F.col("at")).alias("offset"),
    )


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def stage_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents that are left, null and empty texts and repeated rows included."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
