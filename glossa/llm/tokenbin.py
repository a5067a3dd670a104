"""Token ids as binary blocks: canonical length-limited Huffman codes from global counts, decoded by table.

Format. A dataset is a folder with a code book and blocks, each a binary value in a table that Spark writes and commits
(so a lost executor's files are written anew, on any file system); nothing else is needed to read it. Code book
(``book``): length of each id's code, one byte an id, and their crc32; codes are canonical, sorted by (length, id), at
most ``LIMIT`` bits. Block (``blocks``): ``HEAD`` (magic, documents, ids, bytes of payload, ids between checkpoints),
then doc_id, whether it is null, first id's number in the file, and number of ids of each document, bit offsets of the
checkpoints, payload (first bit highest), and a crc32 of all that. Blocks decode independently, and within one all runs
between checkpoints decode in step, by one table look-up an id.

Ids are computed once and kept in the shared work folder; one scan counts them, another deals them by range of doc_id,
encodes and writes them in ascending order. Only counts (one row an id of the vocabulary) reach the driver.

Edge cases: null and empty texts have the end id only; repeated doc_ids stay in order of their ids; rows without
doc_id come first; a document longer than a block is a block of its own; an empty table has no blocks and no rows; other
columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, flat, materialize, tidy, work_folder
from .tokens import encoder, ids_crc32

LIMIT, END, BLOCK, EVERY = 16, 2, 1 << 17, 64
HEAD, MAGIC = struct.Struct("<4sIQQI"), b"HUF1"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, marks = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both, leaf = np.concatenate([leaves, pairs]), np.arange(len(leaves) + len(pairs)) < len(leaves)
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        marks.append(leaf[rank])
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for mark in reversed(marks):
        n = int(mark[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


class Book:
    """Canonical codes of the given lengths, and the decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint64)
        self.bits = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        span = np.uint64(1) << (np.uint64(self.bits) - self.lengths[order])
        at = np.concatenate([[np.uint64(0)], np.cumsum(span)]).astype(np.uint64)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = at[:-1] >> (np.uint64(self.bits) - self.lengths[order])
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.symbol[: int(at[-1])] = np.repeat(order, span.astype(np.int64))
        self.size = lengths[self.symbol].astype(np.int64)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Payload, and the bit offset of every EVERY-th id."""
        size, code = self.lengths[ids], self.codes[ids]
        end = np.cumsum(size, dtype=np.uint64)
        at = end - size
        words = np.zeros(int(end[-1] >> np.uint64(6)) + 2 if len(ids) else 0, np.uint64)
        if len(ids):
            word, room = (at >> np.uint64(6)).astype(np.int64), 64 - (at & np.uint64(63)).astype(np.int64) - size.astype(np.int64)
            here = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] = np.bitwise_or.reduceat(here, first)
            over = np.flatnonzero(room < 0)
            words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8").tobytes(), at[::EVERY].astype("<u8")

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All runs between checkpoints in step."""
        b = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        peek = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        at, out = checkpoints.astype(np.int64), np.empty((len(checkpoints), EVERY), np.uint32)
        last, low = 8 * len(payload), 32 - self.bits
        for k in range(EVERY):
            index = (peek[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(low)
            out[:, k] = self.symbol[index]
            at = np.minimum(at + self.size[index], last)
        return out.reshape(-1)[:n]


def write_block(book: Book, docs: list[tuple[int | None, bytes]], dtype: np.dtype, start: int) -> tuple[bytes, int]:
    """A block of (doc_id, ids as bytes); start: ids of the file's documents before these."""
    ids = np.frombuffer(b"".join(d[1] for d in docs), dtype)
    sizes = np.array([len(d[1]) // dtype.itemsize for d in docs], "<i8")
    payload, checkpoints = book.encode(ids)
    starts = start + np.concatenate([[0], np.cumsum(sizes)[:-1]])
    body = HEAD.pack(MAGIC, len(docs), len(ids), len(payload), EVERY) + np.array([d[0] or 0 for d in docs], "<i8").tobytes() + np.array([d[0] is None for d in docs], "u1").tobytes() + starts.astype("<i8").tobytes() + sizes.tobytes() + checkpoints.tobytes() + payload
    return body + struct.pack("<I", zlib.crc32(body)), len(ids)


def read_block(book: Book, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, null, first id's number in the file and number of ids of each document, and all ids."""
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a block's checksum is wrong")
    magic, docs, n, size, every = HEAD.unpack_from(block)
    if magic != MAGIC or every != EVERY:
        raise ValueError("not a block of this format")
    at, out = HEAD.size, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<i8", docs), ("<u8", -(-n // EVERY))):
        out.append(np.frombuffer(block, kind, count, at))
        at += out[-1].nbytes
    return *out[:4], book.decode(block[at : at + size], out[4], n)


def token_ids(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id and all ids of every whole text as little-endian bytes, the end id last."""
    schema = docs.select("doc_id").schema.add("ids", "binary")

    def run(batches):
        encode = encoder(path)
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, len(b), 1024)):
            ids, at = encode.encode(*flat(batch.column(1)), end)
            raw = memoryview(ids.astype(encode.dtype).tobytes())
            size = encode.dtype.itemsize
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[size * a : size * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def count_ids(ids: DataFrame, vocab: int, dtype: np.dtype) -> np.ndarray:
    """How often each id occurs; a task sends one row an id, the driver gets one row an id of the vocabulary."""

    def run(batches):
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            data, _ = flat(batch.column(0))
            for i in range(0, len(data), 1 << 20):
                total += np.bincount(data[i : i + (1 << 20)].view(dtype), minlength=vocab)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = np.zeros(vocab, np.int64)
    for id_, n in ids.select("ids").mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[id_] = n
    return counts


def write_tokens(docs: DataFrame, path: str, folder: str, *, end: int = END, block: int = BLOCK) -> None:
    """Write the code book (folder/book) and the blocks (folder/blocks), their parts in ascending order of doc_id."""
    encode = encoder(path)
    dtype, vocab = encode.dtype, max(encode.vocab, end + 1)
    ids = materialize(token_ids(docs, path, end), "ids", compression="zstd")
    lengths = code_lengths(count_ids(ids, vocab, dtype)).tobytes()
    spark = docs.sparkSession
    spark.createDataFrame([(MAGIC.decode(), bytearray(lengths), zlib.crc32(lengths))], "magic string, lengths binary, crc32 long").coalesce(1).write.parquet(f"{folder}/book")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        book, part = Book(np.frombuffer(lengths, np.uint8)), TaskContext.get().partitionId()
        held, size, start, number = [], 0, 0, 0

        def put():
            body, n = write_block(book, held, dtype, start)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([n], pa.int64()), pa.array([body], pa.binary())], names=["part", "block", "n_tokens", "body"]), n

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((doc, raw.as_py()))
                size += len(held[-1][1]) // dtype.itemsize
                if size >= block:
                    out, n = put()
                    yield out
                    held, size, start, number = [], 0, start + n, number + 1
        if held:
            yield put()[0]

    blocks = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(tidy(run), "part long, block long, n_tokens long, body binary")
    blocks.write.parquet(f"{folder}/blocks")
    discard(ids)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files alone."""
    magic, lengths, crc = spark.read.parquet(f"{folder}/book").first()  # a byte an id of the vocabulary
    lengths = bytes(lengths)
    if magic != MAGIC.decode() or zlib.crc32(lengths) != crc:
        raise ValueError("not a code book of this format")
    blocks = spark.read.schema("part long, block long, n_tokens long, body binary").parquet(f"{folder}/blocks")

    def run(batches):
        book = Book(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for part, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc, null, start, size, ids = read_block(book, body.as_py())
                at = np.concatenate([[0], np.cumsum(size)])
                crc = [ids_crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(doc), pa.int64()), pa.array(doc, mask=null.astype(bool)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = blocks.select("part", "body").mapInArrow(tidy(run), "part long, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_binary(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{work_folder(spark)}/tokens"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_tokens(spark, folder)
