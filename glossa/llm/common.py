"""Shared helpers: work folder, Arrow buffers as numpy arrays, hashing of byte strings."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX_1, MIX_2, BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), 0x9E3779B97F4A7C15
UPPER_TO_LOWER = np.arange(256, dtype=np.uint8)
UPPER_TO_LOWER[65:91] += 32


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session may leave that unset: it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="glossa-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/glossa-{uuid.uuid4().hex}"


ARROW_ROWS = 2_000


def bound_batches(spark: SparkSession) -> None:
    """Python workers of this session get at most ARROW_ROWS rows at once from now on: whole texts stay within memory.

    The setting is only lowered and never put back, so that queries that run side by side don't disturb each other.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def tidy(run):
    """The generator function, after which the Python worker gives back memory that it has freed but still holds.

    Workers are used again by later tasks, of other operators too.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # the C library may be another one
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def materialize(df: DataFrame, name: str, compression: str = "snappy", *, light: bool = False) -> DataFrame:
    """Write df as Parquet into the shared work folder and read it back: lineage ends here.

    light: a table of few rows, of a last stage with little work, is written by about as many tasks as there are cores
    instead of one file a partition. Adaptive execution still deals the shuffles before it.
    """
    if light:
        df = df.coalesce(max(8, df.sparkSession.sparkContext.defaultParallelism))
    spark, path = df.sparkSession, f"{work_folder(df.sparkSession)}/{name}"
    bound_batches(spark)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize that nothing is read from any more."""
    for table in tables:
        spark, path = table.sparkSession, table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.work_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def fold(column: str, buckets: int):
    """crc32 of the column's text, modulo buckets."""
    return F.crc32(F.col(column).cast("string")) % buckets


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column end to end, and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes (one row may have more)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_1
    h ^= h >> np.uint64(33)
    h = h * MIX_2
    h ^= h >> np.uint64(33)
    return h


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i up to n at least."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        inverse = pow(BASE, -1, 1 << 64)
        out = []
        for base in (BASE, inverse):
            p = np.ones(size, np.uint64)
            k, step = 1, base
            while k < size:  # doubling: p[k:2k] = p[:k] * base ** k
                p[k : 2 * k] = p[:k] * np.uint64(step)
                k, step = 2 * k, step * step % (1 << 64)
            out.append(p)
        if len(_powers) > 2:
            _powers.clear()
        _powers[size] = (out[0], out[1])
    return _powers[size]


def range_hash(letters: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of letters[start:stop] that depend on the letters only, not on where they stand."""
    up, down = powers(len(letters) + 1)
    total = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(letters * up[: len(letters)], out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * MIX_2)


BROADCAST_BYTES = 32 << 20


def join_sized(docs: DataFrame, side: DataFrame, keys: str | list[str], value: str, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs with side's value of the same keys (null where there is none; null keys match).

    side, a written table, is broadcast if its rows and array entries take at most limit bytes (counted, 64 bytes a row and
    40 an entry); beyond that both sides are shuffled. The result is the same.
    """
    keys = [keys] if isinstance(keys, str) else keys
    weight = side.agg(F.count("*"), F.coalesce(F.sum(F.size(value)), F.lit(0)) if dict(side.dtypes)[value].startswith("array") else F.lit(0)).first()
    side = side.withColumnsRenamed({k: f"__key_{i}" for i, k in enumerate(keys)})
    if 64 * weight[0] + 40 * weight[1] <= limit:
        side = F.broadcast(side)
    same = [docs[k].eqNullSafe(side[f"__key_{i}"]) for i, k in enumerate(keys)]
    return docs.join(side, same, "left").drop(*[f"__key_{i}" for i in range(len(keys))])


def text_print(column: str = "text"):
    """64 bits of a text. doc_id and these tell rows apart: rows of one doc_id with other texts are other documents."""
    return F.xxhash64(F.col(column))


def shielded(docs: DataFrame, *need: str):
    """docs with all columns but the needed ones under names that clash with nothing, and a function that undoes it (more: names of further columns that stay)."""
    names = [c if c in need else f"__column_{i}" for i, c in enumerate(docs.columns)]
    back = list(docs.columns)
    return docs.toDF(*names), lambda out, *more: out.select(*[F.col(n).alias(c) for n, c in zip(names, back, strict=True)], *more)
