"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that are not blank (a line's identity: its bytes without blanks, tabs and
carriage returns at both ends). A run of at least ``RUN`` lines that also begins earlier (smaller doc_id, or earlier
in the same document) is deleted; judged on the input. So is a shorter run, down to one line, of at least ``WORDS`` words
(between ASCII blanks) or ``CHARS`` characters (for scripts without blanks): a passage counts however its lines break.

1. Winnowing: of every ``RUN`` consecutive lines the least line hash (the last of equal ones) is a fingerprint, so two
   equal runs of that length always select the same line. Each selected line is written once, with its place and the
   hashes of the lines around it, as far as the windows that selected it reach: fewer rows than lines.
2. Fingerprints that occur twice, found by an aggregate, are joined with all their places. Each place is extended both
   ways over the line hashes around it, window by window; a window that equals one at an earlier place (the first is
   found by an aggregate over windows) is a later repeat. Neighbouring stretches overlap, so repeats of any length grow
   together; their union is deleted.

A shorter run that counts is its own fingerprint. With words = 0 only runs of RUN lines count.

Pre-aggregation by fingerprint and by window runs before each shuffle; joins are plain equality joins of written tables,
which adaptive execution can split at hot keys; the texts are joined with their repeats in one pass at the end.

Edge cases: null texts stay null, blank lines stay and never count, texts without a run that counts stay whole;
rows equal in doc_id and text are one document; rows of one doc_id with other texts are documents of their own, in the
order of their texts' hashes; a null doc_id comes before all others; an empty table gives an empty result; other columns
pass through, but for ones named n_lines and n_removed, which the result replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, join_sized, materialize, mix, shielded, text_print, tidy

RUN = 3
WORDS, CHARS = 50, 400
BLANK = " \t\r"


def real_lines(text: str | None) -> list[str]:
    return [s for x in (text or "").split("\n") if (s := x.strip(BLANK))]


def minima(lines: np.ndarray, run: int, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: the selected line, the first window that selected it, and the number of these windows.

    lines may be those of several texts, end to end (owner: whose); windows that cross texts select nothing.
    """
    n = len(lines) - run + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    window = np.stack([lines[k : k + n] for k in range(run - 1, -1, -1)])
    place = np.arange(n) + run - 1 - window.argmin(0)
    if owner is not None:
        place[owner[:n] != owner[run - 1 :]] = -1
    first = np.flatnonzero(np.diff(place, prepend=-2))
    many, place = np.diff(first, append=n), place[first]
    return place[place >= 0], first[place >= 0], many[place >= 0]


def fingerprints(texts: list[str | None], run: int, words: int) -> tuple[np.ndarray, ...]:
    """Of each selected line of the texts, and (unless words is 0) of each shorter run of at least so many words or CHARS
    characters: text, fingerprint, first line, lines of a window, lines around, and the hashes of these, end to end, as two
    halves of 128 bits: the first selects and joins, both together say that lines are equal."""
    owner, hashes, held, chars = [], [], [], []
    for i, text in enumerate(texts):
        for line in real_lines(text):
            raw = line.encode()
            owner.append(i)
            hashes.append(xxhash.xxh3_128_digest(raw))
            held.append(len(raw.split()))
            chars.append(len(line))
    owner, halves = np.array(owner, np.int64), np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
    lines, others = np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])
    place, start, many = minima(lines, run, owner)
    parts = [(lines[place], start, np.full(len(start), run), many + run - 1)]
    if words:
        words_to, chars_to = (np.concatenate([[0], np.cumsum(x)]) for x in (np.array(held, np.int64), np.array(chars, np.int64)))
        for n in range(1, min(run - 1, len(lines)) + 1):
            fits = (words_to[n:] - words_to[:-n] >= words) | (chars_to[n:] - chars_to[:-n] >= CHARS)
            start = np.flatnonzero(fits & (owner[: len(lines) - n + 1] == owner[n - 1 :]))
            seed = np.full(len(start), n, np.uint64)
            for k in range(n):
                seed = mix(seed) + lines[start + k]
            parts.append((mix(seed), start, np.full(len(start), n), np.full(len(start), n)))
    seed, start, size, around = (np.concatenate(c) for c in zip(*parts, strict=True))
    end = np.cumsum(around)
    total = int(end[-1]) if len(end) else 0
    place = np.repeat(start - (end - around), around) + np.arange(total)
    begins = np.searchsorted(owner, np.arange(len(texts)))
    return owner[start], seed, start - begins[owner[start]], size, around, lines[place], others[place]


def repeated_runs(docs: DataFrame, *, run: int = RUN, words: int = WORDS) -> DataFrame:
    """doc_id, print (of the text) and its windows (first line, among those that are not blank, and lines) that occur earlier."""
    schema = docs.select("doc_id").schema
    for name, kind in (("print", "long"), ("seed", "long"), ("start", "long"), ("size", "integer"), ("around", T.ArrayType(T.LongType(), False)), ("others", T.ArrayType(T.LongType(), False))):
        schema = schema.add(name, kind)

    def select(batches):
        for batch in batches:
            row, seed, start, size, around, *halves = fingerprints(batch.column(2).to_pylist(), run, words)
            ends = pa.array(np.concatenate([[0], np.cumsum(around)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(half.view(np.int64))) for half in halves]
            columns = [pa.array(seed.view(np.int64)), pa.array(start.astype(np.int64)), pa.array(size.astype(np.int32)), *lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in (0, 1)), *columns], names=schema.names)

    seen = materialize(docs.select("doc_id", text_print().alias("print"), "text").mapInArrow(tidy(select), schema), "fingerprints")
    # each found first and written, so that adaptive execution can split the joins at hot keys
    twice = materialize(seen.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "twice", light=True)
    places = seen.join(twice, "seed").select("doc_id", "print", "start", "size", "around", "others", F.posexplode(F.expr("sequence(1, size(around) - size + 1)")).alias("k", "from"))
    place = F.struct("doc_id", "print", (F.col("start") + F.col("k")).alias("start"))
    part = lambda c: F.slice(c, F.col("from"), F.col("size"))
    windows = materialize(places.select(place.alias("place"), "size", F.concat(part("around"), part("others")).alias("lines")), "windows")
    first = materialize(windows.groupBy("lines").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first", light=True)
    later = windows.join(first, "lines").where(~F.col("place").eqNullSafe(F.col("first"))).select("place.*", "size")
    out = materialize(later.groupBy("doc_id", "print").agg(F.collect_set(F.struct("start", "size")).alias("gone")), "gone", light=True)
    discard(seen, twice, windows, first)
    return out


def dedup_lines(docs: DataFrame, *, run: int = RUN, words: int = WORDS) -> DataFrame:
    """docs with n_lines, n_removed and the text without its later repeated runs of lines."""
    docs = docs.drop("n_lines", "n_removed")
    plain, restore = shielded(docs, "doc_id", "text")
    gone = repeated_runs(plain, run=run, words=words)
    joined = join_sized(plain.withColumn("print", text_print()), gone, ["doc_id", "print"], "gone").drop("print")
    names, schema = plain.columns, plain.schema.add("n_lines", "long").add("n_removed", "long")

    def cut(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, lines, removed = batch.column(at).to_pylist(), [], []
            spans = batch.column(batch.schema.get_field_index("gone"))
            for i, (text, gone) in enumerate(zip(texts, spans, strict=True)):
                parts = (text or "").split("\n")
                real = [k for k, x in enumerate(parts) if x.strip(BLANK)]
                bad = {real[k] for s in gone.as_py() or () for k in range(s["start"], s["start"] + s["size"])}
                lines.append(len(real))
                removed.append(len(bad))
                if bad:
                    texts[i] = "\n".join(x for k, x in enumerate(parts) if k not in bad)
            columns = [pa.array(texts, batch.column(at).type) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=schema.names)

    out = joined.mapInArrow(tidy(cut), schema)
    return restore(out, "n_lines", "n_removed")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


OP2_SQL = """
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
real AS (
  SELECT doc_id, i, x, len(regexp_extract_all(x, '[^ \\t\\r\\x0b\\x0c]+')) AS words, length(x) AS chars,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS x FROM raw) WHERE x <> ''),
win AS (
  SELECT doc_id, i, p, x, lead(x, 1) OVER d AS x1, lead(x, 2) OVER d AS x2,
         words >= 50 OR chars >= 400 AS one, words + lead(words) OVER d >= 50 OR chars + lead(chars) OVER d >= 400 AS two
  FROM real WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
dup AS (
  SELECT doc_id, i, p,
         CASE WHEN one AND row_number() OVER (PARTITION BY x ORDER BY doc_id, p) > 1 THEN 1 ELSE 0 END AS d1,
         CASE WHEN two AND x1 IS NOT NULL AND row_number() OVER (PARTITION BY x, x1 ORDER BY doc_id, p) > 1 THEN 1 ELSE 0 END AS d2,
         CASE WHEN x2 IS NOT NULL AND row_number() OVER (PARTITION BY x, x1, x2 ORDER BY doc_id, p) > 1 THEN 1 ELSE 0 END AS d3
  FROM win),
gone AS (
  SELECT doc_id, i, greatest(d1, max(d2) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 1 PRECEDING AND CURRENT ROW),
         max(d3) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS g FROM dup)
SELECT r.doc_id, count(g.i) AS n_lines, coalesce(sum(g.g), 0)::BIGINT AS n_removed,
       md5(coalesce(string_agg(r.line, chr(10) ORDER BY r.i) FILTER (WHERE coalesce(g.g, 0) = 0), '')) AS kept_md5
FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.i = g.i
GROUP BY r.doc_id
"""


def stage_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: later repeated runs of lines and long passages go, and documents of which nothing but blanks is left by that.

    Null and empty texts stay; rows that repeat a document stay as it does; an empty table gives an empty one; columns of
    any other name pass through.
    """
    plain, restore = shielded(docs, "doc_id", "text", "n_chars")
    out = dedup_lines(plain)
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return restore(out)
