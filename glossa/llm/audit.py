"""Filter interaction audit: what each filter removes, alone and in every order, by a packed bitmap index.

Each task holds a bit a row for every filter, label and part (``Bitmaps``): what passes a set of filters is the part's
bits AND NOT the filters' bits, counted by popcount. The counts of the 2 ** n sets, summed over the tasks, give every
order of the filters: what a filter removes depends only on which filters ran before it.

Filter E (a text that a smaller doc_id has) needs the whole table: rows are a digest, the doc_id and bits, the least
doc_id of a digest is an aggregate with map-side combine. Digests with a thousandth of all rows or more (a thousand of them at
most) are broadcast, the others are joined, so that no task gets more than a thousandth of the rows by one digest.

Edge cases: null texts are empty ones, null parts are the part ''; a row without doc_id has no smaller one, never fails E
and has no labels; rows of one doc_id and text don't fail E for each other; of repeated labels, any that says 1 counts;
an empty table has no parts and gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialize, tidy

CHUNK = 1 << 16
HOT_SHARE = 1000
LETTERS = "ABCDE"


class Bitmaps:
    """Bit planes of rows: one of the parts (each part's rows begin at a 64-bit word, with a bit a row), one a filter and one a label."""

    def __init__(self, codes: np.ndarray, filters: np.ndarray, labels: np.ndarray):
        """codes: the part of each row, from 0 without gaps; filters, labels: booleans, one line each."""
        order = np.argsort(codes, kind="stable")
        sizes = np.bincount(codes)
        words = -(-sizes // 64)
        self.first = np.cumsum(words) - words
        place = np.arange(len(codes)) + np.repeat(64 * self.first - (np.cumsum(sizes) - sizes), sizes)
        bits = np.zeros((1 + len(filters) + len(labels), 64 * int(words.sum())), bool)
        bits[0, place] = True
        bits[1:, place] = np.concatenate([filters, labels])[:, order]
        planes = np.packbits(bits, axis=1).view(np.uint64)
        self.parts, self.filters, self.labels = planes[0], planes[1 : 1 + len(filters)], planes[1 + len(filters) :]

    def count(self, plane: np.ndarray) -> np.ndarray:
        """Bits of the plane in each part."""
        return np.add.reduceat(np.bitwise_count(plane).astype(np.int64), self.first)

    def passing(self):
        """(set of filters as a bit mask, counts a part of the rows that pass all of it: all of them, then those with each label)."""
        failing = [np.zeros_like(self.parts)]
        for mask in range(1 << len(self.filters)):
            if mask:
                low = (mask & -mask).bit_length() - 1
                failing.append(failing[mask & (mask - 1)] | self.filters[low])
            left = self.parts & ~failing[mask]
            yield mask, [self.count(left), *[self.count(left & label) for label in self.labels]]


def passing_counts(rows: DataFrame, filters: list[str], labels: list[str], part: str = "part") -> DataFrame:
    """(part, mask, n, and a count a label): rows that pass every filter of the mask. rows: booleans, true where a filter fails."""
    names = ["n", *[f"n_{label}" for label in labels]]
    schema = f"part string, mask int, {', '.join(f'{c} long' for c in names)}"

    def run(batches):
        for batch in chunks(batches):
            part_column = batch.column(0).combine_chunks().dictionary_encode()
            truth = lambda a, b: np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(a, b)], bool).reshape(b - a, len(batch))
            index = Bitmaps(part_column.indices.to_numpy(), truth(1, 1 + len(filters)), truth(1 + len(filters), batch.num_columns))
            for mask, counts in index.passing():
                yield pa.RecordBatch.from_arrays([part_column.dictionary.cast(pa.string()), pa.array(np.full(len(counts[0]), mask, np.int32)), *map(pa.array, counts)], names=["part", "mask", *names])

    bound_batches(rows.sparkSession)
    counted = rows.select(F.coalesce(part, F.lit("")), *[F.coalesce(c, F.lit(False)) for c in (*filters, *labels)]).mapInArrow(tidy(run), schema)
    return counted.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in names])


def chunks(batches):
    """Tables of CHUNK rows or a little more."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def every_order(counts: DataFrame, filters: str, labels: list[str]) -> DataFrame:
    """A row a part, order of the filters and step, from passing_counts of the filters (one letter each)."""
    names = ["n", *[f"n_{label}" for label in labels]]
    n, lost = len(filters), [f"{label}_lost" for label in labels]
    schema = f"part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, {', '.join(f'{c} long' for c in lost)}, shapley long"
    out_names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    orders = list(permutations(range(n)))
    before = np.array([[sum(1 << f for f in order[:i]) for i in range(n)] for order in orders]).ravel()
    this = np.array(orders).ravel()
    after = before | (1 << this)
    whole = (1 << n) - 1
    words = pa.array(["".join(filters[f] for f in order) for order in orders for _ in range(n)])
    steps = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)))

    def run(batches):
        for batch in batches:
            parts, lists = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                entry = lists[i].as_py()
                left = {c: np.array([e[c] for e in entry], np.int64) for c in names}  # by mask
                total = left["n"]
                removed = total[before] - total[after]
                alone = total[0] - total[1 << np.arange(n)]  # of each filter, whatever ran before
                unique = np.array([total[whole & ~(1 << f)] - total[whole] for f in range(n)])
                sets = np.arange(1 << n)
                weight = np.array([factorial(int(s).bit_count()) * factorial(n - 1 - int(s).bit_count()) if s != whole else 0 for s in sets], np.int64)
                share = np.array([sum(weight[s] * (total[s] - total[s | 1 << f]) for s in sets if not s & 1 << f) for f in range(n)], np.int64)
                columns = [total[after], removed, alone[this] - removed, unique[this], *[left[c][before] - left[c][after] for c in names[1:]], share[this]]
                yield pa.RecordBatch.from_arrays([pa.array([parts[i].as_py()] * len(this)), words, steps, *map(pa.array, columns)], names=out_names)

    grouped = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", *names))).alias("counts"))
    return grouped.select("part", "counts").mapInArrow(run, schema)


def text_filters(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, digest): which filters on a single text fail, in built-in expressions."""
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    texts = texts.withColumn("words", F.filter(F.split("t", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    texts = texts.withColumns({"n_words": F.size("words"), "n_kinds": F.size(F.array_distinct("words"))})
    return texts.select(
        "doc_id",
        "part",
        (F.col("n_words") < 100).alias("A"),
        (100 * F.col("n_kinds") < 80 * F.col("n_words")).alias("B"),
        (100 * F.regexp_count("t", F.lit("[A-Z]")) > 10 * F.length("t")).alias("C"),
        F.col("t").rlike(r"[#$%&*|]").alias("D"),
        F.unhex(F.sha2("t", 256)).alias("digest"),
    )


def with_copies(rows: DataFrame, *, share: int = HOT_SHARE) -> tuple[DataFrame, DataFrame]:
    """rows (written: doc_id, digest, ...) with E: whether a smaller doc_id has the digest; and the table that this is read from."""
    total = rows.count()
    least = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "least", light=True)
    hot = F.broadcast(least.where(F.col("n") * share >= total).select("digest", "least"))
    cold = least.where(F.col("n") * share < total).select("digest", "least")
    met = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(cold, "digest", "left"))
    out = met.withColumn("E", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("least")
    return out, least


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over docs (doc_id, text, lang) with labels (doc_id, quality, toxic): a row a part, order and step."""
    rows = materialize(text_filters(docs), "filters")
    marked, least = with_copies(rows)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    counts = materialize(passing_counts(marked.drop("digest").join(known, "doc_id", "left"), list(LETTERS), ["good", "toxic"]), "counts", light=True)
    discard(rows, least)
    return every_order(counts, LETTERS, ["good", "toxic"])


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic"))


OP11_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS failed
  FROM words LEFT JOIN known ON words.doc_id = known.doc_id
),
combos AS (SELECT part, failed, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM fails GROUP BY part, failed),
letters AS (SELECT chr(65 + i::INT) AS letter, (1 << i)::INT AS bit FROM range(5) r(i)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps AS (
  SELECT filter_order, s::INT AS step, l.bit, (SELECT sum(p.bit) FROM letters p WHERE position(p.letter IN substr(filter_order, 1, s::INT - 1)) > 0) AS earlier
  FROM orders, range(1, 6) r(s) JOIN letters l ON true WHERE substr(filter_order, s::INT, 1) = l.letter
),
found AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN failed & (coalesce(earlier, 0)::INT | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & coalesce(earlier, 0)::INT = 0 AND failed & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & coalesce(earlier, 0)::INT <> 0 AND failed & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & coalesce(earlier, 0)::INT = 0 AND failed & bit <> 0 THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & coalesce(earlier, 0)::INT = 0 AND failed & bit <> 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM combos, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found
"""
