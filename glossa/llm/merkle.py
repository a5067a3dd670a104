"""Merkle manifest of a dataset: a leaf a row, a hash tree a group, a proof a row, all by a radix-ranked trie.

* **Ranks without a global sort** (``ranked``): a row's place in its group is the start of its bucket plus its place in the
  bucket. Buckets are ranges of doc_id; their starts are prefix sums over hierarchical histograms of the bucket numbers'
  digits, a digit at a time, so that no window holds more than ``RADIX`` rows. Buckets of more than ``BUCKET`` rows (rows
  of one doc_id) are cut further by digits of the leaf, then of the row's place in the written table.
* **The trie**: the rank's digits in base ``FANOUT`` are a leaf's path. Nodes that share all but the last ``LEVELS`` digits are
  reduced by one task into their common ancestor; the ancestors are the next round's nodes, until a group has one.
* **Proofs** go down the same blocks: a block gets its ancestor's path (siblings left and right of each level) and gives
  each child its own.

The trees of the groups are the leaves of one more tree, built the same way, over the groups in order of their names.

Edge cases: null values are ``-`` in a leaf; a null group comes first; rows without doc_id come first in their group and
are not tampered with; rows of one doc_id are ordered by leaf, equal rows have equal leaves and any order; a group of one row is its
own root; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

FANOUT, LEVELS = 8, 4
DIGIT = 12
RADIX, BUCKET = 1 << DIGIT, 1 << 15
BLOCK_BITS = 3 * LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as a leaf holds it: its length in bytes, a colon, and itself; null is a hyphen."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


# ---- ranks


def starts(counts: DataFrame) -> DataFrame:
    """counts (group, at, value, n) with start: how many rows of (group, at) have a smaller value, by digits of the value."""
    least, most = counts.agg(F.min("value"), F.max("value")).first()
    levels = 1 if least is None else max(1, -(-(most - least).bit_length() // DIGIT))
    first = counts.withColumn("v", F.col("value") - F.lit(least or 0))
    above = [first.groupBy("group", "at", F.shiftright("v", DIGIT * level).alias("v")).agg(F.sum("n").alias("n")) for level in range(1, levels)]
    out = None
    for table in [*above[::-1], first]:  # from the coarsest digits to the values themselves
        before = W.partitionBy("group", "at", F.shiftright("v", DIGIT)).orderBy("v").rowsBetween(W.unboundedPreceding, -1)
        here = table.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        if out is not None:
            up = out.select(F.col("group").alias("g"), F.col("at").alias("a"), F.col("v").alias("parent"), F.col("start").alias("base"))
            met = (F.col("group") == F.col("g")) & (F.col("at") == F.col("a")) & (F.shiftright("v", DIGIT) == F.col("parent"))
            here = here.join(up, met).withColumn("start", F.col("start") + F.col("base")).drop("g", "a", "parent", "base")
        out = here
    return out.select("group", "at", "value", "n", "start")


def ranked(rows: DataFrame, digits: Callable[[int], Column | None], order: list[Column], *, bucket: int = BUCKET) -> tuple[DataFrame, list[DataFrame]]:
    """rows (group: string without nulls, ...) with rank (from 0, in its group) and total (rows of the group).

    digits(i): a long without nulls by which buckets are cut in round i, null if no more digits are there; the order must go
    by digits(0), digits(1) and so on. Also gives the written tables that the result is read from.
    """
    columns, done, used = rows.columns, [], []
    left, i = rows.withColumns({"at": F.lit(0).cast("long"), "total": F.lit(0).cast("long")}), 0
    while True:
        by = digits(i)
        last = by is None
        here = left.withColumn("value", F.lit(0).cast("long") if last else by)
        counts = materialize(here.groupBy("group", "at", "value").agg(F.count("*").alias("n")), "counts", light=True)
        begun = starts(counts)
        if i == 0:
            begun = begun.join(begun.groupBy("group").agg(F.sum("n").alias("all")), "group")
        cut = materialize(begun, "starts", light=True)
        used += [counts, cut]
        met = here.join(cut.withColumnsRenamed({"n": "size"}), ["group", "at", "value"])
        if i == 0:
            met = met.withColumn("total", F.col("all"))
        small = met if last else met.where(F.col("size") <= bucket)
        place = F.row_number().over(W.partitionBy("group", "at", "value").orderBy(*order))
        done.append(small.select(*columns, "total", (F.col("at") + F.col("start") + place - 1).alias("rank")))
        if last or cut.where(F.col("n") > bucket).isEmpty():
            break
        left = materialize(met.where(F.col("size") > bucket).select(*columns, (F.col("at") + F.col("start")).alias("at"), "total"), "large")
        used.append(left)
        i += 1
    return reduce_union(done), used


def id_digits(i: int) -> Column | None:
    """Ranges of ids (rows without one before all), the ids in a range, 120 bits of the leaf, and the row's place."""
    return [
        F.coalesce(F.shiftright("doc_id", DIGIT), F.lit(-(1 << 52))),
        F.coalesce(F.col("doc_id").bitwiseAND(F.lit(RADIX - 1)), F.lit(0)).cast("long"),
        F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long"),
        F.conv(F.substring("leaf", 16, 15), 16, 10).cast("long"),
        F.shiftright("place", DIGIT),
        None,
    ][i]


def name_digits(longest: int) -> Callable[[int], Column | None]:
    """Seven bytes of a name at a time, until the longest name is at its end."""

    def digits(i: int) -> Column | None:
        if 7 * i >= longest:
            return None
        return F.conv(F.rpad(F.hex(F.substring(F.encode("name", "UTF-8"), 7 * i + 1, 7)), 14, "0"), 16, 10).cast("long")

    return digits


# ---- the trie


def depth(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def layers(hashes: list[str], levels: int) -> list[list[str]]:
    """The nodes' hashes of each level, the given ones first, the last one's run included."""
    out = [hashes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def levels_here(total: int, block: int) -> int:
    """Levels that a block of the given round (from 0) reduces."""
    return min(LEVELS, max(0, depth(total) - LEVELS * block))


def steps_of(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Siblings of node i left and right of it, level by level."""
    out = []
    for level in tree[:-1]:
        a = i - i % FANOUT
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + FANOUT])))
        i //= FANOUT
    return out


STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
PATHS = pa.schema([("group", pa.string()), ("rank", pa.int64()), ("path", STEPS), ("subroot", pa.string()), ("root", pa.string())])
PATH_TYPE = "array<struct<before:string,after:string>>"
PATHS_TYPE = f"group string, rank long, path {PATH_TYPE}, subroot string, root string"


def paths_table(names: list, ranks: list, paths: list, subroots: list, root: str) -> pa.Table:
    steps = [[{"before": a, "after": b} for a, b in path] for path in paths]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip([names, ranks, steps, subroots, [root] * len(names)], PATHS.types, strict=True)], schema=PATHS)


def reducer(block: int):
    """The common ancestor of a block's nodes."""

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        hashes, total = table.sort_by("rank").column("hash").to_pylist(), table.column("total")[0].as_py()
        top = layers(hashes, levels_here(total, block))[-1][0]
        return pa.table({"group": [key[0].as_py()], "rank": [key[1].as_py()], "total": [total], "hash": [top]})

    return reduce


def going_on(nodes: DataFrame, block: int) -> DataFrame:
    """Nodes of the groups that have a round of this number."""
    return nodes.where(F.col("total") > FANOUT ** (LEVELS * block)) if block else nodes


def block_of(rank: str = "rank") -> Column:
    return F.shiftright(rank, BLOCK_BITS).alias("block")


def raised(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (group, rank, total, hash) of each round, the given (written) ones first, and (group, hash) of the groups' roots."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    rounds = max(1, -(-depth(most) // LEVELS))
    out, tops = [nodes], []
    for block in range(rounds):
        below = going_on(out[-1], block).select("group", "rank", "total", "hash")
        reduced = below.groupBy("group", block_of()).applyInArrow(reducer(block), "group string, rank long, total long, hash string")
        out.append(materialize(reduced, "nodes", light=True))
        ended = out[-1] if block + 1 == rounds else out[-1].where(F.col("total") <= FANOUT ** (LEVELS * (block + 1)))
        tops.append(ended.select("group", "hash"))
    return out, reduce_union(tops)


def reduce_union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def descender(block: int, finish: Callable):
    """finish(table, paths, subroot, root) of a block's nodes, whose ancestor's path is above."""

    def descend(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        if not len(table):  # a group that begins further down
            return paths_table([], [], [], [], "")
        table = table.sort_by("rank")
        tree = layers(table.column("hash").to_pylist(), levels_here(table.column("total")[0].as_py(), block))
        upper = [(s["before"], s["after"]) for s in above.column("path")[0].as_py()]
        own = [steps_of(tree, i) + upper for i in range(len(table))]
        return finish(table, own, above.column("subroot")[0].as_py(), above.column("root")[0].as_py())

    return descend


def inner_paths(table: pa.Table, own: list, subroot: str, root: str) -> pa.Table:
    return paths_table(table.column("group").to_pylist(), table.column("rank").to_pylist(), own, [subroot] * len(table), root)


def lowered(rounds: list[DataFrame], top: DataFrame, finish: Callable, schema: str) -> tuple[DataFrame, list[DataFrame]]:
    """finish(table of a block of leaves, path of each, subroot, root), a row a leaf of the given schema.

    rounds: of raised; top: (group, path from the group's root on, subroot, root). Also gives the written tables that the
    result is read from, beside the leaves and top. The other rounds' nodes are deleted.
    """
    top = top.select("group", F.lit(0).cast("long").alias("rank"), "path", "subroot", "root")
    paths, used = top, []
    for block in range(len(rounds) - 2, -1, -1):
        nodes = going_on(rounds[block], block)
        grouped = nodes.groupBy("group", block_of()).cogroup(paths.groupBy("group", F.col("rank").alias("block")))
        if block == 0:
            discard(*rounds[1:])
            return grouped.applyInArrow(descender(0, finish), schema), used
        down = grouped.applyInArrow(descender(block, inner_paths), PATHS_TYPE)
        late = top.join(nodes.select("group").distinct(), "group", "left_anti")  # groups that begin further down
        paths = materialize(down.unionByName(late), "paths", light=True)
        discard(*used)
        used = [paths]
    raise AssertionError("there is always a first round")


# ---- leaves, roots, proofs


def leaves_of(docs: DataFrame) -> DataFrame:
    """(place, doc_id, group, leaf, tampered): group is '' for a null lang, else '=' and the lang; tampered is null where nothing is changed."""
    values = [F.col(c) for c in FIELDS]
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    changed = leaf_hash([*values[:-1], F.translate("text", UPPER, LOWER)])
    return docs.select(*FIELDS).select(
        F.monotonically_increasing_id().alias("place"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("group"),
        leaf_hash(values).alias("leaf"),
        F.when(struck, changed).alias("tampered"),
    )


def folded(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in steps:
        leaf = digest(before + leaf + after)
    return leaf


def forest(tops: DataFrame) -> DataFrame:
    """(group, path, subroot, root), written, of the groups' roots (group, hash): the same trie over the groups in order of their names."""
    tops = materialize(tops.select(F.lit("").alias("group"), F.col("group").alias("name"), "hash"), "tops", light=True)
    longest = tops.agg(F.max(F.octet_length("name"))).first()[0] or 0
    ranks, used = ranked(tops, name_digits(longest), [F.asc("name")])
    nodes = materialize(ranks, "forest", light=True)
    rounds, root = raised(nodes)
    top = root.select("group", F.expr("array()").cast(PATH_TYPE).alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    top = materialize(top, "root", light=True)

    def finish(table: pa.Table, own: list, subroot: str, root: str) -> pa.Table:
        return paths_table(table.column("name").to_pylist(), table.column("rank").to_pylist(), own, table.column("hash").to_pylist(), root)

    out, more = lowered(rounds, top, finish, PATHS_TYPE)
    out = materialize(out, "roots", light=True)
    discard(tops, nodes, top, *used, *more)
    return out


PROOFS = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])


def manifest(docs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The written nodes of each round, leaves (group, rank, total, hash, doc_id, tampered) first, and the groups' roots (group, path, subroot, root)."""
    leaves = materialize(leaves_of(docs), "leaves")
    ranks, used = ranked(leaves, id_digits, [F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("place")])
    nodes = materialize(ranks.select("group", "rank", "total", F.col("leaf").alias("hash"), "doc_id", "tampered"), "ranked")
    discard(leaves, *used)
    rounds, tops = raised(nodes)
    return rounds, forest(tops)


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    rounds, top = manifest(docs)

    def finish(table: pa.Table, own: list, subroot: str, root: str) -> pa.Table:
        hashes, tampered, n = table.column("hash").to_pylist(), table.column("tampered").to_pylist(), len(table)
        found = [folded(t or h, steps) for h, t, steps in zip(hashes, tampered, own, strict=True)]
        proof = [digest("".join(a + b for a, b in steps)) for steps in own]
        columns = [table.column("doc_id").to_pylist(), hashes, [subroot] * n, [root] * n, proof, found, [f == root for f in found]]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, PROOFS.types, strict=True)], schema=PROOFS)

    out, _ = lowered(rounds, top, finish, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return proofs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS total, leaf, tampered
  FROM (
    SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
      CASE WHEN doc_id IS NOT NULL AND crc % 3 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS tampered
    FROM (
      SELECT doc_id, lang, text,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
          lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) AS crc
      FROM documents
    )
  )
),
nodes AS (
  SELECT lang, 0 AS level, idx, total, leaf AS hash FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 8, (total + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx)) FROM nodes WHERE total > 1 GROUP BY lang, level, total, idx // 8
),
subroots AS (SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS total FROM nodes WHERE total = 1),
tops AS (
  SELECT 0 AS level, idx, total, subroot AS hash FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, (total + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx)) FROM tops WHERE total > 1 GROUP BY level, total, idx // 8
),
runs AS (SELECT lang, level, idx // 8 AS run, list(hash ORDER BY idx) AS hs FROM nodes WHERE total > 1 GROUP BY lang, level, idx // 8),
top_runs AS (SELECT level, idx // 8 AS run, list(hash ORDER BY idx) AS hs FROM tops WHERE total > 1 GROUP BY level, idx // 8),
top_steps AS (
  SELECT s.lang, s.subroot, coalesce(list(array_to_string(hs[1:(s.idx // pow(8, level)::BIGINT) % 8], '') || '|' || array_to_string(hs[(s.idx // pow(8, level)::BIGINT) % 8 + 2:], '') ORDER BY level) FILTER (WHERE level IS NOT NULL), []) AS steps
  FROM subroots s LEFT JOIN top_runs r ON r.run = s.idx // pow(8, r.level + 1)::BIGINT GROUP BY s.lang, s.subroot
),
steps AS (
  SELECT l.doc_id, l.lang, l.idx, l.leaf, l.tampered,
    coalesce(list(array_to_string(hs[1:(l.idx // pow(8, level)::BIGINT) % 8], '') || '|' || array_to_string(hs[(l.idx // pow(8, level)::BIGINT) % 8 + 2:], '') ORDER BY level) FILTER (WHERE level IS NOT NULL), []) AS steps
  FROM leaves l LEFT JOIN runs r ON r.lang IS NOT DISTINCT FROM l.lang AND r.run = l.idx // pow(8, r.level + 1)::BIGINT GROUP BY ALL
),
whole AS (
  SELECT doc_id, leaf, t.subroot, (SELECT hash FROM tops WHERE total = 1) AS root, sha256(replace(array_to_string(list_concat(s.steps, t.steps), ''), '|', '')) AS proof_sha256,
    list_reduce(list_concat([coalesce(tampered, leaf)], s.steps, t.steps), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
  FROM steps s JOIN top_steps t ON s.lang IS NOT DISTINCT FROM t.lang
)
SELECT *, folded_root = root AS verified FROM whole
"""
