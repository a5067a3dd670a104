"""The manifest against a tree built by loops, and its ranks against a sort."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from glossa.llm import merkle
from glossa.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """The root of nodes, and each one's (before, after) by level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            a = i - i % 8
            steps[k].append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 8])))
        nodes, at = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0] if nodes else None, steps


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = climb([trees[g][0] for g in names])
    out = []
    for g, upper in zip(names, above, strict=True):
        for (_, _, own, r), steps in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            path = steps + upper
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                node = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for before, after in path:
                node = h(before, node, after)
            out.append((r[0], own, trees[g][0], root, h(*[x for s in path for x in s]), node, node == root))
    return sorted(out, key=str)


def check(spark, rows, tmp_path, sql=True):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", rank string, leaf int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == brute(rows)
    if sql:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['op13_merkle_manifest']})").fetchall(), key=str) == got
    return got


EDGES = [
    (None, None, None, None, None), (None, "s", "en", 3, "ABC"), (5, None, "en", None, ""), (-7, "s", "en", 1, "Äb C"), (2**62, "s", "en", 1, "x"), (-(2**62), "s", "en", 1, "X" * 5000),
    (9, "s", "", 1, "Y"), (9, "s", "é", 1, None), (3, "s", "zz", 1, "A"), (3, "s", "zz", 1, "A"), (3, "t", "zz", 1, "B"),
]


def test_edges_equal_loops_and_sql(spark, tmp_path):
    got = check(spark, EDGES + [(i, f"src{i % 4}", "en", i, f"Text {i} É") for i in range(70)], tmp_path)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_sizes_of_one_group(spark, tmp_path, n):
    check(spark, [(3 * i, "s", "en", 1, f"T{i}") for i in range(n)], tmp_path)


def test_several_rounds_and_many_groups(spark, tmp_path):
    """More leaves than a block of the trie holds in one group, and more groups than a run of the upper tree."""
    rows = [(i * 7919 % 100_003 - 40_000, "s", "en", i, f"Q{i}") for i in range(4200)] + [(i, "s", f"l{i % 23:02d}", i, "Q") for i in range(200)]
    check(spark, rows, tmp_path, sql=False)


def test_ranks_equal_a_sort(spark):
    """With buckets of four rows, so that repeated ids and equal rows go through every round of digits."""
    ids = [None] * 9 + [5] * 30 + list(range(0, 90_000, 1000)) + [-(2**62), 2**62, 4095, 4096, -1]
    rows = [(i, d, "=a" if i % 3 else "", h(str(i % 11)) if d != 5 else h("same"), None) for i, d in enumerate(ids)]
    frame = spark.createDataFrame(rows, "place long, doc_id long, group string, leaf string, tampered string")
    out, _ = merkle.ranked(frame, merkle.id_digits, [F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("place")], bucket=4)
    got = {r["place"]: (r["rank"], r["total"]) for r in out.collect()}
    for g in ("", "=a"):
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[3], r[0]))
        assert [got[r[0]] for r in own] == [(i, len(own)) for i in range(len(own))]


def test_starts_over_several_digits(spark):
    values = [0, 1, 4095, 4096, 5000, 1 << 25, (1 << 25) + 3, 1 << 40]
    counts = spark.createDataFrame([("g", 7, v, i + 1) for i, v in enumerate(values)], "group string, at long, value long, n long")
    got = {r["value"]: r["start"] for r in merkle.starts(counts).collect()}
    assert got == {v: sum(range(i + 1)) for i, v in enumerate(values)}


def test_names_beyond_one_digit(spark):
    names = ["", "=", "=a", "=a\0", "=abcdefgh", "=abcdefghij", "=abcdefghijklmnop", "=é", "=日本"]
    frame = spark.createDataFrame([("", n) for n in names], "group string, name string")
    out, _ = merkle.ranked(frame, merkle.name_digits(max(len(n.encode()) for n in names)), [F.asc("name")], bucket=1)
    assert [r["name"] for r in sorted(out.collect(), key=lambda r: r["rank"])] == sorted(names, key=str.encode)
