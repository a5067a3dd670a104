"""Nearest neighbours against brute force: recall, exact scores, order, and rows that take no part."""

import numpy as np
import pytest

from glossa.llm import neighbours
from glossa.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string"


def brute(ids, x, k):
    """{query: [(score, id)]} of the k nearest other rows."""
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        out[int(ids[i])] = [(float(s[j]), int(ids[j])) for j in np.lexsort((ids, -s))[:k] if s[j] > -np.inf]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def recall(got, want):
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    for q in got:
        assert got[q] == sorted(got[q], key=lambda x: (-x[0], x[1]))
    return sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want) / sum(map(len, want.values()))


def write(spark, path, rows):
    spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")


def test_recall_over_the_given_table(spark):
    """2,000 vectors without structure, in several cells."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    want = brute(rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64), 20)
    got = answers(QUERIES["op12_nearest_neighbours"](spark, "/root/testdata/sf0.1"))
    assert recall(got, want) >= 0.98
    exact = {q: dict((v, s) for s, v in want[q]) for q in want}
    assert all(abs(s - exact[q].get(v, s)) < 1e-12 for q in got for s, v in got[q])


def test_norms_that_differ_and_a_large_group_of_near_copies(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16)) * rng.lognormal(0, 0.7, 1500)[:, None]
    x[500:1000] = x[500] + 0.01 * rng.standard_normal((500, 16))
    x = x.astype(np.float32)
    write(spark, tmp_path, [(i, v.tolist()) for i, v in enumerate(x)])
    rows = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    df = neighbours.nearest(rows, rows.where("vec_id % 20 = 0"), key="vec_id", vector="embedding", k=20, cell=64)
    assert recall(answers(df), brute(np.arange(1500), x.astype(np.float64), 20)) >= 0.95


def test_equal_vectors_are_one_node(spark, tmp_path):
    """A third of the rows share a vector: ties go by id, and each of them finds the others."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[100:200] = x[100]
    write(spark, tmp_path, [(i, v.tolist()) for i, v in enumerate(x)])
    got, want = answers(QUERIES["op12_nearest_neighbours"](spark, str(tmp_path))), brute(np.arange(300), x.astype(np.float64), 20)
    assert {q: [v for _, v in a] for q, a in got.items()} == {q: [v for _, v in a] for q, a in want.items()}
    assert [v for _, v in got[120]] == [100, *range(101, 120)]


def test_rows_that_take_no_part(spark, tmp_path):
    bad = [(20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [1.0, float("nan")]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0]), (140, [])]
    write(spark, tmp_path, bad + [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [-1.0, 5.0]), (160, [0.5, 0.5]), (160, [0.5, 0.5])])
    assert answers(QUERIES["op12_nearest_neighbours"](spark, str(tmp_path))) == {0: [(2.0, 1), (0.5, 160), (-1.0, 2)], 160: [(2.0, 2), (1.0, 1), (0.5, 0)]}


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path, [])
    assert QUERIES["op12_nearest_neighbours"](spark, str(tmp_path)).collect() == []


def test_doubles_and_queries_that_are_no_rows(spark):
    rng = np.random.default_rng(8)
    x, q = rng.standard_normal((900, 12)), rng.standard_normal((30, 12))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    asked = spark.createDataFrame([(10_000 + i, v.tolist()) for i, v in enumerate(q)], "k long, v array<double>")
    got = answers(neighbours.nearest(rows, asked, key="k", vector="v", k=5, cell=64))
    want = {10_000 + i: {int(j) for j in np.argsort(-(x @ v))[:5]} for i, v in enumerate(q)}
    assert sum(len({j for _, j in got[i]} & want[i]) for i in want) / 150 >= 0.95


@pytest.mark.parametrize("k", [3, 40])
def test_best_of_rows(k):
    s = np.random.default_rng(k).random((9, 20))
    s[2] = -np.inf
    i, j, v = neighbours.best_of_rows(s, k)
    assert len(i) == 8 * min(k, 20) and (s[i, j] == v).all() and 2 not in i
    assert all(set(j[i == r]) == set(np.argsort(-s[r])[:k]) for r in range(9) if r != 2)
