"""The filter audit against a loop over every order, and its bitmaps."""

import hashlib
import re
from itertools import permutations
from math import factorial

import duckdb
import numpy as np
import pytest

from glossa.llm import audit
from glossa.llm.queries import ORACLES, QUERIES


def failed(rows):
    """(part, failing letters) of (doc_id, text, lang), by plain loops."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, lang in rows:
        text = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
        out = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        yield lang or "", out + "E" * (d is not None and d > least[text])


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out, share = {}, {}
    found = list(zip(rows, failed(rows), strict=True))
    for part in {p for _, (p, _) in found}:
        own = [(d[0], f) for d, (p, f) in found if p == part]
        for order in permutations("ABCDE"):
            left = own
            for i, c in enumerate(order):
                gone, stay = [x for x in left if c in x[1]], [x for x in left if c not in x[1]]
                alone = sum(f == c for _, f in own)
                out[part, "".join(order), i + 1] = [len(stay), len(gone), sum(c in f for _, f in own) - len(gone), alone, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                share[part, c] = share.get((part, c), 0) + len(gone)
                left = stay
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["Alpha", "BETA", "gamma", "naïve", "日本", "x#", "#", "Q"], n)) for n in rng.integers(0, 160, 60)]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (99, 100, 101, 140)] + ["A" * 10 + "b" * 90, "A" * 11 + "b" * 89, " one two", "", None, "   ", "\x1fq"]
    rows = [(i, t, [None, "en", "", "fr", "|"][i % 5]) for i, t in enumerate(texts)]
    rows += [(i + 500, texts[i], "en") for i in range(0, 60, 3)] + [rows[2], rows[2], (2, "other", "fr"), (None, texts[0], "en"), (None, None, None), (-5, texts[6], None)] + [(900 + i, "same", "en") for i in range(40)]
    labels = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(0, 950, 2)] + [(4, 1, None), (None, 1, 1), (6, None, None)]
    return rows, labels


def result(spark, tmp_path, rows, labels):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, E string, n int").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return QUERIES["op11_filter_audit"](spark, str(tmp_path))


def test_every_order_equals_brute_force_and_sql(spark, tables, tmp_path):
    rows, labels = tables
    df = result(spark, tmp_path, rows, labels)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}
    want = brute(rows, labels)
    assert got == want and len(got) == 600 * 4  # null and '' are one part
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['op11_filter_audit']})").fetchall()} == want


def test_empty_tables(spark, tmp_path):
    df = result(spark, tmp_path, [], [])
    assert df.collect() == [] and df.columns[:3] == ["part", "filter_order", "step"]


def test_hot_and_cold_digests_give_the_same(spark, tables):
    rows = spark.createDataFrame([(d, hashlib.sha256((t or "").encode()).digest()) for d, t, _ in tables[0]], "doc_id long, digest binary")
    out = []
    for share in (1, 10, 10**9):  # all joined, mixed, all broadcast
        marked, _ = audit.with_copies(rows, share=share)
        out.append(sorted((str(r["doc_id"]), bytes(r["digest"]), r["E"]) for r in marked.collect()))
    assert out[0] == out[1] == out[2] and sum(x[2] for x in out[0]) > 40


@pytest.mark.parametrize("n", [1, 7, 63, 64, 65, 1000])
def test_bitmaps_count_like_booleans(n):
    rng = np.random.default_rng(n)
    codes = np.concatenate([np.arange(min(n, 5)), rng.integers(0, min(n, 5), n - min(n, 5))])
    filters, labels = rng.random((3, n)) < 0.4, rng.random((2, n)) < 0.5
    seen = 0
    for mask, counts in audit.Bitmaps(codes, filters, labels).passing():
        left = ~np.any([filters[f] for f in range(3) if mask >> f & 1] or [np.zeros(n, bool)], axis=0)
        want = [np.bincount(codes[left & m], minlength=codes.max() + 1) for m in (np.ones(n, bool), *labels)]
        assert all((a == b).all() for a, b in zip(counts, want, strict=True))
        seen += 1
    assert seen == 8


def test_shares_are_shapley_values():
    """Every order counts once: a filter's removals over all orders are the weighted marginal ones of the sets before it."""
    assert sum(factorial(s) * factorial(4 - s) * len([c for c in permutations(range(4), s)]) // factorial(s) for s in range(5)) == 120
