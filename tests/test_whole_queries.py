"""Queries that read every document, against brute force and against their narrower twins."""

import re
from collections import Counter

import pytest

from glossa.functions import lexicon as L
from glossa.plans.catalog import QUERIES

SENTENCES = [
    ["The café held that prices fell.", "However, it was late – although “because” stood there."],
    ["Über alles spricht man.", "élbecause and butö are not words, unless they are."],
    ["Because the market fell, profits were low.", "The judge found that it was the naïve ruling that mattered."],
    ["Une phrase sans mots anglais, déjà."],
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("whole")
    rows = [(i, " ".join(ss), "en de en fr".split()[i], "src1", 0) for i, ss in enumerate(SENTENCES)]
    rows += [(10, None, "en", "src2", 0), (11, "", None, "src2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    return str(root)


def codes(sentence):
    return [c for c, _, _, p in L.PATTERNS if re.search(p, sentence.lower())]


def test_every_text_is_scored(spark, folder):
    got = {r["doc_id"]: r for r in QUERIES["quality_score"](spark, folder).collect()}
    assert set(got) == {0, 1, 2, 3, 10, 11} and all(r["quality_score"] is not None for r in got.values())
    for i, ss in enumerate(SENTENCES):
        hits = [c for s in ss for c in codes(s)]
        assert (got[i]["sentence_count"], got[i]["pattern_count"], got[i]["pattern_diversity"]) == (len(ss), len(hits), len(set(hits)))
    gate = QUERIES["quality_gate"](spark, folder).first()
    assert gate["n"] == sum(r["quality_score"] >= 2 for r in got.values())


def test_patterns_of_all_languages_and_characters(spark, folder):
    got = [(r["doc_id"], r["type"]) for r in QUERIES["pattern_hits"](spark, folder).collect()]
    want = Counter((i, c) for i, ss in enumerate(SENTENCES) for s in ss for c in codes(s))
    assert Counter(x for x in got if x[0] >= 0) == want
    by_type = {r["type"]: (r["n"], r["n_docs"]) for r in QUERIES["pattern_hits_by_type"](spark, folder).collect()}
    assert by_type == {c: (n, len({i for i, k in got if k == c})) for c, n in Counter(c for _, c in got).items()}


def test_terms_that_occur_once_count(spark, folder):
    got = {r["word"]: r["frequency"] for r in QUERIES["merged_vocabulary"](spark, folder).collect()}
    assert got["market"] == 1 and got["judge"] == 1


def test_documents_are_read_beside_the_fixture(spark, folder):
    rows = QUERIES["pattern_hits"](spark, folder).collect()
    assert any(r["doc_id"] < 0 for r in rows) and any(r["doc_id"] >= 0 for r in rows)
    assert {r["doc_id"] for r in QUERIES["exam_value"](spark, folder).collect()} >= {0, 1, 2, 3, 10, 11, -1}
