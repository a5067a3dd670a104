"""What operators leave in the work folder, and identities that rest on more than one hash."""

import os

import numpy as np

from glossa.llm import common, langid, linededup, neardup
from glossa.llm.components import components


def left(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    return {f"{d}/{n}" for d in os.listdir(root) if d.startswith("glossa-") for n in os.listdir(f"{root}/{d}")} if os.path.isdir(root) else set()


def test_near_duplicates_leave_what_the_result_is_read_from(spark, folder):
    before = left(spark)
    out = neardup.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    assert sorted(x.split("/")[1] for x in left(spark) - before) == ["named", "signatures"]
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_components_leave_one_table(spark):
    before = left(spark)
    out = components(spark.range(50).selectExpr("id AS u", "id + 1 AS v"))
    assert out.count() == 50 and len(left(spark) - before) == 1
    common.discard(out)
    assert left(spark) == before


def test_lines_of_one_selecting_hash_are_told_apart(spark, monkeypatch):
    """Where the first 64 bits of all lines are alike, the other 64 still decide what is deleted."""
    import xxhash

    whole = xxhash.xxh3_128_digest
    monkeypatch.setattr(linededup.xxhash, "xxh3_128_digest", lambda raw: b"\0" * 8 + whole(raw)[8:])
    texts = ["\n".join(f"{k} line {i}" for i in range(6)) for k in "ab"] + ["\n".join(f"a line {i}" for i in range(6))]
    found = linededup.fingerprints(texts, 3, 50)
    lines, others = found[-2], found[-1]
    assert not lines.any() and len(np.unique(others)) == 12


def test_languages_learned_are_bounded(spark):
    rows = [(i, f"word{i % 7} and some more text", f"l{i % 7}" if i % 3 else "most") for i in range(300)]
    model = langid.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langs=3)
    assert len(model.langs) == 3 and "most" in model.langs
