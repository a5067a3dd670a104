"""Small tables with everything that can go wrong: nulls, empty and very long texts, ties, repeated rows, extra columns."""

import random

import pytest

CLASHES = ["score", "key", "n", "gone", "component", "starts", "tasks", "runs", "rank", "rejected", "lang_pred", "n_lines", "__key", "part", "bucket", "hot"]


def make_texts(seed=1):
    """(doc_id, text) with exact and near copies, shared passages, repeats, other scripts, blanks, a long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ra", "sé", "to"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    lines = lambda n: "\n".join(" ".join(words(rng.randint(4, 14))) for _ in range(n))
    passage = lines(5)
    texts = [lines(rng.randint(1, 12)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[7]]
    for k in (5, 8, 11):
        for _ in range(4):
            w = texts[k].split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [lines(2) + "\n" + passage + "\n" + lines(3) for _ in range(6)]
    texts += [passage + "\n" + passage, "ab" * 3000, "same words " * 300, "", "   \n\t ", "one two", "one two", "one", "ÀÉ ß 日本語 text – “q” <|endoftext|>", "a\r\n\r\nb\n" * 40, "12 34 -- !!", lines(900)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows.append((1000, None))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_texts()


@pytest.fixture(scope="session")
def folder(spark, rows, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    long = max((t or "" for _, t in rows), key=len)
    again = [rows[0], rows[1]]  # repeated rows
    full = [(d, t, ["en", "fr", None][d % 3], f"src{d % 4}", len(t or "")) + tuple(f"{c}{d}" for c in CLASHES) for d, t in rows + again]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    spark.createDataFrame(full, schema).repartition(5).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(d, int(len(t or "") > 200), 0) for d, t in rows if d % 2], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, long[200:420]), (2, None), (3, ""), (4, "one two"), (5, "nothing like this is anywhere in these documents at all")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    urls = ["http://A.Example.COM/en/x?y", "https://www.example.com/en/", "http://example.com", None, "no scheme/en/", "ftp://b.net/es/q#f", "x://net/fr/", "http://notexample.com/en/", "http://c.net", "http://example.com:80/en/"]
    spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([(5 * i, [float(i % 7), 1.0, float(i)], i % 2) for i in range(30)] + [(7, None, 0), (None, [1.0, 1.0, 1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty(spark, folder, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return str(root)
