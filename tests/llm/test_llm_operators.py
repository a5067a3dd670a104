"""Each operator against brute force, exact round trips or held-out accuracy, over small tables of edge cases."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from glossa.llm import decontam, media, neardup, packing, queries, sufdedup, tokenbin, urlfilter
from glossa.llm.common import flat, work_folder
from glossa.llm.linededup import OP2_SQL
from glossa.llm.tokens import Encoder

SF = "/root/testdata/sf0.01"
OPERATORS = list(queries.QUERIES)


def run(spark, name, folder):
    return queries.QUERIES[name](spark, folder).collect()


def tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(spark, empty, name):
    df = queries.QUERIES[name](spark, empty)
    assert df.collect() == [] and len(df.columns) >= 2


def test_work_folder_is_the_sessions(spark):
    assert work_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


# ---- 1 and 10: classifiers


def test_quality_is_learned_and_bounded(spark):
    got = spark.createDataFrame(run(spark, "op1_quality", SF)).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.9


def test_quality_of_edge_cases(spark, folder, rows):
    got = run(spark, "op1_quality", folder)
    assert len(got) == len(rows) + 2 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    by = defaultdict(set)
    texts = dict(rows)
    for r in got:
        by[texts[r["doc_id"]] or ""].add(round(r["score"], 4))
    assert all(len(s) == 1 for s in by.values())


def test_conflicting_labels_and_null_ids(spark, tmp_path):
    """Nothing is learned from a doc_id with two labels: the model is the same in any order of the rows."""
    from glossa.llm import quality

    docs = [(i, ("good words here " if i % 2 else "zz ## 11 ") * (3 + i % 5)) for i in range(1, 60)] + [(None, "good words here"), (None, None)]
    labels = [(i, i % 2) for i in range(1, 60)] + [(i, 1 - i % 2) for i in range(1, 20)] + [(None, 1), (21, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    nets = [quality.fit_quality(frame, spark.createDataFrame(x, "doc_id long, quality int").repartition(3)) for x in (labels, labels[::-1])]
    assert all((getattr(nets[0], k) == getattr(nets[1], k)).all() for k in ("emb", "conv", "out"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [r for r in run(spark, "op1_quality", str(tmp_path)) if r["doc_id"] is None]
    assert len(got) == 2 and not any(r["held_out"] for r in got)


def brute_pooled(net, text):
    """Every chunk of CHUNK bytes that starts at a multiple of STEP, one by one; the largest response of each filter."""
    from glossa.llm.quality import CHUNK, PAD, STEP

    raw = list(text.encode())
    raw += [PAD] * (-len(raw) % STEP)
    raw += [PAD] * (CHUNK - len(raw))
    best = None
    for a in range(0, len(raw) - CHUNK + 1, STEP):
        y = sum(net.emb[raw[a + p * STEP : a + (p + 1) * STEP]].reshape(-1) @ net.conv[p] for p in range(CHUNK // STEP))
        best = y if best is None else np.maximum(best, y)
    return best


def test_quality_scores_equal_brute_force(spark):
    from glossa.llm.quality import fit_quality, score_quality

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net = fit_quality(docs, labels, sample=60)
    some = docs.where("n_chars < 3000").orderBy("doc_id").limit(25).select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in some.collect()}
    for r in score_quality(some, net).collect():
        assert abs(r["score"] - float(net.head(brute_pooled(net, texts[r["doc_id"]])[None])[2][0])) < 1e-4


def test_languages_equal_brute_force(spark):
    from glossa.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_language(docs, per_lang=30)
    some = docs.where("n_chars < 2000").orderBy("doc_id").limit(40)
    texts = {r["doc_id"]: r["text"] or "" for r in some.collect()}
    for r in langid.predict_language(some, model).collect():
        raw = langid.PLAIN[np.frombuffer(texts[r["doc_id"]].encode(), np.uint8)]
        rows = [model.table[langid.grams(raw[i : i + n], n)[0]] for n in langid.SIZES for i in range(len(raw) - n + 1)]
        p = langid.softmax((np.mean(np.array(rows, np.float64), axis=0) + model.bias)[None] / model.temperature)[0]
        assert r["lang_pred"] == model.langs[p.argmax()] and abs(r["score"] - p.max()) < 1e-5 or r["lang_pred"] == "und"


def test_quality_blocks_do_not_change_scores(spark):
    from glossa.llm.quality import padded, train

    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)).decode() for n in (0, 1, 17, 300, 5000)] * 4
    net = train(texts, [i % 2 for i in range(len(texts))], passes=60)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    rows, first = padded(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert np.allclose(net.pooled(rows, first, block=64), net.pooled(rows, first, block=1 << 16))
    for t, pooled in zip(texts, net.pooled(rows, first), strict=True):
        own = padded(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        assert np.allclose(net.responses(own[0]).max(0), pooled, atol=1e-5)


def test_language_is_learned(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in run(spark, "op10_language_id", SF) if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in got) / len(got) > 0.98


def test_texts_without_letters_are_undetermined(spark, folder, rows):
    import regex

    texts = dict(rows)
    for r in run(spark, "op10_language_id", folder):
        assert (r["lang_pred"] == "und") == (not regex.search(r"\p{L}", texts[r["doc_id"]] or "")) and 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


# ---- 2: line dedup


def distinct_rows(spark, folder):
    return duckdb.sql(f"SELECT DISTINCT doc_id, text FROM '{folder}/documents.parquet/*.parquet'").fetchall()


def test_line_dedup_equals_its_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT DISTINCT doc_id, text FROM '{folder}/documents.parquet/*.parquet'")
    want = set(con.execute(f"SELECT doc_id, n_lines, n_removed, kept_md5 FROM ({OP2_SQL})").fetchall())
    got = {(r["doc_id"], r["n_lines"], r["n_removed"], r["kept_md5"]) for r in run(spark, "op2_line_dedup", folder)}
    assert got == want and any(r[2] for r in got)


def passages_removed(texts):
    """Brute force: text left of each document, judged on the input, by whole windows of lines."""
    lines = {d: [(i, s) for i, x in enumerate((t or "").split("\n")) if (s := x.strip(" \t\r"))] for d, t in texts.items()}
    seen, bad = set(), defaultdict(set)
    for d in sorted(lines):
        for p in range(len(lines[d])):
            for n in (1, 2, 3):
                window = lines[d][p : p + n]
                key = tuple(s for _, s in window)
                if len(window) < n or n < 3 and sum(len(re.findall(r"[^ \t\r\x0b\x0c]+", s)) for s in key) < 50 and sum(map(len, key)) < 400:
                    continue
                if key in seen:
                    bad[d] |= {i for i, _ in window}
                seen.add(key)
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in bad[d]) for d, t in texts.items()}


def test_long_passages_on_few_lines_are_removed(spark, rows, tmp_path):
    one, two = " ".join(f"word{i}" for i in range(52)), " ".join(f"other{i}" for i in range(26))
    more = [(2001, f"first start\n{one}\nend"), (2002, one), (2003, f"x\n \n{one}\r\ny"), (2004, f"{two}\n{two[::-1]}\nz"), (2005, f"q\n{two}\n\n{two[::-1]}"), (2006, two), (2007, "日本" * 200), (2008, "a\n" + "日本" * 200), (2009, f"end\n{one} and more")]
    spark.createDataFrame(rows + more, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {d: hashlib.md5(t.encode()).hexdigest() for d, t in passages_removed(dict(rows + more)).items()}
    got = {r["doc_id"]: r for r in run(spark, "op2_line_dedup", str(tmp_path))}
    assert {d: r["kept_md5"] for d, r in got.items()} == want
    assert [got[2000 + i]["n_removed"] for i in range(1, 10)] == [0, 1, 1, 0, 2, 0, 0, 1, 0]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, str(tmp_path)).collect()}
    assert 2002 not in kept and kept[2003] == "x\n \ny" and kept[2006] == two


REPEATED_IDS = [
    (None, "alpha\nbeta\ngamma\nkeep1\nkeep2\nkeep3"), (None, "y1\ny2\ny3\nalpha\nbeta\ngamma"),
    (1, "k1\nk2\nk3\nk4\nk5\nk6"), (1, "z1\nz2\nz3\nalpha\nbeta\ngamma"), (1, "k1\nk2\nk3\nk4\nk5\nk6"),
    (2, "k2\nk3\nk4\nk5\nz9"), (3, None), (3, ""), (4, "k1\nk2"),
]


def test_line_dedup_of_repeated_and_null_ids(spark, tmp_path):
    """Rows of one doc_id with other texts, and rows without doc_id, lose only lines that they repeat."""
    spark.createDataFrame(REPEATED_IDS, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    from glossa.llm.linededup import dedup_lines

    got = {(r["doc_id"], r["text"]) for r in dedup_lines(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    first = [{(None, REPEATED_IDS[0][1]), (None, "y1\ny2\ny3")}, {(None, "keep1\nkeep2\nkeep3"), (None, REPEATED_IDS[1][1])}]
    rest = {(1, REPEATED_IDS[2][1]), (1, "z1\nz2\nz3"), (2, "z9"), (3, None), (3, ""), (4, "k1\nk2")}
    assert got - rest in first and got >= rest


def test_selected_lines_are_fewer_than_lines(spark):
    from glossa.llm.linededup import minima

    lines = np.random.default_rng(0).integers(0, 1 << 63, 10_000).astype(np.uint64)
    place, first, many = minima(lines, 3)
    assert len(place) < 0.55 * len(lines) and many.sum() == len(lines) - 2 and (first[1:] == first[:-1] + many[:-1]).all()
    assert all(f <= p < f + 3 for p, f in zip(place, first, strict=True))


# ---- 3: urls


def test_urls_equal_their_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = sorted(map(repr, con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urlfilter.OP3_SQL})").fetchall()))
    assert sorted(repr(tuple(r)) for r in run(spark, "op3_url_filter", folder)) == want


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter, "digest", lambda rule: len(rule))
    store = urlfilter.Store(*urlfilter.write_stores([("ab", "/", "allow"), ("cd", "/", "block"), ("ef", "/", "block")], str(tmp_path)))
    found = store.probe(["cd/", "xy/", "ab/", "long/"])
    assert [f >= 0 for f in found] == [True, False, True, False] and store.block[found[0]] and not store.block[found[2]]


def test_rules_must_agree(tmp_path):
    with pytest.raises(ValueError):
        urlfilter.write_stores([("a", "/", "allow"), ("A", "/", "block")], str(tmp_path))


def test_rules_of_several_stores_give_the_same(spark, folder, tmp_path, monkeypatch):
    want = sorted(map(repr, run(spark, "op3_url_filter", folder)))
    monkeypatch.setattr(urlfilter, "MAX_STORE", 50)
    assert len(urlfilter.write_stores(urlfilter.RULES, str(tmp_path))) > 1
    assert sorted(map(repr, run(spark, "op3_url_filter", folder))) == want
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    assert {(r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, []).collect()} == {(None, "allow")}


# ---- 4: decontamination


def levenshtein_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = np.random.default_rng(3)
    for _ in range(60):
        p, t = ("".join(rng.choice(list("abc"), n)) for n in (rng.integers(1, 90), rng.integers(0, 120)))
        assert decontam.myers(p, t)[0] == levenshtein_in(p, t)


def test_every_passage_within_the_budget_is_found():
    rng = np.random.default_rng(4)
    item = "".join(rng.choice(list("abcdefgh "), 200)).strip()
    item = decontam.normalised(item)
    k = int(len(item) * decontam.RATE)
    matcher = decontam.Matcher([(7, item)], decontam.RATE)
    for _ in range(30):
        text = list(item)
        for _ in range(k):
            at = rng.integers(1, len(text) - 1)
            text[at : at + rng.integers(0, 2)] = list("z" * rng.integers(0, 2))
        text = decontam.normalised("noise " * 5 + "".join(text) + " more noise")
        best = levenshtein_in(item, text)
        assert [h[:2] for h in matcher.find(text)] == ([(7, best)] if best <= k else [])


def test_contaminated_documents(spark, folder, rows):
    got = run(spark, "op4_decontaminate", folder)
    long = max(rows, key=lambda r: len(r[1] or ""))
    texts = dict(rows)
    assert {(r["doc_id"], r["item_id"]) for r in got if r["item_id"] == 1} == {(long[0], 1)}
    assert {r["doc_id"] for r in got if r["item_id"] == 4} == {d for d, t in texts.items() if t == "one two"}
    assert {r["item_id"] for r in got} == {1, 4}


def test_decontamination_equals_brute_force(spark, tmp_path):
    """The query against dynamic programming over every document and item; repeated, null and other ids."""
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcde"), rng.integers(2, 6))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words, n))
    items = [(1, say(20)), (2, say(40)), (3, "Zq, x!"), (4, None), (5, "  "), (6, say(20)), (6, say(12)), (None, say(15))]
    docs = []
    for i in range(40):
        text = [say(rng.integers(0, 30)), (items[rng.choice([0, 1, 2, 5, 6, 7])][1]), say(rng.integers(0, 30))]
        item = list(text[1])
        for _ in range(rng.integers(0, 8)):
            item[rng.integers(0, len(item))] = rng.choice(list("abcde ") + [""])
        docs.append((None if i % 9 == 0 else int(i % 31), " ".join([text[0], "".join(item), text[2]]) if i % 4 else text[0]))
    docs += [(50, None), (51, ""), (52, "zq x"), (53, "azq x"), (54, "a ZQ...x b"), (55, "zq xy")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = Counter()
    for d, t in docs:
        text = decontam.normalised(t)
        for i, item in items:
            item = decontam.normalised(item)
            if not item or not text:
                continue
            far = levenshtein_in(item, text) if len(item) >= decontam.MIN_ITEM else (0 if f" {item} " in f" {text} " else 1)
            if far <= (int(len(item) * decontam.RATE) if len(item) >= decontam.MIN_ITEM else 0):
                want[d, i, far] += 1
    got = Counter((r["doc_id"], r["item_id"], r["distance"]) for r in run(spark, "op4_decontaminate", str(tmp_path)))
    assert got == want and len(got) > 20
    stage = dict(corpus_pipeline.STAGES)["decontaminate"]
    left = Counter(tuple(r) for r in stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect())
    bad = {(d, t) for d, t in docs if any(f <= (int(len(x) * decontam.RATE) if len(x) >= decontam.MIN_ITEM else 0) for _, i in items if (x := decontam.normalised(i)) and (y := decontam.normalised(t)) for f in [levenshtein_in(x, y) if len(x) >= decontam.MIN_ITEM else (0 if f" {x} " in f" {y} " else 1)])}
    assert left == Counter(d for d in docs if d not in bad) and bad


# ---- 5: repeated bytes


def repeated_bytes(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        bad = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                bad[i : i + 100] = True
            seen.add(raw[i : i + 100])
        kept = bytes(b for b, x in zip(raw, bad, strict=True) if not x)
        out[d] = (len(raw), int(bad.sum()), int((np.diff(bad.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeated_bytes_equal_brute_force(spark, folder, rows, monkeypatch, hot):
    monkeypatch.setattr(sufdedup, "HOT", hot)
    want = repeated_bytes(rows)
    for r in run(spark, "op5_suffix_dedup", folder):
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_repeated_and_null_ids_lose_only_what_they_repeat_themselves(spark, tmp_path):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    a, b, c = word(600), word(600), word(300)
    rows = [(1, a), (1, b), (2, c), (2, "short"), (3, c + a), (4, "x" + a), (4, "x" + a), (None, a), (None, c + c), (5, None), (5, ""), (6, a[100:400])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in sufdedup.dedup_bytes(docs).collect())
    assert got == Counter([(1, 600, 0), (1, 600, 0), (2, 300, 0), (2, 5, 0), (3, 900, 0), (4, 601, 600), (4, 601, 600), (None, 600, 0), (None, 600, 300), (5, 0, 0), (5, 0, 0), (6, 300, 300)])


def test_refined_buckets_are_classes_of_equal_strings():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 2, 2000).astype(np.uint8)
    text[900:1300], text[1500:1900] = text[100:500], 7
    bucket, padded = sufdedup.refined(text), text.tobytes() + bytes(100)
    classes = defaultdict(set)
    for i in range(len(text)):
        classes[padded[i : i + 100]].add(bucket[i])
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_blocks_of_long_texts_do_not_change_runs(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    windows = lambda: {i + k for _, i, m, *_ in zip(*sufdedup.runs(data, np.array([0, 5000])), strict=True) for k in range(m)}
    whole = windows()
    monkeypatch.setattr(sufdedup, "BLOCK", 700)
    assert windows() == whole == set(range(5000 - 99))


# ---- 6 and 9: tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_words_give_the_librarys_ids(name, rows, monkeypatch):
    from glossa.llm import tokens

    monkeypatch.setattr(tokens, "CACHE", 50)
    e = Encoder(tokenizer(name))
    texts = [t for _, t in rows if t] + ["  a\n\n b\tc  ", "don't 'S it's I'LL 12 345 x²", "Ünï ŉ ſ", "\n", "a\x1cy", "nb\u00a0sp", "Á \u0130I", " 's", "can'the", "x ''s", "'s's", "'"]
    rng = np.random.default_rng(0)
    letters = np.array(list(" \t\n\r'strevmldSTLabcXYZ0123.,-–’é×÷ÀßœŒžſİ¡ ²日<| "))
    texts += ["".join(rng.choice(letters[: rng.choice([8, 15, 30, len(letters)])], rng.integers(0, 40))) for _ in range(2000)]
    monkeypatch.setattr(tokens, "STEP", 1000)
    data, offsets = flat(pa.array(texts))
    ids, at = e.encode(data, offsets, 7)
    assert e.spaced is not None and len(at) == len(texts) + 1
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[b - 1] == 7 and (ids[a : b - 1] == e.whole(t)).all() and len(e(t)) == b - a - 1


def test_packing_keeps_every_id_once_with_little_padding(spark, folder):
    library = Encoder(tokenizer("byte_bpe_50k.json")).library
    docs = distinct_rows(spark, folder)
    got = run(spark, "op6_packing", folder)
    by, sequences, times = defaultdict(list), defaultdict(list), Counter()
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t in docs:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        covered = Counter()
        for r in by[d]:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            covered.update(range(r["start"], r["start"] + r["length"]))
        times[d] = covered[0]
        assert set(covered) == set(range(len(ids))) and len(set(covered.values())) == 1
    assert Counter(times.values())[2] == 2  # the two repeated rows
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 1024 - at if at & (at - 1) else 0
    ids = sum(r["length"] for r in got)
    assert padding < 0.02 * ids + 1024 and len(got) / len(docs) < 3.5


@pytest.mark.parametrize("n", [1, 2, 7, 8, 1023, 1024, 1025, 5000])
def test_cuts_cover(n):
    pieces = packing.cuts(n, 1024)
    assert sum(s for _, s in pieces) == n and {s for _, s in pieces} <= {1024 // k for k in range(1, 1025)}
    assert [a for a, _ in pieces] == list(np.cumsum([0] + [s for _, s in pieces[:-1]]))
    assert n != 1023 or [s for _, s in pieces] == [512, 341, 170]


@pytest.mark.parametrize("capacity", [1, 7, 100, 1024])
def test_left_pieces_share_sequences(capacity):
    rng = np.random.default_rng(capacity)
    left = {s: int(rng.integers(0, capacity // s)) for s in {capacity // k for k in range(1, capacity + 1)}}
    end = {}
    for length, slot, sequence, at in packing.shared_sequences(left, capacity):
        assert end.get(sequence, 0) == at and slot < left[length]
        end[sequence] = at + length
    total = sum(s * n for s, n in left.items())
    assert sum(end.values()) == total and max(end.values(), default=0) <= capacity and len(end) <= total / capacity * 1.1 + 2


@pytest.mark.parametrize("n", [1, 2, 3, 200, 30000])
def test_huffman_round_trip_and_limit(n):
    rng = np.random.default_rng(n)
    counts = rng.zipf(1.2, n) % 1_000_000 + 1
    lengths = tokenbin.code_lengths(counts)
    assert lengths.max() <= tokenbin.LIMIT and sum(2.0 ** -int(x) for x in lengths) <= 1
    book, ids = tokenbin.Book(lengths), rng.integers(0, n, 4001)
    payload, checkpoints = book.encode(ids)
    assert (book.decode(payload, checkpoints, len(ids)) == ids).all()


def test_code_lengths_are_optimal_without_a_limit():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1, 2])
    heap = [(int(c), i, 0) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    cost, k = 0, 100
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], k := k + 1, 0))
    assert int((counts * tokenbin.code_lengths(counts)).sum()) == cost


def test_damaged_blocks_are_noticed():
    book = tokenbin.Book(tokenbin.code_lengths(np.array([3, 2, 1])))
    block, _ = tokenbin.write_block(book, [(5, np.array([0, 1, 2], "<u2").tobytes()), (None, b"")], np.dtype("<u2"), 0)
    doc, null, start, size, ids = tokenbin.read_block(book, block)
    assert (doc.tolist(), null.tolist(), size.tolist(), ids.tolist()) == ([5, 0], [0, 1], [3, 0], [0, 1, 2])
    with pytest.raises(ValueError):
        tokenbin.read_block(book, block[:30] + b"\xff" + block[31:])


def test_token_files_are_read_by_another_session(spark, folder, tmp_path):
    import subprocess
    import sys

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tokenbin.write_tokens(docs, tokenizer("word_bpe_49k.json"), f"{tmp_path}/tokens", block=1000)
    want = sorted(map(tuple, tokenbin.read_tokens(spark, f"{tmp_path}/tokens").collect()))
    code = f"""
from pyspark.sql import SparkSession
from glossa.llm.tokenbin import read_tokens
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
print('rows', sorted(map(tuple, read_tokens(spark, '{tmp_path}/tokens').collect())))
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert got.splitlines()[-1] == f"rows {want}" and len(want) == docs.count()


def test_token_files_round_trip(spark, folder):
    library = Encoder(tokenizer("word_bpe_49k.json")).library
    rows = sorted(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet/*.parquet'").fetchall(), key=lambda r: r[0])
    got = sorted(run(spark, "op9_token_binary", folder), key=lambda r: r["start"])
    at = 0
    for (d, t), r in zip(rows, got, strict=True):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(r) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# ---- 7: near duplicates


def classes(rows):
    lower, sets = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, folder, rows):
    want = classes(rows)
    got = run(spark, "op7_near_duplicates", folder)
    assert len(got) == len(rows) + 2
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_links_that_stars_miss_are_found(spark):
    """A chain whose ends are unlike, in an order in which the first of a key is the wrong one."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[20 * k : 20 * k + 200]) for k in (0, 5, 2, 4, 1, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes(list(enumerate(texts)))
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {d: c for d, (_, c) in want.items()}


def test_repeated_and_null_ids_are_linked_by_their_own_texts(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    one, two, other = " ".join(words[:100]), " ".join(words[:95] + ["x"]), " ".join(words[200:300])
    rows = [(5, one), (5, other), (7, two), (9, other + " end"), (3, one), (None, one), (8, ""), (8, one), (5, one), (2, "w1 w2"), (4, "W1  W2"), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, "op7_near_duplicates", str(tmp_path)))
    assert got == Counter([(5, 96, 3, False), (5, 96, 5, True), (7, 92, 3, False), (9, 97, 5, False), (3, 96, 3, True), (None, 96, None, True), (8, 0, 8, True), (8, 96, 3, False), (5, 96, 3, False), (2, 1, 2, True), (4, 1, 2, False), (6, 0, 6, True)])
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    left = Counter(map(tuple, stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()))
    assert left == Counter([(3, one), (5, other), (None, one), (8, ""), (2, "w1 w2"), (6, None)])


def test_blocks_of_a_hot_key_lose_no_pair(spark, monkeypatch):
    """Documents of one common passage under few keys, several groups apart, by blocks of three documents."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for g in range(6):
        own = base[:60] + [f"g{g}x{i}" for i in range(60)]
        for k in range(5):
            t = list(own)
            for _ in range(k):
                t[rng.integers(60, 120)] = f"r{rng.integers(1000)}"
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    want = classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {d: c for d, (_, c) in want.items()}


def test_recall_over_a_larger_table(spark):
    """Every link of brute force over sf0.1's texts of up to 60 words, whose pairs lie nearest to the bound."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("n_chars < 400").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = classes_by_words(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    apart = [d for d in want if got[d] != want[d]]
    assert len(rows) > 500 and len(apart) <= 0.001 * len(rows)


def classes_by_words(rows):
    """classes, comparing only texts that share a shingle."""
    lower, sets, by = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), {}, defaultdict(set)
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for x in sets[d]:
            by[x].add(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in {b for x in sets[a] for b in by[x] if b > a}:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_components_of_a_long_path(spark):
    from glossa.llm.components import components

    links = spark.range(300).selectExpr("id AS u", "id + 1 AS v")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == dict.fromkeys(range(1, 301), 0)


def test_no_links_give_no_components(spark):
    from glossa.llm.components import components

    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).collect() == []


# ---- 8: media


def test_media_round_trip(spark, folder, rows):
    texts = dict(rows)
    for r in run(spark, "op8_media", folder):
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_all_five_filters_are_undone():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (11, 9)).astype(int)
    lines = np.zeros((11, 10), np.uint8)
    for y in range(11):
        kind = lines[y, 0] = y % 5
        for x in range(9):
            a, b, c = (image[y, x - 1] if x else 0), (image[y - 1, x] if y else 0), (image[y - 1, x - 1] if x and y else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x + 1] = (image[y, x] - (0, a, b, (a + b) // 2, near)[kind]) & 255
    assert (media.unfiltered(lines) == image).all()


def test_damaged_images_are_noticed():
    png = media.encode_png(np.zeros((2, 64), np.uint8))
    assert (media.decode_png(png) == 0).all()
    for bad in (png[:-3], png[:40] + b"\x01" + png[41:], b"GIF" + png[3:]):
        with pytest.raises(ValueError):
            media.decode_png(bad)
    size = struct.pack(">IIBBBBB", 64, 3, 8, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        media.decode_png(png[:8] + media.chunk(b"IHDR", size) + png[33:])


# ---- the pipeline


def language_rejects(model, text):
    """Brute force: whether the text has no letter or its best language a score under the threshold."""
    import regex

    from glossa.llm import langid

    if not regex.search(r"\p{L}", text or ""):
        return True
    raw = langid.PLAIN[np.frombuffer(text.encode(), np.uint8)]
    rows = [model.table[langid.grams(raw[i : i + n], n)[0]] for n in langid.SIZES for i in range(len(raw) - n + 1)]
    mean = np.mean(np.array(rows, np.float64), axis=0) if rows else np.zeros(len(model.langs))
    return langid.softmax((mean + model.bias)[None] / model.temperature)[0].max() < model.threshold


def test_pipeline_stages_equal_brute_force(spark, folder):
    """Each stage, on all that its predecessor kept, against brute force over the same rows."""
    from glossa.llm import langid
    from glossa.llm.common import materialize

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    items = [decontam.normalised(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    held = lambda text: any(levenshtein_in(i, text) <= int(len(i) * decontam.RATE) if len(i) >= decontam.MIN_ITEM else f" {i} " in f" {text} " for i in items if i and text)
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        out = materialize(stage(spark, docs, folder), name)
        if name == "pack":
            length = Counter()
            for r in out.dropDuplicates(["doc_id", "start"]).collect():
                length[r["doc_id"]] += r["length"]
            library = Encoder(tokenizer("byte_bpe_50k.json")).library
            assert length == {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in before.items()}
            break
        assert out.columns == columns
        after = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
        if name == "language_id":
            model = langid.fit_language(docs)
            want = {d: t for d, t in before.items() if not language_rejects(model, t)}
        elif name == "line_dedup":
            left = passages_removed(before)
            want = {d: t for d, t in left.items() if t == before[d] or any(x.strip(" \t\r") for x in t.split("\n"))}
        elif name == "near_dedup":
            want = {d: before[d] for d, (_, c) in classes(list(before.items())).items() if d == c}
        else:
            want = {d: t for d, t in before.items() if not held(decontam.normalised(t))}
        assert after == want
        docs = out


def test_pipeline_of_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
