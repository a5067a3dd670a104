"""Operators on small tables of our own: ties, caps, stores, readers, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from glossa.config import Crawler, Source
from glossa.operators import aggregate, analyze, material, review, serve, store
from glossa.plans import fixtures as X
from glossa.sources import files
from glossa.streaming import flows


def test_equal_counts_rank_by_first_place(spark):
    docs = spark.createDataFrame([(1, "zeta alpha zeta alpha beta")], "doc_id long, text string")
    assert [r["token"] for r in analyze.top_terms(docs, 3).orderBy("rank").collect()] == ["zeta", "alpha", "beta"]


def test_rank_never_exceeds_the_cap(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id"))
    top = analyze.top_per_group(rows, ["g"], [F.desc("id")], 5)
    assert {r["count"] for r in top.groupBy("g").count().collect()} == {5}


def test_ngrams_drop_stopwords_made_by_lemmas(spark):
    docs = spark.createDataFrame([(1, "thes market rises")], "doc_id long, text string")
    assert [r["gram"] for r in analyze.ngram_rows(docs, 2).collect()] == ["market rise"]


def test_tier_of_an_inflected_form_comes_from_the_earlier_list(spark):
    lists = spark.createDataFrame([("run", "high_school"), ("running", "key"), ("child", "core")], "word string, tier string")
    words = spark.createDataFrame([("running",), ("children",), ("unknown",), ("x9",)], "word string")
    got = {r["word"]: (r["lemma"], r["tier"]) for r in analyze.match_tiers(words, lists).collect()}
    assert got == {"running": ("run", "high_school"), "children": ("child", "core"), "unknown": ("unknown", "rare"), "x9": ("x9", "rare")}


def test_diversified_takes_one_of_each_type_before_a_second(spark):
    rows = aggregate.patterns(analyze.pattern_rows(X.articles(spark), keep=["source"]))
    picked = aggregate.diversified(rows, per_type=3, limit=30).orderBy("place").collect()
    first = [r["type"] for r in picked]
    assert len(set(first)) == len(first[: len(set(first))]) and len({r["example_sentence"].lower() for r in picked}) == len(picked)


def test_capped_marks_the_rest_as_overflow(spark):
    rows = spark.range(10).select(F.lit("a").alias("domain"), "id")
    got = aggregate.capped(rows, {"a": 4}, [(F.col("id"), False)]).collect()
    assert sum(r["overflow"] for r in got) == 6


def test_classification_needs_enough_evidence(spark):
    rows = spark.createDataFrame([("court order", "law", "legal", "", ""), ("plain", "none", "", "", "")], "word string, field string, category string, example_sentence string, sources string")
    got = {r["word"]: r["domain"] for r in review.classify(rows, {"politics_law": ["court"], "environment": ["carbon"]}).collect()}
    assert got == {"court order": "politics_law", "plain": "general_academic"}


def test_store_upserts_replaces_and_deletes(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, created_at string")
    s.upsert("articles", make([(1, "a", "t0"), (2, "b", "t0")]), "doc_id")
    for _ in range(2):  # twice the same: nothing changes
        s.upsert("articles", make([(2, "B", "t1"), (3, "c", "t1")]), "doc_id")
    assert sorted(map(tuple, s.read("articles").collect())) == [(1, "a", "t0"), (2, "B", "t0"), (3, "c", "t1")]
    s.replace("vocabulary", make([(1, "x", ""), (1, "y", ""), (2, "z", "")]), "doc_id")
    s.replace("vocabulary", make([(1, "w", "")]), "doc_id")
    assert sorted(r["text"] for r in s.read("vocabulary").collect()) == ["w", "z"]
    s.delete(spark.createDataFrame([(2,)], "doc_id long"))
    assert [r["doc_id"] for r in s.read("vocabulary").collect()] == [1]
    assert sorted(r["doc_id"] for r in s.read("articles").collect()) == [1, 3]


def test_store_keeps_the_table_when_a_write_fails(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    s.write("t", spark.range(3))
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        s.write_all({"t": spark.range(9), "u": broken})
    assert s.read("t").count() == 3 and not s.exists("u")
    for n in (4, 5, 6):
        s.write("t", spark.range(n))
    assert s.read("t").count() == 6


def test_commits_of_several_tables_are_one(spark, tmp_path, monkeypatch):
    """A job that dies before its pointer, in whatever step, leaves all tables as they were; its folders are found later."""
    s = store.Store(spark, str(tmp_path / "db"))
    s.write_all({"articles": spark.range(4).withColumnRenamed("id", "doc_id"), "vocabulary": spark.range(4).withColumnRenamed("id", "doc_id")})
    ids = spark.createDataFrame([(1,)], "doc_id long")
    with monkeypatch.context() as m:
        m.setattr(s, "_commit", lambda changes: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            s.delete(ids)
    assert s.read("articles").count() == s.read("vocabulary").count() == 4
    assert s.vacuum(hours=24) == 0 and s.vacuum(hours=-1) == 2 and s.read("articles").count() == 4
    s.delete(ids)
    assert s.read("articles").count() == s.read("vocabulary").count() == 3 and len(s._pointers()) == 2


def test_old_versions_go_and_point_updates_touch_one_bucket(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"), keep=2)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long")
    s.write("t", rows(*[(f"k{i}", i) for i in range(50)]))
    for n in range(5):
        s.merge("t", rows(("k7", 100 + n)), "k", buckets=8)
    assert len(s._pointers()) == 2 and len(list((tmp_path / "db" / "_commits").glob("*.json"))) == 2
    files_left = [p for p in (tmp_path / "db" / "t").rglob("__bucket=*")]
    assert len(files_left) <= 8 + 1 and not list((tmp_path / "db" / "t").glob("v-*"))
    assert {r["k"]: r["v"] for r in s.read("t").collect()} == {**{f"k{i}": i for i in range(50)}, "k7": 104}
    s.merge("t", rows(("k7", None)), "k", drop="v IS NULL")
    assert s.read("t").count() == 49
    s.write("one", rows(("a", 1)))
    s.merge("one", rows(("a", None)), "k", drop="v IS NULL")
    assert s.read("one").count() == 0 and s.read("one").columns == ["k", "v"]


def test_of_two_commits_at_once_one_fails(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "db"))
    s.write("t", spark.range(2))
    known = s._pointers()
    other = store.Store(spark, str(tmp_path / "db"))
    other.write("t", spark.range(3))
    answers = [known]  # what the first one saw before the second one committed
    real = s._pointers
    monkeypatch.setattr(s, "_pointers", lambda: answers.pop() if answers else real())
    with pytest.raises(RuntimeError, match="another job"):
        s.write("t", spark.range(9))
    assert other.read("t").count() == 3


def test_last_of_several_new_rows_counts(spark):
    old = spark.createDataFrame([(1, "a", "t0")], "doc_id long, text string, created_at string")
    rows = [(1, "b", "t1", 1), (1, "d", "t1", 3), (1, "c", "t1", 2), (2, "x", "t1", 4)]
    for deal in (rows, rows[::-1]):
        new = spark.createDataFrame(deal, "doc_id long, text string, created_at string, __order long")
        assert sorted(map(tuple, store.upsert(old, new, "doc_id").collect())) == [(1, "d", "t0"), (2, "x", "t1")]


def test_merge_writes_only_the_buckets_it_touches(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    s.merge("t", spark.range(200).withColumn("v", F.lit("old")), "id", buckets=16)
    before = s.tables()["t"]["folders"]
    s.merge("t", spark.createDataFrame([(7, "new"), (7, "new"), (500, "new")], "id long, v string"), "id", buckets=16)
    after = s.tables()["t"]["folders"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) <= 2
    rows = {r["id"]: r["v"] for r in s.read("t").collect()}
    assert len(rows) == 201 == s.read("t").count() and rows[7] == rows[500] == "new" and rows[8] == "old"


def test_empty_payload_keeps_the_old_one(spark):
    new = spark.createDataFrame([(1, "{}"), (2, '{"n": 1}'), (3, "")], "doc_id long, llm_json string")
    old = spark.createDataFrame([(1, '{"o": 1}'), (2, '{"o": 2}')], "doc_id long, llm_json string")
    got = {r["doc_id"]: r["llm_json"] for r in store.keep_payload(new, old, "doc_id").collect()}
    assert got == {1: '{"o": 1}', 2: '{"n": 1}', 3: "{}"}


def test_jsonl_articles_get_defaults_and_errors_name_the_line(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"text": "  One\\u00a0two "}\n\n{"id": "x", "title": "T", "text": "b", "metadata": {"k": "v"}}\n')
    rows = files.jsonl_articles(spark, str(path)).orderBy("title").collect()
    assert [(r["title"], r["text"], r["source"]) for r in rows] == [("T", "b", "jsonl"), ("Untitled 1", "One two", "jsonl")]
    assert rows[0]["id"] == "x" and json.loads(rows[0]["metadata_json"]) == {"k": "v"}
    path.write_text('{"title": "no text"}\n')
    with pytest.raises(Exception, match="line 1 has no text"):
        files.jsonl_articles(spark, str(path)).collect()


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("".join(("\n" if i % 7 == 3 else "") + json.dumps({"text": f"t{i}"}) + "\n" for i in range(3000)))
    want, n = {}, 0
    for i in range(3000):
        n += 2 if i % 7 == 3 else 1
        want[f"t{i}"] = f"Untitled {n}"
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["text"]: r["title"] for r in files.jsonl_articles(spark, str(path)).select("text", "title").collect()}
        exams = {r["text"]: r["id"] for r in files.exam_jsonl(spark, str(path)).select("text", "id").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == want and exams == {f"t{i}": f"kaoyan-unknown-reading-{i + 1}" for i in range(3000)}


def test_one_small_file_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(20).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    assert files.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and files.spread(one).count() == 100
    wide = many.repartition(30)
    assert files.spread(wide) is wide


def test_exam_readers_agree(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"year": "2010", "section": "A", "passage": "One  two", "text": ""}\n')
    (tmp_path / "e.csv").write_text("﻿year,section,passage\n2010,A,One two\n")
    (tmp_path / "e.txt").write_text("One two\nof  a block\n-----\n\n## head\nThree\n")
    a, b = (files.exams(spark, str(tmp_path / f"e.{x}")).collect() for x in ("jsonl", "csv"))
    assert a[0]["id"] == b[0]["id"] == "kaoyan-2010-A-1" and a[0]["text"] == b[0]["text"] == "One two"
    assert [r["text"] for r in files.exams(spark, str(tmp_path / "e.txt")).collect()] == ["One two of a block", "Three"]


def test_feed_entries_keep_the_first_of_a_url(spark, tmp_path):
    item = "<item><title>{}</title><link>https://x.org/a/{}?u=1</link><pubDate>d</pubDate></item>"
    (tmp_path / "f.xml").write_text("<rss><channel>" + item.format("One", 1) + item.format("Two", 2) + item.format("Again", 1) + "</channel></rss>")
    got = files.feed_entries(spark, str(tmp_path / "f.xml")).collect()
    assert [(r["title"], r["url"]) for r in got] == [("One", "https://x.org/a/1"), ("Two", "https://x.org/a/2")]


def test_discovery_keeps_a_third_for_searches():
    source = Source("s", archive_urls=[f"https://x.org/{i}" for i in range(9)], search_url_templates=["https://x.org/s?q={query_plus}&p={page}"], topic_queries=["a b"])
    got = files.discovery_urls(source, Crawler(max_discovery_pages_per_source=9, max_search_pages_per_query=4))
    assert got[5:8] == ["https://x.org/5", "https://x.org/s?q=a+b&p=1", "https://x.org/s?q=a+b&p=2"] and len(got) == 9
    few = files.discovery_urls(Source("s", archive_url_templates=["a?{page}"], search_url_templates=["s?{query_quote}"], topic_queries=["é"]), Crawler(max_discovery_pages_per_source=4, max_search_pages_per_query=1))
    assert few == ["a?1", "a?2", "a?3", "s?%22%C3%A9%22"]


def test_paragraphs_by_blank_lines_or_four_sentences(spark):
    rows = spark.createDataFrame([("a\n\nb",), ("One. Two. Three. Four. Five.",), ("",)], "t string")
    assert [r[0] for r in rows.select(serve.paragraphs(F.col("t"))).collect()] == [["a", "b"], ["One. Two. Three. Four.", "Five."], []]


def test_stream_batches_merge_into_the_store(spark, tmp_path):
    source, s = tmp_path / "in", store.Store(spark, str(tmp_path / "db"))
    for n in range(2):
        spark.createDataFrame([(1, f"v{n}"), (n + 10, "x")], "doc_id long, text string").coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema("doc_id long, text string").json(str(source))
        flows.store_batches(stream, s, "articles", "doc_id", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["doc_id"], r["text"]) for r in s.read("articles").collect()) == [(1, "v1"), (10, "x"), (11, "x")]


# ---- analysis


def test_scores_give_one_row_a_row(spark):
    docs = spark.createDataFrame([(1, "The court ruled."), (1, "The market fell.")], "doc_id long, text string")
    assert sorted(r["field"] for r in analyze.scores(docs).collect()) == ["economics", "law"]


def test_pmi_doesnt_depend_on_ranges(spark):
    docs = spark.createDataFrame([(i, f"alpha{i % 3} beta gamma{i % 2} delta" if i % 4 else "") for i in range(60)], "doc_id long, text string")
    want = [tuple(r) for r in analyze.pmi(docs, parts=1).collect()]
    assert want and all([tuple(r) for r in analyze.pmi(docs, parts=n).collect()] == want for n in (2, 7, 50))


def test_examples_fall_back_to_lemmas_and_then_to_nothing(spark):
    docs = spark.createDataFrame([(1, "They went home late at night yesterday. He goes there often with his friends now."), (2, "Nothing here.")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "go"), (1, "friend"), (1, "none"), (2, "go")], "doc_id long, word string")
    want = {(1, "go"): "He goes there often with his friends now.", (1, "friend"): "He goes there often with his friends now.", (1, "none"): "", (2, "go"): ""}
    for only in (None, ["go", "friend", "none"]):
        assert {(r["doc_id"], r["word"]): r["example_sentence"] for r in analyze.best_examples(asked, docs, only=only).collect()} == want


def test_review_selection_prefers_senses_and_keeps_easy_words_with_one(spark):
    """As an old table of words is chosen anew: forty stay, easy words only in a special sense that the example shows."""
    tiers = spark.createDataFrame([(w, "high_school") for w in ("school", "case", "easy", "plain")] + [(f"core{chr(97 + i % 26)}{chr(97 + i // 26)}", "core") for i in range(45)], "word string, tier string")
    rows = [(1, f"core{chr(97 + i % 26)}{chr(97 + i // 26)}", "academic/general", 5, 1, "", i) for i in range(45)]
    rows += [(1, "easy", "academic/general", 5, 9, "", 50), (1, "school", "polysemy", 1, 1, "This school of thought influenced the debate.", 51), (1, "case", "polysemy", 1, 1, "A case of wine.", 52), (1, "rarest", "domain terminology", 1, 1, "", 53)]
    frame = spark.createDataFrame(rows, "doc_id long, lemma string, category string, importance int, frequency long, example_sentence string, ord int")
    got = [r["lemma"] for r in analyze.review_selection(frame, tiers).orderBy("rank").collect()]
    assert len(got) == 40 and got[:3] == ["school", "rarest", "coreaa"] and not {"easy", "plain", "case"} & set(got)


# ---- highlights


def test_easy_words_are_marked_only_in_a_special_sense(spark):
    tiers = spark.createDataFrame([("school", "high_school"), ("influence", "core"), ("debate", "key"), ("thesis", "gre")], "word string, tier string")
    docs = spark.createDataFrame([(1, "The school opens early."), (2, "This school of thought influenced the theses of Zorgons.")], "doc_id long, text string")
    words = spark.createDataFrame([(2, "school", "school", "polysemy"), (2, "zorgon", "zorgon", "domain terminology"), (2, "early", "early", "academic/general")], "doc_id long, word string, lemma string, category string")
    got = sorted(tuple(r) for r in serve.word_highlights(docs, words, tiers).select("doc_id", "word", "lemma", "tier").collect())
    assert got == [(2, "influenced", "influence", "core"), (2, "school", "school", "specialized"), (2, "zorgons", "zorgon", "specialized")]
    scope = serve.review_scope(serve.word_highlights(docs, words, tiers), words.where("word = 'zorgon'"))
    assert [r["word"] for r in scope.collect()] == ["zorgons"]


def test_phrases_are_judged_by_their_rarest_word(spark):
    rows = spark.createDataFrame([("odd pairing", "phrase", 9, 9, 5, 1.9), ("fair deal", "phrase", 9, 9, 5, 4.0), ("at stake", "phrase", 1, 0, 0, 1.0), ("no score", "phrase", 9, 9, 5, None)], "word string, category string, frequency int, article_count int, importance int, least double").withColumn("domain", F.lit("law"))
    for rule in (review.admitted(least="least"), review.appendix_worthy(least="least")):
        assert {r["word"]: r["ok"] for r in rows.select("word", rule.alias("ok")).collect()} == {"odd pairing": False, "fair deal": True, "at stake": True, "no score": True}


def test_classification_and_admission_of_known_cases(spark):
    rows = [("liability", "unknown", "llm", 5, 5, 1, "legal responsibility for harm or damages"), ("davunetide", "science", "llm", 5, 5, 1, "a compound name"), ("take issue with", "unknown", "llm", 1, 5, 1, "to disagree with a claim")]
    frame = spark.createDataFrame(rows, "word string, field string, category string, frequency int, importance int, article_count int, example_sentence string").withColumn("sources", F.lit(""))
    got = {r["word"]: (r["domain"], r["ok"]) for r in review.classify(frame, {"politics_law": ["legal", "liability"], "environment": ["carbon"]}).withColumn("ok", review.admitted()).collect()}
    assert got["liability"] == ("politics_law", True) and not got["davunetide"][1] and got["take issue with"][1]


def test_rare_words_make_a_pair_worth_it(spark):
    docs = spark.createDataFrame([(1, "zorgon, the vexel. plain, word. plain; word.")], "doc_id long, text string")
    scores = spark.createDataFrame([("plain", 6.0), ("word", 6.0), ("zorgon", 1.0)], "word string, score double")
    without = {r["expression"] for r in analyze.collocations(docs).collect()}
    with_scores = {r["expression"] for r in analyze.collocations(docs, zipf=scores).collect()}
    assert without == set() and "zorgon vexel" in with_scores and "plain word" not in with_scores


def test_words_that_a_whole_text_lowers_to_letters_are_not_words(spark):
    from glossa.functions import text as T

    rows = spark.createDataFrame([("İx Ky ab''- 'tis rock'n'-roll dogs'' a' O’Neil‘s",)], "t string")
    assert rows.select(T.tokens(F.col("t"))).first()[0] == ["x", "y", "ab''-", "tis", "rock'n'-roll", "dogs", "a", "o'neil's"]


# ---- rules of sources, caps, round robin, corpus examples


def test_own_keywords_of_sources_count_like_patterns(spark):
    """Against the pattern of each keyword on the whole text, with keywords of signs, several words and other scripts."""
    import re

    words = ["c++", "court of law", "Market", "a.b", "naïve", "x_y", ".net", "日本", "law", "--"]
    rules = [(f"s{i % 3}", kind, k) for i, k in enumerate(words) for kind in ("prefer", "exclude")] + [("s1", "prefer", ""), ("s1", "prefer", None), ("s1", "prefer", "c++")]
    titles = ["The C++ court of law", "market a.b x_y", "naïve .net law --", "lawful c+++ a.bc", "日本 x_yz court  of law", ""]
    docs = [(i, t, "", f"s{i % 4}", t, None, 0.5, 1.0) for i, t in enumerate(titles * 2)]
    frame = spark.createDataFrame(docs, "doc_id long, title string, url string, source string, text string, corpus_type string, reliability double, weight double")
    found = analyze.source_rules(spark.createDataFrame(rules, "source string, kind string, keyword string"))
    low = F.lower("title")
    joined = frame.join(found, "source", "left").select("doc_id", *[F.sort_array(F.coalesce(analyze.rule_hits(F.col(c), analyze.runs(low), low), F.array().cast("array<string>"))).alias(c) for c in ("prefer", "exclude")])
    for r in joined.collect():
        text, source = docs[r["doc_id"]][1].lower(), docs[r["doc_id"]][3]
        want = sorted({k for s, kind, k in rules if s == source and k and kind == "prefer" and re.search(rf"(?<![A-Za-z0-9_]){re.escape(k.lower())}(?![A-Za-z0-9_])", text)})
        assert r["prefer"] == want and set(r["exclude"]) <= set(words), (text, source)
    scored = analyze.quality(frame.join(found, "source", "left"), keep=["source"])
    assert scored.count() == len(docs) and "source" in scored.columns


def test_caps_with_nulls_and_mixed_orders_equal_a_sort(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([None, 0.5, 1.0, 2.0]), rng.choice([None, "x", "y"]), i) for i in range(200)]
    order = [(F.col("score"), True), (F.col("name"), False), (F.col("n"), True)]
    frame = spark.createDataFrame(rows, "domain string, score double, name string, n long")
    got = {(r["domain"], r["n"]): (r["rank"], r["overflow"]) for r in aggregate.capped(frame, {"a": 7, "b": 1000}, order, default=5).collect()}
    for d, limit in (("a", 7), ("b", 1000), ("c", 5)):
        own = sorted((r for r in rows if r[0] == d), key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is not None, r[2] or "", -r[3]))
        for i, r in enumerate(own):
            assert got[d, r[3]] == ((i + 1, False) if i < limit else (None, True))
    assert len(got) == 200


def test_round_robin_equals_a_loop(spark):
    rng = random.Random(5)
    kinds = ["cleft", "contrast", "stance", "other", "hedging"]
    rows = [(rng.choice(kinds), f"p{i}", rng.choice([1, 2, 3]), rng.randint(1, 3), rng.randint(1, 4), 1.0, 4, rng.choice(["", "Same one.", "same  ONE.", f"Own {i % 9}."])) for i in range(120)]
    rows = [(k, p, {"cleft": 3, "contrast": 3, "stance": 2, "other": 1, "hedging": 2}[k], *rest) for k, p, _, *rest in rows]
    frame = spark.createDataFrame(rows, "type string, pattern string, priority int, article_count long, frequency long, example_quality double, importance int, example_sentence string")
    for per_type, limit in ((4, 40), (2, 7), (30, 200)):
        lists = {k: sorted((r for r in rows if r[0] == k), key=lambda r: (-r[3], -r[4], -r[5], -r[6], r[1])) for k in kinds}
        turns = sorted((k for k in kinds if k != "other"), key=lambda k: (-lists[k][0][2], -len(lists[k]), k)) + ["other"]
        want, used = [], set()
        for turn in range(per_type):
            for k in turns:
                while len(want) < limit and (k != "other" or turn < 2) and lists[k]:
                    r = lists[k].pop(0)
                    plain = " ".join(r[7].split()).lower()
                    if not plain or plain not in used:
                        used.add(plain)
                        want.append(r[1])
                        break
        assert [r["pattern"] for r in aggregate.diversified(frame, per_type=per_type, limit=limit).orderBy("place").collect()] == want


def test_all_corpus_examples_or_the_first(spark):
    words = spark.createDataFrame([("issue", f"f{i % 5}" if i % 4 else None, "c", i, 1, "s", f"Example {i}.") for i in range(1500)], "word string, field string, category string, frequency long, article_count long, sources string, example_sentence string")
    none = spark.createDataFrame([("none", "2-gram", 1, 1, "", "")], "expression string, type string, frequency long, article_count long, sources string, example_sentence string")
    asked = spark.createDataFrame([("Issue",), ("none",)], "headword string")
    every = material.corpus_hits(asked, words, none)
    assert every.count() == 1500 and material.corpus_hits(asked, words, none, k=3).count() == 3
    first = material.corpus_hits(asked, words, none, k=1).collect()
    assert [r["example_sentence"] for r in first] == [r["example_sentence"] for r in every.where("rank = 1").collect()]
