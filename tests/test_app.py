"""The application layer end to end on a store of its own; providers, settings, payloads."""

import json

import pytest
from pyspark.sql import functions as F

from glossa import config
from glossa.app import Corpus, crawler_options
from glossa.operators import payloads
from glossa.plans import fixtures as X
from glossa.sources import providers as P

GOOD = json.dumps({"vocabulary": [{"lemma": "statute", "category": "legal", "exam_importance": "high"}, {"lemma": "at issue", "exam_importance": "medium", "meaning_in_context": "in dispute"}], "rhetoric": [{"type": "Author attitude", "original_sentence": "They argue that it holds.", "explanation": "view"}, {"type": "x", "original_sentence": "no explanation"}], "exam_value": {"primary_domain": "law"}, "_meta": {"model": "m"}})


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    path = root / "in.jsonl"
    path.write_text("\n".join(json.dumps({"id": str(i), "title": t, "source": s, "field": f, "text": x or "-"}) for i, t, s, f, x in X.ARTICLES))
    tiers = spark.createDataFrame([("court", "core"), ("market", "core"), ("study", "key"), ("climate", "key"), ("appeal", "gre")], "word string, tier string")
    c = Corpus(spark, str(root / "db"), tiers=tiers)
    assert c.add_jsonl(str(path)) == len(X.ARTICLES)
    c.analyse()
    return c


def test_import_again_changes_nothing_but_replaced_rows(corpus):
    assert corpus.articles().count() == len(X.ARTICLES)


def test_analysis_has_all_sections(corpus):
    for name in ("analyses", "vocabulary", "collocations", "polysemy", "sentence_patterns"):
        assert corpus.store.read(name).count() > 0
    assert corpus.store.read("analyses").count() == len(X.ARTICLES)


def test_payload_survives_an_analysis_without_one(spark, corpus):
    answers = spark.createDataFrame([("9", GOOD)], "doc_id string, payload string")
    corpus.analyse(["9"], answers=answers)
    assert corpus.store.read("vocabulary").where("doc_id = '9' AND word = 'statute'").count() >= 1
    corpus.analyse(["9"])
    row = corpus.article("9").first()
    assert row["llm_json"] == GOOD and row["status"] == "valid" and row["structure"].startswith("Author attitude")
    corpus.analyse(only_missing=True, limit=1)
    assert corpus.store.read("analyses").count() == len(X.ARTICLES)


def test_search_page_and_progress(corpus):
    corpus.set_progress("2", 40, "2030-01-01T00:00:00")
    corpus.set_progress("2", 60, "2030-01-02T00:00:00")
    assert corpus.search("market").first()["progress"] == 60
    assert corpus.clear_progress() == 1 and corpus.progress().count() == 0
    with pytest.raises(ValueError):
        corpus.search("x", limit=101)


def test_mastery_last_write_wins_and_none_clears(corpus):
    corpus.set_mastery(" Court ", "learning")
    corpus.set_mastery("court", "mastered")
    assert [tuple(r) for r in corpus.mastery().collect()] == [("court", "mastered")]
    assert corpus.vocabulary().where("lemma = 'court'").first()["level"] == "mastered"
    corpus.set_mastery("court", None)
    assert corpus.mastery().count() == 0


def test_exports_hold_all_parts(spark, corpus, tmp_path):
    corpus.export(str(tmp_path))
    read = lambda name: "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/{name}").select("value").collect())
    assert spark.read.option("sep", "\t").csv(f"{tmp_path}/cards").count() > 0
    reports = [p.name for p in (tmp_path / "articles").iterdir() if p.is_dir()]
    assert len(reports) == len(X.ARTICLES) and "name=1-court-and-case" in reports
    one = read("articles/name=1-court-and-case")
    for part in ("# Court and case", "| Source | review |", "## Frequent words", "| Word | Category |", "### case", "- Risk: high", "## Sentence patterns", "- Type: stance", "The court held"):
        assert part in one
    assert "| at issue | legal/political expression |" in read("expressions") and "Special senses" in read("polysemy") and "Sentence patterns" in read("sentence-patterns")
    assert f"- Articles: {len(X.ARTICLES)}" in read("index") and "| Markets | wire |" in read("index")
    assert any(p.name.startswith("name=law") for p in (tmp_path / "fields").iterdir())


SEED = """
metadata: {title: T, subtitle: S}
domains:
  politics_law:
    title: Politics and law
    overview: O
    entries:
      - {headword: issue, kind: polysemy, pos: noun, importance: 5, chinese: dispute, english: a point in dispute, common: problem, exam: legal, risk: not only a problem, collocations: [at issue], contrast: [{term: matter, note: wider}], examples: [{sentence: What is at issue is power., zh: zh text}]}
      - {headword: court, kind: term, importance: 4, chinese: c}
  science_academic: {title: Science, overview: kept, entries: [{headword: robust, importance: 3}]}
sentence_patterns:
  - {pattern: It is A that B, function: focus, chinese: zh, example: It is he that came., importance: 4}
"""


def test_book_has_all_parts(spark, corpus, tmp_path):
    (tmp_path / "seed.yaml").write_text(SEED)
    profiles = {"politics_law": ["court", "appeal", "statute"], "economics_business": ["market"]}
    names = corpus.write_book(str(tmp_path / "book"), profiles, seed=str(tmp_path / "seed.yaml"))
    read = lambda name: (tmp_path / "book" / name).read_text()
    assert {"index.md", "politics-and-law.md", "research-methods-and-argument.md", "seven-day-plan.md", "sentence-templates.md"} <= set(names)
    law = read("politics-and-law.md")
    for part in ("# T - Politics and law", "| issue | special sense | noun | ★★★★★ | legal |", "### issue", "* **legal**", "* Usual sense: problem", "* Risk: not only a problem", "* Collocations: `at issue`", "`matter`: wider", "What is at **issue** is power."):
        assert part in law
    assert law.index("### issue") < law.index("### court") and "From the corpus" in law[law.index("### court") :]
    assert "### robust" in read("research-methods-and-argument.md") and "kept" in read("research-methods-and-argument.md")
    index = read("index.md")
    assert "## Quick list" in index and "| issue | Politics and law | dispute | not only a problem |" in index and "| court |" not in index
    assert "[Politics and law](./politics-and-law.md)" in index and "### It is A that B" in read("sentence-templates.md") and "## Patterns of the corpus" in read("sentence-templates.md")
    assert "Day 7" in read("seven-day-plan.md")
    plain = {r["name"]: r["body"] for r in corpus.book(profiles).collect()}
    assert "index.md" in plain and "not only a problem" not in "".join(plain.values())
    assert not (tmp_path / "book" / "_temporary").exists() or not list((tmp_path / "book" / "_temporary").iterdir())


def test_the_book_as_one_document(corpus, tmp_path):
    (tmp_path / "seed.yaml").write_text(SEED)
    assert corpus.write_book(str(tmp_path), {"politics_law": ["court"]}, seed=str(tmp_path / "seed.yaml"), single=True) == ["book.md"]
    text = (tmp_path / "book.md").read_text()
    parts = ["# T", "## How to use", "## Quick list", "| issue | Politics and law | dispute |", "## Contents", "1. [Politics and law](#politics-and-law)", "\n---\n", "## Politics and law", "### issue", "### court", "## Sentence templates", "### It is A that B", "## Patterns of the corpus", "## Frequent words to be checked", "## Seven-day plan", "| Day 7 |"]
    at = [text.index(p) for p in parts]
    assert at == sorted(at) and text.count("\n### issue") == 1


def test_a_file_a_row_or_none_at_all(spark, tmp_path):
    from glossa.operators import export

    rows = spark.createDataFrame([("a.md", "A"), ("sub/b.md", None), ("c.md", "é")], "name string, body string").repartition(3)
    export.write_files(rows, str(tmp_path / "out"))
    export.write_files(rows.where("name = 'a.md'").withColumn("body", F.lit("new")), f"file://{tmp_path}/out")
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.md")} == {"a.md": "new", "sub/b.md": "", "c.md": "é"}
    for bad in ([("x.md", "1"), ("x.md", "2")], [("../up.md", "1")]):
        with pytest.raises(Exception, match="x.md|up.md"):
            export.write_files(spark.createDataFrame(bad, "name string, body string").repartition(2), str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").rglob("*.md")) and not (tmp_path / "up.md").exists()


def test_dictionary_stages_and_cache(spark, corpus):
    """Tables, then a remote one for plain words, then a model for phrases; what nobody knows isn't asked for again."""
    words = lambda *ws: spark.createDataFrame([(w,) for w in ws], "word string")
    first = spark.createDataFrame([("court", "k", "zh court", ""), ("empty", "", "", "")], "word string, phonetic string, zh string, en string")
    second = spark.createDataFrame([("court", "zh other"), ("empty", "zh second"), ("ad hoc", "zh ad hoc")], "word string, zh string")

    def remote():
        return lambda w: {"market": '{"zh": "m"}', "blank": '{"zh": "", "en": ""}'}[w]

    def model():
        return lambda w: {"federal law": '{"en": "of the union", "pos": "phrase"}'}[w]

    asked = words("Court ", "court", "empty", "ad hoc", "market", "blank", "federal law", "a b c d e f g", "x1", "", None)
    got = {r["word"]: tuple(r)[1:] for r in corpus.define(asked, [first, second], remote=remote, model=model).collect()}
    assert got == {"court": ("k", "zh court", "", ""), "empty": ("", "zh second", "", ""), "ad hoc": ("", "zh ad hoc", "", ""), "market": ("", "m", "", ""), "federal law": ("", "", "of the union", "phrase"), **dict.fromkeys(["blank", "a b c d e f g", "x1"], ("",) * 4)}

    def forbidden():
        return lambda w: 1 / 0

    again = corpus.define(asked, [], remote=forbidden, model=forbidden)
    assert {r["word"]: tuple(r)[1:] for r in again.collect()} == got
    # a phrase that was not found is asked for again under another policy, a single word is not
    later = corpus.define(words("a b c", "x1", "blank"), [spark.createDataFrame([("blank", "late")], "word string, zh string")], model=lambda: lambda w: '{"zh": "now"}', policy="v2")
    assert {r["word"]: r["zh"] for r in later.collect()} == {"a b c": "now", "x1": "", "blank": ""}
    assert corpus.store.read("dictionary").where("not_found").count() == 3


def test_article_detail_is_in_reading_order(corpus):
    row = corpus.article("9").first()
    words = [(w["importance"], w["frequency"]) for w in row["vocabulary"]]
    assert words == sorted(words, reverse=True) and all(w["tier"] not in ("high_school",) or w["category"] == "polysemy" for w in row["vocabulary"])
    assert row["minutes"] == 1 and {h["word"] for h in row["highlights"]} >= {"court"} and row["progress"] == 0
    assert [p["importance"] for p in row["sentence_patterns"]] == sorted((p["importance"] for p in row["sentence_patterns"]), reverse=True)
    assert corpus.review_highlights("9").count() <= len(row["highlights"])


def test_own_words_join_the_notebook(corpus):
    corpus.set_personal(" Zyzzyva ", "zyzzyva", article_id="9", example="A zyzzyva.", at="t0")
    corpus.set_personal("zyzzyva", "zyzzyva", at="t1")
    corpus.set_mastery("zyzzyva", "learning")
    row = corpus.notebook().where("lemma = 'zyzzyva'").first()
    assert (row["example_sentence"], row["article_count"], row["level"], row["categories"]) == ("A zyzzyva.", 1, "learning", "personal")
    corpus.set_mastery("zyzzyva", None)
    assert corpus.notebook().where("lemma = 'zyzzyva'").count() == 0


def test_one_article_by_its_text(corpus):
    key = corpus.add_article("By hand", "The court held that  the case was weak. However, it may change.", url="https://x.org/hand")
    assert corpus.article(key).first()["text"].startswith("The court held that the case") and corpus.known_url("https://x.org/hand")
    assert not corpus.known_url("") and not corpus.known_url("https://x.org/none")
    with pytest.raises(ValueError):
        corpus.add_article("t", "  ")
    order = [(r["created_at"], r["id"]) for r in corpus.listed().collect()]
    assert order == sorted(order)
    corpus.store.delete(corpus.spark.createDataFrame([(key,)], "doc_id string"), parent="none")
    corpus.store.write("articles", corpus.store.read("articles").where(F.col("id") != key))


def test_reselection_runs_once(spark, corpus):
    rows = corpus.store.read("vocabulary")
    easy = rows.where("doc_id = '9'").limit(1).withColumns({"lemma": F.lit("appeal"), "word": F.lit("appeal"), "category": F.lit("academic/general"), "importance": F.lit(9)})
    many = spark.range(60).select(F.concat(F.lit("court"), F.lit("")).alias("lemma"), F.col("id")).crossJoin(easy.drop("lemma")).withColumn("word", F.concat(F.lit("w"), F.col("id").cast("string"))).drop("id").select(*rows.columns)
    corpus.store.write("vocabulary", rows.unionByName(many))
    assert corpus.reselect() > 0
    assert corpus.store.read("vocabulary").where("doc_id = '9'").count() <= 40
    assert corpus.reselect() == 0 and corpus.metadata().count() == 1
    corpus.store.write("vocabulary", rows)
    health = corpus.health()
    assert health["counts"]["articles"] == len(X.ARTICLES) and health["unique_words"] > 0 and "law" in health["fields"]


def test_fetch_takes_new_good_articles_within_limits(spark, tmp_path):
    tiers = spark.createDataFrame([("court", "core")], "word string, tier string")
    corpus = Corpus(spark, str(tmp_path / "db"), tiers=tiers)
    body = "<p>" + " ".join("The court held that the policy may change because research on climate regulation found strong evidence in many regions." for _ in range(60)) + "</p>"
    pages = [(f"https://x.org/{i}", f"<title>Court policy {i}</title><meta name='description' content='about {i}'>" + (body + f"<p>{i}</p>" if i != 2 else "short")) for i in range(8)]
    conf = config.from_mapping({"crawler": {"max_articles_per_source": 3, "candidate_multiplier": 2, "min_quality_score": 0.5}, "sources": [{"name": "A", "field_hint": "law", "quality_weight": 1.1}, {"name": "B"}, {"name": "C", "enabled": False}, {"name": "D", "min_quality_score": 9.9}]})
    rows = [("A", i, f"https://x.org/{i}", f"t{i}", "") for i in range(7)] + [("B", 0, "https://x.org/0", "t", ""), ("B", 1, "https://x.org/7", "t", "2020"), ("C", 0, "https://x.org/7", "t", ""), ("D", 0, "https://x.org/7", "t", "")]
    args = spark.createDataFrame(pages, "url string, html string"), spark.createDataFrame(rows, "source string, ord int, url string, title string, published_at string")
    got = corpus.fetch(conf, *args)
    assert got == {"A": 3, "B": 1, "D": 0}
    arts = {r["url"]: r for r in corpus.articles().collect()}
    assert set(arts) == {"https://x.org/0", "https://x.org/1", "https://x.org/3", "https://x.org/7"}
    assert arts["https://x.org/0"]["source"] == "A" and arts["https://x.org/0"]["title"] == "Court policy 0" and json.loads(arts["https://x.org/0"]["metadata_json"])["description"] == "about 0"
    assert corpus.fetch(conf, *args, source="b") == {"B": 0} and corpus.fetch(conf, *args, source="none") == {}
    assert [s["name"] for s in crawler_options(conf)["sources"]] == ["A", "B", "D"] and crawler_options(conf)["defaults"]["limit"] == 3


def test_curation_deletes_children_too(corpus):
    poor = [r["doc_id"] for r in corpus.curate(3.2, dry_run=True).collect()]
    assert poor and corpus.articles().count() == len(X.ARTICLES)
    corpus.curate(3.2)
    assert corpus.articles().count() == len(X.ARTICLES) - len(poor)
    assert corpus.store.read("vocabulary").where(F.col("doc_id").isin(poor)).count() == 0


def test_payload_rows(spark):
    df = spark.createDataFrame([(1, GOOD), (2, "{broken"), (3, "")], "doc_id long, payload string")
    assert [(r["lemma"], r["category"], r["field"], r["importance"]) for r in payloads.vocabulary(df).collect()] == [("statute", "domain terminology", "unknown", 5), ("at issue", "academic/general", "unknown", 4)]
    assert [r["expression"] for r in payloads.expressions(df).collect()] == ["at issue"]
    assert [(r["type"], r["pattern"]) for r in payloads.patterns(df).collect()] == [("stance", "argue / claim that ...")]
    assert {r["doc_id"]: r["status"] for r in payloads.digest(df).collect()} == {1: "valid", 2: "invalid", 3: "local"}


def test_dictionary_order_negative_cache_and_breaker():
    def down(key):
        raise ConnectionError

    broken, model = P.Breaker(down, limit=2), P.Fake({"at stake": "m"})
    d = P.Dictionary(local=[P.Fake({"court": "local"})], remote=[broken, P.Fake({"market": "remote"})], model=model)
    assert (d.lookup("Court"), d.lookup("market"), d.lookup("at  stake"), d.lookup("zzz")) == ("local", "remote", "m", None)
    assert broken.failures == 2 and d.lookup("zzz") is None and model.calls == ["at stake"]
    d.cache["no way"] = {P.NOT_FOUND: True, "policy": "old"}
    assert d.lookup("no way") is None and d.cache["no way"]["policy"] == "v1"


def test_papers_merge_with_the_first_list_winning(spark):
    html = '<a href="/paper/2010-1">One</a><a href="/paper/2011-2"><b></b></a><a href="/other/2012-1">x</a>'
    assert [tuple(r) for r in P.listed_papers(spark.createDataFrame([(html,)], "html string")).collect()] == [("2011-2", "2011-2"), ("2010-1", "One")]
    found = P.probed_papers(lambda s: s in ("2010-1", "2009-2"), 2009, 2010)
    assert [p.title for p in P.merged_papers([P.Paper("2010-1", "T", "u")], found)] == ["T", "2009-2"]


def test_providers_answer_by_task(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    assert {r["k"]: r["answer"] for r in P.answered(rows, "k", lambda: P.Fake({"a": "A"})).collect()} == {"a": "A", "b": None}


def test_settings_merge(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"crawler": {"min_text_chars": 5, "max_articles_per_source": 2}, "sources": [{"name": "S", "search_url_templates": ["t"], "topic_queries": ["own", "q"]}, {"name": "T", "quality_weight": 0.5, "search_url_templates": ["t"]}]}))
    (tmp_path / "b.json").write_text(json.dumps({"crawler": {"min_text_chars": 9}, "sources": []}))
    c = config.load(tmp_path / "a.json", tmp_path / "b.json", tmp_path / "none.json", env={"GLOSSA_OUTPUT_DIR": "o", "OPENAI_API_KEY": "k"})
    assert (c.crawler.min_text_chars, c.crawler.max_articles_per_source, c.output.markdown_dir, c.llm.api_key, [s.name for s in c.sources]) == (9, 2, "o", "k", ["S", "T"])
    assert [s.topic_queries for s in config.with_queries(c.sources, ["q", "q", "r"], boosted=[])] == [["q", "r", "own"], []]
    assert [s.topic_queries for s in config.with_queries(c.sources, ["x"], boosted=["t"])] == [["x", "own", "q"], ["x"]]
    (tmp_path / "c.json").write_text('{"crawler": {"nope": 1}}')
    with pytest.raises(ValueError):
        config.load(tmp_path / "c.json", env={})


def test_defaults_of_settings():
    c = config.from_mapping({})
    w = c.crawler
    assert (w.max_articles_per_source, w.min_text_chars, w.candidate_multiplier, w.min_quality_score, w.max_discovery_pages_per_source, w.max_search_pages_per_query, w.delay_seconds, w.request_timeout_seconds) == (5, 800, 8, 6.0, 20, 2, 1.0, 20)
    s = config.Source("x")
    assert (s.reliability, s.quality_weight, s.category, s.min_quality_score, s.enabled) == (0.8, 1.0, "general", None, True)


def test_settings_in_yaml_with_an_overlay(tmp_path):
    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "sources.yaml").write_text("""
database: {path: data/one}
crawler:
  user_agent: agent
  max_discovery_pages_per_source: 3
llm: {model: m}
sources:
  - name: Paper
    category: news
    archive_url_templates: ["https://paper.example/archive?page={page}"]
    topic_queries: [climate]
""")
    (tmp_path / "config" / "local.yaml").write_text("llm: {api_key: secret}\nsources: []\nmdict: {oxford_path: a.mdx}\n")
    c = config.load_default(root=tmp_path, env={"GLOSSA_DB_PATH": "data/two"})
    assert (c.database.path, c.crawler.user_agent, c.llm.model, c.llm.api_key, c.mdict.oxford_path) == ("data/two", "agent", "m", "secret", "a.mdx")
    assert [(s.name, s.category, s.topic_queries) for s in c.sources] == [("Paper", "news", ["climate"])]
    assert config.load_default(tmp_path / "none.yaml", root=tmp_path, env={}).llm.api_key == ""


@pytest.mark.parametrize("name", ["local.json", "local.yaml"])
def test_settings_are_written_over_a_file(tmp_path, name):
    path = tmp_path / "deep" / name
    config.save_settings(path, {"llm": {"model": "a", "api_key": "k"}})
    config.save_settings(path, {"llm": {"model": "b", "api_key": None}, "mdict": {"oxford_path": "x"}})
    assert config.read(path) == {"llm": {"model": "b"}, "mdict": {"oxford_path": "x"}}
    with pytest.raises(ValueError):
        config.save_settings(path, {"llm": {"nope": 1}})
    with pytest.raises(ValueError):
        config.save_settings(path, {"other": {}})


# ---- models and dictionaries


def test_settings_are_shown_without_the_key():
    c = config.from_mapping({"llm": {"model": "m", "api_key": "secret"}})
    assert config.shown(c) == {"model": "m", "base_url": "", "api_key_set": True}


def test_a_model_says_whether_it_answers():
    ok, down = (lambda u, h, b: {"choices": [{"message": {"content": "ok"}}]}), (lambda u, h, b: 1 / 0)
    assert P.reachable(P.ChatModel(ok, "m", url="u")) == (True, "ok") and P.reachable(P.ChatModel(ok, "m"))[0] is False
    assert P.reachable(P.ChatModel(down, "m", url="u"))[1].startswith("ZeroDivisionError") and P.reachable(P.ChatModel(lambda u, h, b: {}, "m", url="u")) == (False, "an empty reply")


def test_messages_and_endpoints():
    assert P.message_text({"content": " x "}) == " x " and P.message_text({"content": "", "reasoning_content": "r"}) == "r"
    assert P.message_text({"content": [{"text": "a"}, {"content": "b"}, {}]}) == "a\nb" and P.message_text({}) == ""
    assert P.base_url("https://a/v1/chat/completions") == "https://a/v1" and P.base_url("http://h:11434/") == "http://h:11434/v1" and P.base_url(" https://a/v1/ ") == "https://a/v1"


def test_replies_are_decoded():
    whole = {"vocabulary": [], "rhetoric": [], "exam_value": {}}
    assert P.decoded(f"draft {{}} {json.dumps(whole)} tail {{\"x\": 1}}") == whole
    assert P.decoded("```JSON\n{\"a\": 1}\n```") == {"a": 1} and P.decoded("{\"cut\": ") == {"raw": "{\"cut\": "}


def test_model_gives_complete_analyses_only(spark):
    whole = {"vocabulary": [], "rhetoric": [], "exam_value": {}}
    asked = []

    def post(url, headers, body):
        asked.append((url, body["messages"][1]["content"]))
        return {"choices": [{"message": {"content": replies.pop(0)}}]}

    replies = [json.dumps(whole), "{}", ""]
    model = P.ChatModel(post, "m", url="https://a/v1/chat/completions", api_key="k")
    out = json.loads(model('{"title": "t"}'))
    assert out["_meta"] == {"model": "m", "prompt_version": "v1"} and asked[0] == ("https://a/v1/chat/completions", '{"title": "t"}')
    for _ in range(2):
        with pytest.raises(LookupError):
            model("x")
    with pytest.raises(LookupError):
        P.ChatModel(post, "m")("x")
    replies[:] = ["[1]", "{\"b\": 2}"]
    assert json.loads(model.in_parts("x", {"vocabulary": "p", "exam_value": "q"})) == {"vocabulary": [1], "exam_value": {"b": 2}}
    docs = spark.createDataFrame([(1, "t", "s", "word " * 3000)], "doc_id long, title string, source string, text string")
    article = json.loads(P.model_inputs(docs).first()["article"])
    assert article["title"] == "t" and len(article["text"]) < 6600 and "\n...\n" in article["text"]


FIRST = """<div class="webtop"><span class="phon">/a/</span><span class="phon">/a/</span><span class="phon">/b/</span><span class="pos">noun</span></div>
<span class="phon">/other/</span><li class="sense"><span class="def">a point <chn>zh</chn>in dispute</span><deft>one</deft><deft>one</deft><deft>two</deft></li>"""
PLAIN = '<span class="unbox"><span class="phon">/no/</span></span><span class="phon">/yes/</span><xt><chn>hidden</chn></xt><chn>shown</chn><div class="sense">[transitive] to go away <span>x</span></div>'
SECOND = '<span class="C1_text_blue">sense one；</span><span class="C1_text_blue">A sentence!</span><div class="C1_explanation_box"><span>n</span>If you go, <a>you</a> leave.</div><b class="C1_word_class">VERB</b>'


def test_entries_of_html_dictionaries():
    assert P.first_dictionary_entry(FIRST) == {"phonetic": "/a/ | /b/", "zh": "one；two", "en": "a point in dispute", "pos": "noun"}
    assert P.first_dictionary_entry(PLAIN) == {"phonetic": "/yes/", "zh": "shown", "en": "to go away", "pos": ""}
    assert P.second_dictionary_entry(SECOND) == {"phonetic": "", "zh": "sense one", "en": "If you go, leave.", "pos": "VERB"}
    d = P.Dictionary(local=[P.html_dictionary(P.Fake({"go": PLAIN, "no": "<p>x</p>"}), P.first_dictionary_entry), P.html_dictionary(P.Fake({"no": SECOND}), P.second_dictionary_entry)])
    assert json.loads(d.lookup("go"))["zh"] == "shown" and json.loads(d.lookup("no"))["zh"] == "sense one"


def test_cache_of_a_dictionary_round_trips(tmp_path):
    assert P.load_cache(tmp_path / "none.json") == {}
    P.save_cache({"a": {"entry": "é"}}, tmp_path / "deep" / "c.json")
    assert P.load_cache(tmp_path / "deep" / "c.json") == {"a": {"entry": "é"}}
    (tmp_path / "bad.json").write_text("{")
    assert P.load_cache(tmp_path / "bad.json") == {}


def test_scanned_papers_are_an_error(spark):
    from glossa.sources import files

    rows = spark.createDataFrame([("2010-1", "u", "f", "too short")], "slug string, url string, pdf_url string, text string")
    with pytest.raises(Exception, match="no text in paper 2010-1"):
        files.paper_articles(rows).collect()
    pages = spark.createDataFrame([("x href=\"/uploads\\/2010/ab.pdf?x=/uploads/\\2010/c.pdf\"",), ("/uploads/2010/ab.pdf\"",), ("none",), (None,)], "html string")
    assert [r[0] for r in pages.select(files.pdf_link(F.col("html"))).collect()] == ["/uploads/2010/c.pdf", "/uploads/2010/ab.pdf", None, None]


def test_index_pages_list_their_papers_together_or_each_its_own(spark):
    pages = spark.createDataFrame([(1, '<a href="/paper/2010-1">One</a><a href="/paper/2010-1">Again</a>'), (2, '<a href="/paper/2010-1">One</a>'), (3, '<a href="/paper/2011-2"></a>')], "page int, html string")
    assert [tuple(r) for r in P.listed_papers(pages).collect()] == [("2011-2", "2011-2"), ("2010-1", "Again")]
    assert [tuple(r) for r in P.listed_papers(pages, by=["page"]).collect()] == [(3, "2011-2", "2011-2"), (1, "2010-1", "Again"), (2, "2010-1", "One")]
