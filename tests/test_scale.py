"""What queries do on larger tables than the smallest ones, told from small inputs and from plans."""

import contextlib
import io
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from glossa.functions import lexicon as L
from glossa.functions import text as T
from glossa.operators import aggregate, analyze, serve
from glossa.plans import fixtures, table_queries
from glossa.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_slugs_of_several_pages(spark, tmp_path):
    """from 9,000 pages on, several pages link to papers of one slug."""
    spark.createDataFrame([(i, f"https://h{i}.example.com/word{i}", "") for i in (1, 2, 3, 4, 9001, 9002, 9003, 18001)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = con.sql(f"SELECT slug, title FROM ({ORACLES['paper_index']})").fetchall()
    assert len(wanted) == 7
    assert sorted(map(tuple, QUERIES["paper_index"](spark, str(tmp_path)).select("slug", "title").collect())) == sorted(wanted)


def test_words_of_a_dictionary_chain_are_made_once(spark):
    """the stages read a table of the words, not the documents again."""
    files = QUERIES["dictionary_chain"](spark, SF).inputFiles()
    assert files and not [f for f in files if "documents" in f]


def test_texts_move_and_not_their_ngrams(spark):
    """F9 (and F3, F7, F8): n-grams are counted in the task that has the text; only texts are exchanged, by their key."""
    said = plan(QUERIES["ngram_topk_per_doc"](spark, SF))
    assert "hashpartitioning(doc_id" in said and not [x for x in said.splitlines() if "hashpartitioning" in x and "gram" in x.split("hashpartitioning(")[1].split(")")[0]]


def test_rules_go_to_the_texts(spark):
    """texts aren't dealt by their source, of which there are few."""
    said = plan(QUERIES["quality_by_source"](spark, SF))
    assert "BroadcastHashJoin" in said and "SortMergeJoin" not in said


def test_cues_lose_no_pattern(spark):
    """a sentence is tried against the patterns only if it has a cue; none that fits is without one."""
    parts = [re.sub(r"\.\{1,100\}|\.\+", " x ", p) for _, _, _, p in L.PATTERNS]
    words = sorted({w for p in parts for w in re.findall(r"[a-z]+(?: [a-z]+)*", re.sub(r"\\.|\[.*?\]|[?^]", " ", p))})
    rng = random.Random(3)
    some = [s for w in words for s in (w, f"So, {w.upper()} it is, as it was", f"x{w} {w}x", f"“{w}” the x that", f"é{w}, {w} is")]
    some += [" ".join(rng.choice(words + [",", "x", "than", "as", "that", "is"]) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(some)], "i int, s string")
    listed = [list(p) for p in L.PATTERNS]
    got = rows.select("s", T.pattern_codes(F.col("s")).alias("a"), T.pattern_codes(F.col("s"), listed).alias("b")).collect()
    assert [r for r in got if r["a"] != r["b"]] == []
    assert {c for r in got for c in r["a"]} == {c for c, *_ in L.PATTERNS}
    # only sentences with a cue meet the fourteen patterns
    said = plan(rows.select(T.pattern_codes(F.col("s")).alias("a")))
    assert said.index("RLIKE") < said.index("filter(")


def test_sentences_by_one_look_for_abbreviations(spark):
    """abbreviations are tried only where a text has them; texts are cut as by trying all of them one after the other."""
    rng = random.Random(5)
    words = [*L.ABBREVIATIONS, *[a.lower() for a in L.ABBREVIATIONS], "a.", "J.", "é.", "x2.", "problems.", "\u212a.", "Go!", "why?", "end.", "U.S.A.", "i.e.g.", "Mrs.Ms.", "(b.)", "c.d."]
    some = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "", "\u00a0"]) for _ in range(rng.randint(1, 12))) for _ in range(2000)]

    def one_by_one(text):
        held = text
        for a in L.ABBREVIATIONS:
            held = re.sub("(?i)" + re.escape(a), a.replace(".", T.DOT), held, flags=re.ASCII)
        held = re.sub(r"(?<![^\W_])(?<!_)([A-Za-z])\.", lambda m: m[1] + T.DOT, held)
        return [s for s in (p.replace(T.DOT, ".").strip() for p in re.split(r"(?<=[.!?])\s+", held.strip())) if s]

    got = spark.createDataFrame([(s,) for s in some], "s string").select("s", T.sentences(F.col("s")).alias("a")).collect()
    assert [(r["s"], r["a"], one_by_one(r["s"])) for r in got if r["a"] != one_by_one(r["s"])][:3] == []
    said = plan(spark.createDataFrame([("a",)], "s string").select(T.sentences(F.col("s"))))
    assert "(?<=U" in said


def test_sense_stems_begin_words():
    """only sentences with a word that begins as one of the lexicon meet its patterns, not those with its letters somewhere."""
    stems = analyze.sense_stems()
    assert re.search(stems, "A Case.") and re.search(stems, "it was held") and not re.search(stems, "a showcase of households")


def test_pattern_rows_are_made_once(spark):
    """counts, kinds and examples read one written table of hits, not the documents three times."""
    files = QUERIES["pattern_aggregate"](spark, SF).inputFiles()
    assert files and not [f for f in files if "documents" in f]


def test_texts_do_not_move_by_their_words(spark):
    """the lists' words are a small table beside the texts; no word's rows of all texts meet in one task."""
    said = plan(QUERIES["article_highlights"](spark, SF))
    assert "BroadcastHashJoin" in said and "hashpartitioning(word" not in said and "hashpartitioning(token" not in said


def test_highlights_of_rows_of_one_text_and_of_none(spark):
    """rows of one doc_id are one text, rows without doc_id keep their lists' words."""
    docs = spark.createDataFrame([(1, "Stated zorgons here"), (1, "a zorgon, stated"), (None, "we stated zorgon"), (2, "zorgon")], "doc_id long, text string")
    own = spark.createDataFrame([(1, "zorgon", "Zorgons", "domain terminology"), (None, "zorgon", "zorgon", "polysemy"), (3, "zorgon", "zorgon", "polysemy")], "doc_id long, word string, lemma string, category string")
    tiers = spark.createDataFrame([("state", "core")], "word string, tier string")
    got = serve.word_highlights(docs, own, tiers).select("doc_id", "pos", "word", "lemma", "tier").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, "stated", "state", "core"), (1, 1, "zorgons", "zorgon", "specialized"), (1, 1, "zorgon", "zorgon", "specialized"), (None, 1, "stated", "state", "core")], key=str)


def test_ngrams_and_their_texts_are_sums(spark):
    """frequency and number of texts without a shuffle of pairs of n-gram and text; rows of one doc_id count as one text."""
    rows = [(1, "market prices rise, market prices fall"), (1, "market prices rise"), (2, "the market prices rise again"), (None, "market prices rise"), (3, None), (4, ""), (5, "one"), (6, "alpha beta the beta alpha beta gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = analyze.ngram_rows(docs, [2, 3]).groupBy("n", "gram").agg(F.count("*").alias("frequency"), F.count_distinct("doc_id").alias("article_count"))
    out = analyze.ngram_articles(docs, [2, 3])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 8
    shuffled = [x for x in plan(out).splitlines() if "hashpartitioning" in x]
    assert shuffled and not [x for x in shuffled if "doc_id" in x and "REPARTITION_BY_NUM" not in x]  # only whole texts move by their key


@pytest.mark.parametrize("name", ["domain_overflow", "domain_cap", "review_admit", "book_chapters"])
def test_words_are_added_up_where_their_texts_are(spark, name):
    """Only texts, by their part, and sums, by entry, are exchanged; no task sorts or shuffles a row for each word of a text."""
    said = plan(QUERIES[name](spark, SF))
    moved = [x for x in said.splitlines() if "Exchange" in x and "Broadcast" not in x and "domain" not in x]
    assert [x for x in moved if "shufflepartitionidpassthrough" in x] and [x for x in moved if re.search(r"hashpartitioning\(field#\d+, word#\d+, lemma#\d+, category#\d+, ", x)]
    assert not [x for x in moved if "shufflepartitionidpassthrough" not in x and not re.search(r"hashpartitioning\(field#\d+, word#\d+, lemma#\d+, category#\d+, ", x)]
    assert "SortAggregate" not in said and "doc_id" not in said.split("ObjectHashAggregate")[1]


def test_vocabulary_of_odd_texts(spark, tmp_path):
    """rows of one doc_id are one text with the rows' languages and sources, as in the SQL; rows without doc_id or words give nothing."""
    rows = [(1, "market market prices", "en", "a"), (1, "market rises", "de", "b"), (1, "prices", "en", "b"), (3, "market", "en", "a"), (3, "market", "en", "a"), (6, "zorgon", None, "c"), (12, "zorgon zorgon", None, "c"), (None, "market", "en", "d"), (7, None, "en", "a"), (8, "", "en", "a"), (9, "of the", "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["aggregate_vocabulary"](spark, str(tmp_path))
    wanted = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['aggregate_vocabulary']})").fetchall()
    assert len(wanted) > 5
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)


def test_both_ways_to_a_vocabulary(spark):
    """words counted inside their texts' rows, in one part or several, give what tables of words and articles give."""
    rng = random.Random(7)
    words = ["market", "price", "running", "studies", "zorgon", "the", "it", "went", "théâtre", "don't"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 40]))), rng.choice(["en", "de", None]), rng.choice("abc")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, field string, source string").withColumn("metadata_json", F.when(F.col("doc_id") % 4 == 0, F.format_string('{"citation": "c%d"}', "doc_id")))
    cited = F.get_json_object("metadata_json", "$.citation")
    wanted = aggregate.vocabulary(table_queries.entries_of(analyze.term_counts(docs, keep=["field"])), docs)
    assert wanted.count() > 12
    for parts in (1, 5):
        terms = analyze.text_terms(docs, aggregate.marks(F.col("field"), F.col("source"), cited).alias("marks"), parts=parts)
        got = aggregate.text_vocabulary(table_queries.entries_of(terms)).select(*wanted.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)


def odd_documents(spark, path: str) -> duckdb.DuckDBPyConnection:
    """Texts of inflected words of lists, stopwords and others; rows of one doc_id, rows without doc_id, text, words or language."""
    rng = random.Random(11)
    bases = ["tion", "thon", "ment", "thth", "thhe", "thre", "rein", "thnt", "er", "be", "stat", "stated", "zorgon", "that", "them", "when", "go", "went", "was", "study", "studie", "leav", "leaves", "market", "pass", "abcd", "It"]
    ends = ["", "", "", "s", "ed", "ing", "es", "ies", "'s", "sed", "ings", "eding", "ss"]
    word = lambda: rng.choice(bases) + rng.choice(ends)
    rows = [(i % 70, " ".join(word() for _ in range(rng.choice([0, 1, 3, 30, 200]))), rng.choice(["en", "de", None]), rng.choice("abc")) for i in range(90)]
    rows += [(None, "stated thons zorgons market " * 5, "en", "a"), (None, "ments", "en", "a"), (200, None, "en", "a"), (200, "market " * 6, "de", "a"), (201, "", "en", "a"), (202, "of the 12 ’s", "en", "a")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con


def exchanged(said: str) -> list[str]:
    return [x for x in said.splitlines() if "Exchange" in x and "Broadcast" not in x]


def test_highlights_in_scope_are_found_where_their_texts_are(spark, tmp_path):
    """F1 of round 4: only texts move; words, forms and vocabulary meet in their text's task. Rows of one doc_id are one text, whatever their languages."""
    moved = exchanged(plan(QUERIES["highlight_scope"](spark, SF)))
    assert moved and not [x for x in moved if "hashpartitioning(doc_id" not in x and "RoundRobin" not in x] and len([x for x in moved if "hashpartitioning" in x]) == 1
    con = odd_documents(spark, str(tmp_path))
    got = QUERIES["highlight_scope"](spark, str(tmp_path))
    wanted = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['highlight_scope']})").fetchall()
    assert {r[-1] for r in wanted} == {"core", "key", "gre", "specialized"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)


def test_highlights_are_found_where_their_texts_are(spark, tmp_path):
    """F2 of round 4: nothing but texts moves, and no table of the vocabulary is written; the same as with a vocabulary from elsewhere."""
    odd = odd_documents(spark, str(tmp_path))
    said = QUERIES["article_highlights"](spark, str(tmp_path))
    moved = exchanged(plan(said))
    assert len([x for x in moved if "hashpartitioning" in x]) == 1 and [x for x in moved if "hashpartitioning(doc_id" in x and "REPARTITION_BY_NUM" in x]
    wanted = odd.sql(f"SELECT {', '.join(said.columns)} FROM ({ORACLES['article_highlights']})").fetchall()
    got = sorted(map(tuple, said.collect()), key=str)
    assert len(got) > 500 and got == sorted(wanted, key=str)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    words = table_queries.vocab(spark, str(tmp_path)).where("doc_id IS NOT NULL").withColumn("lemma", F.col("word"))
    assert sorted(map(tuple, serve.word_highlights(docs, words, fixtures.tiers(spark)).select(*said.columns).collect()), key=str) == got


def test_review_words_are_chosen_where_their_texts_are(spark, tmp_path):
    """F3 of round 4: only texts move, not a row for each word of each text; rows of one doc_id and rows without as in the SQL."""
    moved = exchanged(plan(QUERIES["review_selection"](spark, SF)))
    assert len([x for x in moved if "hashpartitioning" in x]) == 1 and [x for x in moved if "hashpartitioning(doc_id" in x and "REPARTITION_BY_NUM" in x]
    con = odd_documents(spark, str(tmp_path))
    got = QUERIES["review_selection"](spark, str(tmp_path))
    # of equal places the SQL leaves the order open: the first of a word, and what is chosen but for the last ones
    wanted = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['review_selection']})").fetchall()
    con.execute("CREATE VIEW ones AS SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) = 1")
    single = {r[0] for r in con.sql("FROM ones").fetchall()}
    rows = list(map(tuple, got.collect()))
    part = lambda rs, keep: sorted((r for r in rs if (r[0] in single) == keep), key=str)
    assert len(part(rows, True)) > 200 and part(rows, True) == part(wanted, True)
    order = lambda rs: sorted((r[0], r[6], r[2], r[3], r[4]) for r in part(rs, False))
    assert len(part(rows, False)) > 200 and order(rows) == order(wanted)
