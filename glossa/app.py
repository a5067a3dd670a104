"""The corpus as an application: import, analyse, curate, read, export. Each step is one Spark plan a table."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .functions import lexicon as L
from .functions import text as T
from .operators import aggregate, analyze, dictionary, export, material, payloads, review, serve
from .operators.store import Store, keep_payload, merge_personal
from .sources import files
from .sources.work import written

ARTICLE = ["id", "title", "source", "url", "published_at", "field", "text", "metadata_json", "created_at"]


class Corpus:
    """Articles and their analysis below one root."""

    def __init__(self, spark: SparkSession, root: str, *, tiers: DataFrame | None = None, domains: dict = L.DOMAINS):
        self.spark, self.store, self.domains = spark, Store(spark, root), domains
        self.tiers = tiers if tiers is not None else spark.createDataFrame([], "word string, tier string")

    def articles(self) -> DataFrame:
        return self.store.read("articles").withColumn("doc_id", F.col("id"))

    def listed(self) -> DataFrame:
        """All articles in the order of their import."""
        return self.articles().orderBy("created_at", "id")

    def known_url(self, url: str) -> bool:
        """Whether an article of this url is here; an empty url never is."""
        return url != "" and self.store.exists("articles") and self.articles().where(F.col("url") == url).limit(1).count() == 1

    # ---- import

    def add_article(self, title: str, text: str, *, source: str = "manual", url: str = "", field: str = "unknown", least_chars: int = 0) -> str:
        """One article by its text, analysed at once; its id."""
        if len(text.strip()) < max(1, least_chars):
            raise ValueError("the text is too short")
        row = self.spark.createDataFrame([(title, source, url, "", field, text, "{}")], "title string, source string, url string, published_at string, field string, text string, metadata_json string").withColumn("text", T.squeezed(F.col("text")))
        row = row.withColumn("id", T.stable_id(F.col("source"), F.col("title"), F.col("text")))
        key = row.first()["id"]
        self.add(row)
        self.analyse([key])
        return key

    def add(self, articles: DataFrame) -> int:
        """Insert or replace articles by id; created_at of known ones stays. How many were given."""
        rows = articles.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).select(*ARTICLE, F.monotonically_increasing_id().alias("__order"))
        self.store.upsert("articles", rows, "id")
        return rows.count()

    def add_jsonl(self, path: str) -> int:
        return self.add(files.jsonl_articles(self.spark, path))

    def add_exams(self, path: str) -> int:
        return self.add(files.exams(self.spark, path))

    def add_pages(self, pages: DataFrame, *, source: str, least_chars: int = 0) -> int:
        """Saved pages (page_id, url, html) of new urls as articles."""
        known = self.articles().select("url") if self.store.exists("articles") else self.spark.createDataFrame([], "url string")
        fresh = pages.join(known.distinct(), "url", "left_anti")
        rows = files.page_articles(fresh).where(F.length("text") >= least_chars)
        return self.add(rows.select(T.stable_id(F.lit(source), F.col("title"), F.col("text")).alias("id"), "title", F.lit(source).alias("source"), "url", F.lit("").alias("published_at"), F.lit("unknown").alias("field"), "text", F.lit("{}").alias("metadata_json")))

    # ---- analysis

    def analyse(self, ids: list[str] | None = None, *, answers: DataFrame | None = None, only_missing: bool = False, limit: int | None = None) -> None:
        """Replace the analysis of the chosen articles; answers: (doc_id, payload) of a language model.

        An empty payload keeps the one that is stored. Rows of a payload are added to the local ones, which win.
        """
        docs = self.articles()
        if ids is not None:
            docs = docs.where(F.col("id").isin(ids))
        if only_missing and self.store.exists("analyses"):
            docs = docs.join(serve.missing_analysis(docs, self.store.read("analyses")), "doc_id", "left_semi")
        if limit:
            docs = docs.orderBy("created_at", "id").limit(limit)
        docs = docs.persist()
        done = docs.select("doc_id")
        given = answers if answers is not None else self.spark.createDataFrame([], "doc_id string, payload string")
        given = given.join(done, "doc_id", "left_semi")
        scores = analyze.scores(docs, self.domains)
        words = analyze.review_vocabulary(docs, self.tiers, self.domains).withColumns({"lemma": F.col("word"), "ord": F.col("rank")}).drop("rank")
        extra = payloads.vocabulary(given).where(~F.contains("lemma", F.lit(" "))).withColumns({"word": F.col("lemma"), "ord": F.col("ord") + 1_000}).drop("meaning")
        # the payload's words join the local ones, which win; then the review words are chosen from all of them
        words = payloads.merged(words, payloads.first_of_key(extra, ["doc_id", "lemma", "category"], "ord"), ["doc_id", "lemma", "category"])
        words = analyze.review_selection(words, self.tiers).drop("tier", "rank", "ord")
        phrases = payloads.merged(analyze.collocations(docs).drop("rank"), payloads.expressions(given).drop("ord"), ["doc_id", "expression"])
        senses, patterns = analyze.sense_rows(docs), payloads.merged(analyze.pattern_rows(docs, keep=["source"]), payloads.patterns(given).join(docs.select("doc_id", "source"), "doc_id"), ["doc_id", "type", "sentence"])
        count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
        counts = done.join(count(words.where("category = 'domain terminology'"), "domain_terms"), "doc_id", "left").join(count(senses, "senses"), "doc_id", "left").join(count(patterns, "patterns"), "doc_id", "left")
        rows = scores.join(analyze.exam_value(counts), "doc_id").join(given.select("doc_id", F.col("payload").alias("llm_json")), "doc_id", "left").withColumn("llm_json", F.coalesce("llm_json", F.lit("{}")))
        if self.store.exists("analyses"):
            rows = keep_payload(rows, self.store.read("analyses"), "doc_id")
        tables = {"analyses": rows, "vocabulary": words, "collocations": phrases, "polysemy": senses, "sentence_patterns": patterns}
        self.store.write_all({name: self.store.replaced(name, df, "doc_id", done) for name, df in tables.items()})
        docs.unpersist()

    def curate(self, least: float, *, dry_run: bool = False) -> DataFrame:
        """Delete articles of low quality with all that belongs to them; their ids (doc_id), which a table of the store keeps."""
        self.store.write("curated", serve.low_quality(self.articles(), self.store.read("analyses"), least))
        poor = self.store.read("curated")
        if not dry_run:
            self.store.delete(poor, parent_key="id")
        return poor

    # ---- reading

    def search(self, query: str = "", *, field: str = "", offset: int = 0, limit: int = 24) -> DataFrame:
        if not 1 <= limit <= 100:
            raise ValueError("limit is 1 to 100")
        rows = serve.summaries(serve.search(self.articles(), query), self.store.read("analyses"), self.progress())
        if field:
            rows = rows.where(F.col("field") == field)
        return serve.page(rows, [F.desc("read_at"), F.asc("title"), F.asc("doc_id")], offset, limit)

    def progress(self) -> DataFrame:
        return self.store.read("reading_progress") if self.store.exists("reading_progress") else self.spark.createDataFrame([], "doc_id string, progress int, last_read_at string")

    def set_progress(self, doc_id: str, progress: int, at: str) -> None:
        if not 0 <= progress <= 100:
            raise ValueError("progress is 0 to 100")
        self.store.merge("reading_progress", self.spark.createDataFrame([(doc_id, progress, at)], "doc_id string, progress int, last_read_at string"), "doc_id")

    def clear_progress(self) -> int:
        n = self.progress().count()
        self.store.write("reading_progress", self.progress().limit(0))
        return n

    def set_mastery(self, lemma: str, level: str | None) -> None:
        """learning, familiar or mastered; None forgets the word."""
        if level not in (None, "learning", "familiar", "mastered"):
            raise ValueError(level)
        key = lemma.replace("’", "'").strip().lower()
        rows = self.spark.createDataFrame([(key, level)], "lemma string, level string")
        self.store.merge("word_mastery", rows, "lemma", drop="level IS NULL")

    def mastery(self) -> DataFrame:
        return self.store.read("word_mastery") if self.store.exists("word_mastery") else self.spark.createDataFrame([], "lemma string, level string")

    def vocabulary(self) -> DataFrame:
        return aggregate.vocabulary_list(self.store.read("vocabulary"), self.articles(), self.mastery())

    def article(self, doc_id: str) -> DataFrame:
        """One article with its analysis, progress, digest, child rows in reading order, and highlighted words."""
        one = self.articles().where(F.col("id") == doc_id)
        children = {n: self.store.read(n).where(F.col("doc_id") == doc_id) for n in ("vocabulary", "collocations", "polysemy", "sentence_patterns")}
        words = children["vocabulary"]
        found = analyze.match_tiers(words.select(F.col("lemma").alias("word")).distinct(), self.tiers).select(F.col("word").alias("lemma"), "tier")
        weight = T.mapped(F.col("tier"), {t: str(max(i, 1)) for t, i in L.TIERS.items()}, F.lit("1")).cast("int")
        children["vocabulary"] = serve.with_mastery(payloads.shown_vocabulary(words.join(found, "lemma")).withColumn("importance", weight), self.mastery())
        marks = serve.word_highlights(one, children["vocabulary"], self.tiers)
        full = serve.detail(one, self.store.read("analyses"), self.progress(), {**children, "highlights": marks})
        full = full.join(payloads.digest(full.select("doc_id", F.col("llm_json").alias("payload"))).drop("domain"), "doc_id", "left")
        return full.withColumn("minutes", serve.reading_minutes(F.col("text")))

    def review_highlights(self, doc_id: str) -> DataFrame:
        """Only those highlights of an article that its review words hold."""
        one, words = self.articles().where(F.col("id") == doc_id), self.store.read("vocabulary").where(F.col("doc_id") == doc_id)
        return serve.review_scope(serve.word_highlights(one, words, self.tiers), words)

    def set_personal(self, lemma: str, word: str, *, article_id: str | None = None, example: str = "", at: str = "") -> None:
        """Remember a word of one's own; a later mark keeps what it doesn't give anew."""
        row = self.spark.createDataFrame([(lemma.strip().lower(), word, article_id, example, at)], "lemma string, word string, article_id string, example_sentence string, created_at string")
        old = self.personal()
        self.store.write("personal_vocabulary", merge_personal(old, row))

    def personal(self) -> DataFrame:
        return self.store.read("personal_vocabulary") if self.store.exists("personal_vocabulary") else self.spark.createDataFrame([], "lemma string, word string, article_id string, example_sentence string, created_at string")

    def notebook(self) -> DataFrame:
        """The vocabulary list, and one's own words that it lacks."""
        return serve.with_personal(self.vocabulary(), serve.personal_words(self.personal(), self.mastery()))

    def vocabulary_page(self, query: str = "", *, mastery: str = "", offset: int = 0, limit: int = 40) -> tuple[DataFrame, int]:
        """A page of the notebook as a reader sees it, and how many rows there are in all."""
        words = self.notebook()
        found = analyze.match_tiers(words.select(F.col("lemma").alias("word")).distinct(), self.tiers).select(F.col("word").alias("lemma"), "tier")
        rows = serve.visible_vocabulary(words, found, query=query, mastery=mastery)
        return serve.page(rows, [*[F.desc(c) for c in serve.VOCABULARY_ORDER], F.asc("lemma")], offset, limit), rows.count()

    # ---- upkeep

    def metadata(self) -> DataFrame:
        return self.store.read("app_metadata") if self.store.exists("app_metadata") else self.spark.createDataFrame([], "key string, value string")

    def reselect(self, marker: str = "vocabulary_selection_v3") -> int:
        """Once a store: choose the review words of all articles anew; how many rows went (0 if it was done before)."""
        if not self.store.exists("vocabulary") or self.metadata().where(F.col("key") == marker).limit(1).count():
            return 0
        rows = self.store.read("vocabulary")
        before = rows.count()
        kept = analyze.review_selection(rows.withColumn("ord", F.monotonically_increasing_id()), self.tiers).select(*rows.columns)
        self.store.write("vocabulary", kept)
        gone = before - self.store.read("vocabulary").count()
        self.store.upsert("app_metadata", self.spark.createDataFrame([(marker, str(gone))], "key string, value string"), "key", keep=())
        return gone

    # ---- fetching

    def fetch(self, conf: settings.Config, pages: DataFrame, candidates: DataFrame, *, source: str = "all", limit: int | None = None, topic_query: str = "") -> dict[str, int]:
        """New articles of the enabled sources, from pages that a provider has fetched; how many each gave.

        candidates: source, ord, url, title, published_at; pages: url, html. Candidates come from discovery (sources.files)
        in the order of targets. Known urls, short texts and texts of low quality are left out; each source gives at most
        its limit of articles out of its first limit * multiplier candidates. topic_query is put before a source's own.
        """
        chosen = [s for s in conf.sources if s.enabled and source.lower() in ("all", s.name.lower())]
        if not chosen:
            return {}
        if topic_query.strip():
            chosen = settings.with_queries(chosen, [topic_query.strip()], boosted=[], least=float("-inf"))
        crawler = conf.crawler
        rows = [(s.name, s.field_hint, s.category, float(s.reliability), float(s.quality_weight), float(crawler.min_quality_score if s.min_quality_score is None else s.min_quality_score)) for s in chosen]
        known = self.spark.createDataFrame(rows, "source string, hint string, category string, reliability double, weight double, min_quality_score double")
        first = candidates.groupBy("source", "url").agg(F.min_by(F.struct("ord", "title", "published_at"), "ord").alias("c")).select("source", "url", "c.*")
        read = files.page_articles(pages.withColumn("page_id", F.lit(0))).withColumnRenamed("title", "page_title").drop("page_id")
        rows = first.join(F.broadcast(known), "source").join(read, "url")
        plain = lambda c: F.coalesce(F.col(c), F.lit(""))
        rows = rows.withColumns({"title": F.coalesce(F.nullif("page_title", F.lit("")), F.nullif(T.squeezed(F.col("title")), F.lit("")), F.col("url")), "published_at": plain("published_at")})
        own = [(s.name, kind, k) for s in chosen for kind, keys in (("prefer", s.prefer_keywords), ("exclude", s.exclude_keywords)) for k in keys]
        rules = analyze.source_rules(self.spark.createDataFrame(own, "source string, kind string, keyword string"))
        docs = rows.join(rules, "source", "left").withColumns({"doc_id": F.col("url"), "corpus_type": F.lit(None).cast("string")})
        scored = analyze.quality(docs, keep=rows.columns).select(*rows.columns, "quality_score", "quality_keep")
        seen = self.articles().select("url") if self.store.exists("articles") else self.spark.createDataFrame([], "url string")
        target = crawler.max_articles_per_source if limit is None else limit
        good = files.accepted(scored, seen, least_chars=crawler.min_text_chars, least_score=crawler.min_quality_score, target=target, multiplier=crawler.candidate_multiplier)
        about = F.to_json(F.struct("site_name", "author", "date", "description", F.col("category").alias("source_category"), F.col("reliability").alias("source_reliability"), F.col("weight").alias("source_quality_weight"), "min_quality_score", "quality_score", "quality_keep"))
        # one article a url, whichever sources lead to it: the first source by name order of the settings
        place = T.mapped(F.col("source"), {s.name: str(i) for i, s in enumerate(chosen)}, F.lit("0")).cast("int")
        new = good.withColumn("place", place).groupBy("url").agg(F.min_by(F.struct("source", "title", "published_at", "hint", "text", about.alias("metadata_json")), "place").alias("a")).select("url", "a.*")
        new = new.select(T.stable_id(F.col("source"), F.col("title"), F.col("text")).alias("id"), "title", "source", "url", "published_at", F.col("hint").alias("field"), "text", "metadata_json").persist()
        counts = {r["source"]: r["n"] for r in new.groupBy("source").agg(F.count("*").alias("n")).collect()}  # one row a source
        self.add(new)
        new.unpersist()
        return {s.name: counts.get(s.name, 0) for s in chosen}

    # ---- exports

    def export(self, path: str) -> None:
        """Below path: a report an article and field, expressions, special senses, patterns, an index, flash cards."""
        arts = self.articles()
        tables = {n: self.store.read(n) for n in ("analyses", "vocabulary", "collocations", "polysemy", "sentence_patterns")}
        words, found = aggregate.vocabulary(tables["vocabulary"], arts), aggregate.collocations(tables["collocations"], arts)
        senses, shapes = aggregate.senses(tables["polysemy"], arts), aggregate.patterns(tables["sentence_patterns"])
        export.write_by(export.reports(arts, *tables.values()), f"{path}/articles", "name", "body")
        export.write_by(export.field_reports(words), f"{path}/fields", "name", "body")
        lines = {
            "expressions": (export.expression_lines(found.where(review.exportable_expression())), "Expressions", ["Expression", "Type", "Meaning", "Frequency", "Articles", "Importance", "Example"]),
            "polysemy": (export.sense_lines(senses), "Special senses", ["Word", "Usual sense", "Sense here", "Articles", "Example", "Sources"]),
            "sentence-patterns": (export.pattern_lines(shapes), "Sentence patterns", ["Type", "Template", "Articles", "Frequency", "Importance", "Example"]),
        }
        for name, (rows, title, columns) in lines.items():
            export.write_lines(rows, f"{path}/{name}", title, columns)
        facts = [f"- Articles: {arts.count()}", f"- Words: {words.count()}", f"- Expressions: {found.count()}", f"- Special senses: {senses.count()}"]
        export.write_lines(export.index_lines(arts, tables["analyses"]), f"{path}/index", "Index", ["Title", "Source", "Field", "Difficulty", "Exam value"], *facts)
        export.write_cards(words, f"{path}/cards")

    def pattern_guide(self, seeds: list[dict] | None = None) -> DataFrame:
        """(body), one row: the guide to sentence patterns in Markdown."""
        rows = [(i, *[p.get(c) for c in ("pattern", "function", "chinese", "example")], int(p.get("importance") or 0)) for i, p in enumerate(seeds or [])]
        chosen = aggregate.diversified(aggregate.patterns(self.store.read("sentence_patterns")))
        return material.pattern_guide(self.spark.createDataFrame(rows, material.PATTERN), chosen)

    def book(self, profiles: dict, *, seed: str | None = None, limits: dict = review.LIMITS, glosses: DataFrame | None = None, single: bool = False) -> DataFrame:
        """(name, body): the review book in Markdown as files: an index, a chapter a domain, patterns, appendix, plan; or one document.

        profiles: keywords of each domain. seed: path of a seed book. Chapters hold the seed's entries and the corpus words
        within the limits.
        """
        arts = self.articles()
        if seed:
            about, domains, entries, templates = files.seed_book(self.spark, seed)
        else:
            about, templates = {}, []
            domains = self.spark.createDataFrame([], "key string, ord int, title string, overview string")
            entries = self.spark.createDataFrame([], material.ENTRY)
        domains, entries = material.normalised_domains(domains, entries)
        found = aggregate.collocations(self.store.read("collocations"), arts)
        words = aggregate.vocabulary(self.store.read("vocabulary"), arts)
        merged = aggregate.merge_vocabulary(words.where(review.exportable_word()).withColumn("ord", F.concat("field", "category"))).withColumn("sources", F.lit(""))
        seeds = entries.select("headword")
        rows = review.classify(material.without_seed(merged, seeds), profiles)
        admitted = rows.where(review.admitted())
        order = material.entry_order(F.lower(F.btrim("word")), F.col("category"))
        marked = aggregate.capped(admitted, limits, order)
        kept = marked.where("NOT overflow")
        rejected = rows.where(~F.coalesce(review.admitted(), F.lit(False))).unionByName(marked.where("overflow").select(*rows.columns))
        known = glosses if glosses is not None else self.spark.createDataFrame([], "word string, phonetic string, zh string, en string")
        own = entries.withColumns({"word": F.col("headword"), "category": F.col("kind"), "seed": F.lit(True), "frequency": F.lit(0).cast("long"), "article_count": F.lit(0).cast("long"), "example_sentence": F.lit("")})
        corpus = kept.withColumns({"seed": F.lit(False), "ord": F.col("rank"), "pos": F.lit("")}).select("domain", "ord", "word", "category", "importance", "frequency", "article_count", "example_sentence", "seed", "pos")
        every = material.with_details(own.unionByName(corpus, allowMissingColumns=True), known)
        # entries without an example of their own show one of the corpus
        bare = every.where((F.coalesce("example_sentence", F.lit("")) == "") & (F.coalesce(F.size("examples"), F.lit(0)) <= 0))
        hits = material.corpus_hits(bare.select(F.col("word").alias("headword")), words, found, k=1)
        hits = hits.select(F.col("headword").alias("word"), F.col("example_sentence").alias("__example"), material.hit_source(hits).alias("__source"))
        every = every.withColumn("source", material.hit_source(every)).join(hits, "word", "left")
        need = (F.coalesce("example_sentence", F.lit("")) == "") & (F.coalesce(F.size("examples"), F.lit(0)) <= 0)
        every = every.withColumns({"source": F.when(need, F.col("__source")).otherwise(F.col("source")), "example_sentence": F.when(need, F.col("__example")).otherwise(F.col("example_sentence"))}).drop("__example", "__source")
        labels = material.LABELS
        late = {
            labels["templates"]: self.pattern_guide(templates),
            labels["appendix"]: material.appendix(material.appendix_words(rejected, seeds), material.expression_candidates(found)),
            labels["plan"]: material.plan(),
        }
        pages, quick = material.book_pages(material.chapters(every, domains), domains, late), material.quick_list(entries, domains)
        return material.whole_book(pages, quick, about) if single else material.book_files(pages, quick, about)

    def write_book(self, path: str, profiles: dict, **options) -> list[str]:
        """The book's files below path, written by the executors; their names."""
        book = written(self.book(profiles, **options))
        export.write_files(book, path)
        return [r["name"] for r in book.select("name").orderBy("name").collect()]  # a row a chapter

    def define(self, words: DataFrame, tables: list[DataFrame], *, remote=None, model=None, **options) -> DataFrame:
        """(word, phonetic, zh, en, pos) of words (word): from the stored cache, else from tables, a remote dictionary, a model.

        What is learned, also that a word is known nowhere, is merged into the cache's buckets before anything is returned.
        """
        cache = self.store.read("dictionary") if self.store.exists("dictionary") else self.spark.createDataFrame([], dictionary.CACHE)
        found = dictionary.looked_up(words, cache, tables, remote=remote, model=model, **options)
        self.store.merge("dictionary", dictionary.cache_rows(found), "word", keep=())
        asked = words.select(dictionary.word_key(F.col("word")).alias("word")).where("word <> ''").distinct()
        return asked.join(self.store.read("dictionary"), "word", "left").select("word", *[F.coalesce(c, F.lit("")).alias(c) for c in dictionary.FIELDS])

    def health(self) -> dict:
        """Row counts of the tables, distinct lemmas, and the fields of the analyses."""
        counts = {n: self.store.read(n).count() if self.store.exists(n) else 0 for n in ("articles", "analyses", "vocabulary", "collocations")}
        words = self.store.read("vocabulary").select("lemma").distinct().count() if counts["vocabulary"] else 0
        fields = [r[0] for r in self.store.read("analyses").where("field <> ''").select("field").distinct().orderBy("field").collect()] if counts["analyses"] else []
        return {"counts": counts, "unique_words": words, "fields": fields}

    def topics(self, k: int = 24) -> list[str]:
        exams = self.articles().where(analyze.exam_text_rows())
        return [r["gram"] for r in analyze.topic_queries(exams.select("doc_id", "text"), k=k).collect()]


def crawler_options(conf: settings.Config) -> dict:
    """What a reader may choose for a fetch: the enabled sources and the defaults."""
    c = conf.crawler
    return {
        "sources": [{"name": s.name, "field": s.field_hint, "category": s.category, "enabled": s.enabled} for s in conf.sources if s.enabled],
        "defaults": {"limit": min(c.max_articles_per_source, 5), "request_timeout_seconds": c.request_timeout_seconds, "delay_seconds": c.delay_seconds, "min_text_chars": c.min_text_chars, "min_quality_score": c.min_quality_score},
    }


COMMANDS = {
    "add-jsonl": ["path"], "add-exams": ["path"], "add-pages": ["path", "source"], "fetch": ["pages", "candidates"], "analyse": [], "curate": [], "export": ["path"], "book": ["path", "profiles"],
    "patterns": ["path"], "topics": [], "search": ["query"], "reselect": [], "health": [], "sources": [],
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="glossa")
    parser.add_argument("--config", help="a file laid over config/sources.yaml")
    sub = parser.add_subparsers(dest="command", required=True)
    commands = {name: sub.add_parser(name) for name in COMMANDS}
    for name, names in COMMANDS.items():
        for n in names:
            commands[name].add_argument(n)
    commands["analyse"].add_argument("--id", action="append")
    for name in ("analyse", "fetch"):
        commands[name].add_argument("--limit", type=int)
    commands["analyse"].add_argument("--only-missing", action="store_true")
    commands["curate"].add_argument("--least", type=float)
    commands["curate"].add_argument("--dry-run", action="store_true")
    commands["fetch"].add_argument("--source", default="all")
    commands["fetch"].add_argument("--query", default="")
    commands["book"].add_argument("--seed")
    args = parser.parse_args(argv)
    conf = settings.load_default(args.config)
    spark = SparkSession.builder.appName("glossa").getOrCreate()
    corpus = Corpus(spark, conf.database.path)
    read = lambda path: spark.read.parquet(path) if not path.endswith((".json", ".jsonl")) else spark.read.json(path)
    if args.command == "add-jsonl":
        print(corpus.add_jsonl(args.path))
    elif args.command == "add-exams":
        print(corpus.add_exams(args.path))
    elif args.command == "add-pages":
        print(corpus.add_pages(read(args.path), source=args.source, least_chars=conf.crawler.min_text_chars))
    elif args.command == "fetch":
        for name, n in corpus.fetch(conf, read(args.pages), read(args.candidates), source=args.source, limit=args.limit, topic_query=args.query).items():
            print(f"{name}: {n}")
    elif args.command == "analyse":
        corpus.analyse(args.id, only_missing=args.only_missing, limit=args.limit)
    elif args.command == "curate":
        for row in corpus.curate(conf.crawler.min_quality_score if args.least is None else args.least, dry_run=args.dry_run).toLocalIterator():
            print(row["doc_id"])
    elif args.command == "export":
        corpus.export(args.path)
    elif args.command == "book":
        print("\n".join(corpus.write_book(args.path, settings.read(args.profiles), seed=args.seed)))
    elif args.command == "patterns":
        export.write_files(corpus.pattern_guide().withColumn("name", F.lit("patterns.md")), args.path)
    elif args.command == "topics":
        print("\n".join(corpus.topics()))
    elif args.command == "reselect":
        print(corpus.reselect())
    elif args.command == "health":
        print(corpus.health())
    elif args.command == "sources":
        print(crawler_options(conf))
    else:
        corpus.search(args.query).show(truncate=60)
