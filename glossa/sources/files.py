"""Readers: articles from JSON lines, exam papers from JSON lines, CSV or text, word lists, feeds and pages."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

ARTICLE = "id string, title string, source string, url string, published_at string, field string, text string, created_at string, metadata map<string,string>"
EXAM = "id string, exam_id string, year string, section string, question_no string, title string, field string, url string, original_source string, citation string, text string, passage string"
WORD = r"[a-z]+(?:[-'][a-z]+)*"


def given(*names: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt to all cores if a scan has fewer tasks than these, as with one small file; larger scans stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def placed(rows: DataFrame) -> DataFrame:
    """rows of a file scan with path, block (where the scan's split of the file begins) and the row's place in its task."""
    return rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """placed rows with their number in the file, from 1. Only one row a split is ordered, the rows themselves don't move."""
    splits = rows.groupBy("path", "block").agg(F.count("*").alias("__n"), F.min("place").alias("__first"))
    before = F.sum("__n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select("path", "block", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    out = rows.join(splits, ["path", "block"]).withColumn(name, F.col("__before") + F.col("place") - F.col("__first") + 1)
    return out.drop("__before", "__first")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): non-blank lines with their numbers in the file. Files are read in splits, line by line."""
    lines = numbered(placed(spark.read.text(path)), "line")
    value = F.when(F.col("line") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return lines.select("path", "line", "block", "place", value.alias("value")).where(F.btrim("value") != "")


def jsonl_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles; a line without text is an error that names it."""
    return line_articles(numbered_lines(spark, path))


def line_articles(lines: DataFrame) -> DataFrame:
    """Articles of numbered JSON lines (line, value)."""
    rows = lines.select("line", F.from_json("value", ARTICLE, {"mode": "FAILFAST"}).alias("r"))
    text = F.when(F.col("r.text").isNull(), F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" has no text")))).otherwise(T.squeezed(F.col("r.text")))
    title = F.coalesce(F.col("r.title"), F.concat(F.lit("Untitled "), F.col("line").cast("string")))
    source = F.coalesce(F.col("r.source"), F.lit("jsonl"))
    return rows.select(
        F.coalesce(F.nullif(F.col("r.id"), F.lit("")), T.stable_id(source, title, text)).alias("id"), title.alias("title"), source.alias("source"), F.coalesce(F.col("r.url"), F.lit("")).alias("url"),
        F.coalesce(F.col("r.published_at"), F.lit("")).alias("published_at"), F.coalesce(F.col("r.field"), F.lit("unknown")).alias("field"), text.alias("text"), F.coalesce(F.to_json("r.metadata"), F.lit("{}")).alias("metadata_json"),
    )


def exam_articles(rows: DataFrame) -> DataFrame:
    """Exam rows (with their number n, from 1) as articles; empty values count as missing."""
    for f in ("id", "exam_id", "year", "section", "question_no", "title", "field", "url", "original_source", "citation", "text", "passage"):
        if f not in rows.columns:
            rows = rows.withColumn(f, F.lit(None).cast("string"))
    year, section = F.coalesce(given("year"), F.lit("")), F.coalesce(given("section"), F.lit(""))
    made = F.concat_ws("-", F.lit("kaoyan"), F.coalesce(given("year"), F.lit("unknown")), F.coalesce(given("section"), F.lit("reading")), F.col("n").cast("string"))
    id_ = F.coalesce(given("id", "exam_id"), made)
    meta = F.to_json(F.struct(F.lit("kaoyan_exam").alias("corpus_type"), year.alias("year"), section.alias("section"), F.coalesce(given("question_no"), F.lit("")).alias("question_no"), F.coalesce(given("original_source"), F.lit("")).alias("original_source"), F.coalesce(given("citation"), F.lit("")).alias("citation")))
    return rows.select(id_.alias("id"), F.coalesce(given("title"), id_).alias("title"), F.lit("kaoyan_exam").alias("source"), F.coalesce(given("url"), F.lit("")).alias("url"), year.alias("published_at"), F.coalesce(given("field"), F.lit("unknown")).alias("field"), T.squeezed(given("text", "passage")).alias("text"), meta.alias("metadata_json"))


def exam_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rows are numbered in their file, blank lines left out."""
    bare = F.regexp_replace("value", "^\ufeff", "")
    lines = numbered(placed(spark.read.text(path).where(F.btrim(bare) != "")), "n")
    rows = lines.select("n", F.from_json(bare, EXAM).alias("r"))
    return exam_articles(rows.select("n", "r.*"))


def exam_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows are numbered in their file; quoted fields may hold line breaks, so that a file is one split."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c: c.lstrip("\ufeff").strip() for c in rows.columns}
    return exam_articles(numbered(placed(rows), "n").withColumnsRenamed(names))


def exam_txt(spark: SparkSession, path: str) -> DataFrame:
    """Blocks between lines of three or more dashes or ## headings."""
    return text_exams(spark.read.text(path, wholetext=True))


def text_exams(texts: DataFrame) -> DataFrame:
    """Exam articles of whole texts (value)."""
    parts = F.filter(F.transform(F.split("value", r"(?m)^\s*-{3,}\s*$|^##+.*$", -1), T.squeezed), lambda p: p != "")
    return exam_articles(texts.select(F.posexplode(parts).alias("n", "text")).withColumn("n", F.col("n") + 1))


def exams(spark: SparkSession, path: str) -> DataFrame:
    return exam_jsonl(spark, path) if path.endswith(".jsonl") else exam_csv(spark, path) if path.endswith(".csv") else exam_txt(spark, path)


def plain_words(lines: DataFrame) -> DataFrame:
    """One word a line; other lines are left out. lines: value."""
    word = F.lower(F.btrim(F.regexp_replace("value", "^\ufeff", "")))
    return lines.select(word.alias("word")).where(F.col("word").rlike(f"^{WORD}$")).distinct()


def paired_words(lines: DataFrame) -> DataFrame:
    """All words of lines that a line beginning with [ follows. lines: path, line, value."""
    after = F.lead(F.btrim("value")).over(W.partitionBy("path").orderBy("line"))
    heads = lines.withColumn("after", after).where(F.startswith("after", F.lit("[")) & F.btrim("value").rlike("^[A-Za-z]"))
    return heads.select(F.explode(F.regexp_extract_all(F.lower("value"), F.lit(WORD), F.lit(0))).alias("word")).distinct()


def excluded_words(lines: DataFrame) -> DataFrame:
    """The same list read for exclusion: lines in brackets or with Chinese characters are left out."""
    rows = lines.where(~F.startswith(F.btrim("value"), F.lit("[")) & ~F.col("value").rlike(r"\p{IsHan}"))
    return rows.select(F.explode(F.regexp_extract_all(F.lower("value"), F.lit(WORD), F.lit(0))).alias("word")).distinct()


def feed_entries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Items of saved RSS feeds: title, url, published; the first entry of a url counts."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, updated string").load(path)
    url = T.article_url(F.col("link"), F.col("link"))
    rows = rows.select("title", url.alias("url"), F.coalesce("pubDate", "updated", F.lit("")).alias("published_at"), F.monotonically_increasing_id().alias("ord")).where("url <> ''")
    out = first_by(rows, ["url"], ["ord"]).orderBy("ord").drop("ord")
    return out.limit(limit) if limit else out


def first_by(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; one aggregate, no window."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *[f"r.{c}" for c in rest])


def page_articles(pages: DataFrame) -> DataFrame:
    """Title, text, and what the page says of itself: site_name, author, date, description ('' if it doesn't)."""
    html = F.coalesce("html", F.lit(""))
    meta = lambda *names: T.html_meta(html, names)
    about = [meta("og:site_name").alias("site_name"), meta("author", "article:author").alias("author"), meta("article:published_time", "date").alias("date"), meta("description", "og:description").alias("description")]
    return pages.select("page_id", "url", T.html_title(F.col("html")).alias("title"), T.html_text(F.col("html")).alias("text"), *about)


def page_links(pages: DataFrame, *, hosts: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Links of archive pages that belong to a source; the first place of a link counts."""
    links = pages.select("page_id", "url", F.posexplode(T.anchors(F.col("html"))).alias("pos", "href"))
    links = links.withColumn("link", T.article_url(F.col("url"), F.col("href"))).where("link <> ''")
    links = links.where(T.belongs_to_source(F.col("link"), hosts, include, exclude))
    return first_by(links.select("link", "page_id", "pos"), ["link"], ["page_id", "pos"])


def targets(parts: Sequence[DataFrame], limit: int) -> DataFrame:
    """Candidates of several sources of decreasing priority (url, ord): distinct urls, the first source counts."""
    out = None
    for i, part in enumerate(parts):
        part = part.select("url", F.lit(i).alias("priority"), F.col("ord").cast("long").alias("ord"))
        out = part if out is None else out.unionByName(part)
    return first_by(out, ["url"], ["priority", "ord"]).orderBy("priority", "ord", "url").limit(limit)


def discovery_urls(source, crawler) -> list[str]:
    """A source's archive and search pages within the crawler's budget, as settings (config.Source, config.Crawler) say.

    Searches keep a third of the budget for themselves, as far as they need it. Placeholders: {page}, {query},
    {query_plus} (encoded for a url), {query_quote} (encoded, in quotation marks).
    """
    budget, pages = crawler.max_discovery_pages_per_source, crawler.max_search_pages_per_query
    capacity = len(source.search_url_templates) * len(source.topic_queries) * max(1, pages)
    plain = budget - (min(budget // 3, capacity) if capacity else 0)
    each = max(1, plain // max(len(source.archive_url_templates), 1))
    archives = source.archive_urls + [t.format(page=p) for t in source.archive_url_templates for p in range(1, each + 1)]
    searches = [t.format(page=p, query=q, query_plus=quote_plus(q), query_quote=quote_plus(f'"{q}"')) for t in source.search_url_templates for q in source.topic_queries for p in range(1, pages + 1)]
    first = archives[:plain]
    return first + searches[: max(0, budget - len(first))]


def query_encoded(text: Column) -> Column:
    """As in the query part of a url: blanks as plus signs."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def discovery_rows(sources: DataFrame, crawler) -> DataFrame:
    """(source, place, url): what discovery_urls gives, for many sources (source, archive_urls, archive_url_templates,
    search_url_templates, topic_queries: arrays) at once."""
    budget, pages = F.lit(crawler.max_discovery_pages_per_source), F.lit(max(0, crawler.max_search_pages_per_query))
    capacity = F.size("search_url_templates") * F.size("topic_queries") * F.greatest(pages, F.lit(1))
    plain = budget - F.least(F.floor(budget / 3), capacity)
    each = F.greatest(F.lit(1), F.floor(plain / F.greatest(F.size("archive_url_templates"), F.lit(1)))).cast("int")
    numbers = lambda n: F.filter(F.sequence(F.lit(0), n), lambda p: p > 0)
    paged = lambda t, p: F.replace(t, F.lit("{page}"), p.cast("string"))
    archives = F.concat("archive_urls", F.flatten(F.transform("archive_url_templates", lambda t: F.transform(numbers(each), lambda p: paged(t, p)))))

    def asked(template: Column, words: Column, page: Column) -> Column:
        out = paged(template, page)
        for name, value in (("{query_plus}", query_encoded(words)), ("{query_quote}", query_encoded(F.concat(F.lit('"'), words, F.lit('"')))), ("{query}", words)):
            out = F.replace(out, F.lit(name), value)
        return out

    searches = F.flatten(F.flatten(F.transform("search_url_templates", lambda t: F.transform("topic_queries", lambda q: F.transform(numbers(pages), lambda p: asked(t, q, p))))))
    first = F.slice(archives, F.lit(1), plain.cast("int"))
    urls = F.concat(first, F.slice(searches, F.lit(1), F.greatest(budget - F.size(first), F.lit(0)).cast("int")))
    return sources.select("source", F.posexplode(urls).alias("place", "url"))


def accepted(candidates: DataFrame, known: DataFrame, *, least_chars: int, least_score: float, target: int, multiplier: int = 8) -> DataFrame:
    """New articles (url, source, ord, text, quality_score, quality_keep) that pass the gates, up to target a source.

    Only a source's first target * multiplier candidates are looked at. A column min_quality_score, where it has a value, is
    the source's own least score.
    """
    target = max(1, target)
    looked = top_by(candidates, ["source"], [F.asc("ord"), F.asc("url")], target * max(1, multiplier), "place")
    fresh = looked.join(known.select("url").distinct(), "url", "left_anti")
    least = F.coalesce(F.col("min_quality_score"), F.lit(least_score)) if "min_quality_score" in candidates.columns else F.lit(least_score)
    good = fresh.where((F.length("text") >= least_chars) & F.col("quality_keep") & (F.col("quality_score") >= least))
    return top_by(good, ["source"], [F.asc("ord"), F.asc("url")], target, "rank").drop("place")


def top_by(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str) -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def seed_book(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame, list[dict]]:
    """A review book's seed in YAML: metadata, domains (key, ord, title, overview), entries, and sentence patterns.

    A seed is written by hand and small; Spark's file system reads it, so that it may lie anywhere.
    """
    import yaml

    from ..operators.material import ENTRY

    text = spark.read.text(path, wholetext=True).first()[0]
    seed = yaml.safe_load(text) or {}
    domains, entries = [], []
    for i, (key, d) in enumerate((seed.get("domains") or {}).items()):
        domains.append((key, i, d.get("title", key), d.get("overview", "")))
        for j, e in enumerate(d.get("entries") or []):
            texts = [e.get(c) for c in ("headword", "kind", "pos")] + [e.get("importance")] + [e.get(c) for c in ("chinese", "english", "common", "exam", "risk")]
            entries.append((key, j, *texts, e.get("collocations"), [(c.get("term"), c.get("note")) for c in e.get("contrast") or []], [(x.get("sentence"), x.get("zh")) for x in e.get("examples") or []]))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return seed.get("metadata") or {}, frame(domains, "key string, ord int, title string, overview string"), frame(entries, ENTRY), list(seed.get("sentence_patterns") or [])


def paper_articles(papers: DataFrame) -> DataFrame:
    """Printed papers (slug, url, pdf_url, text) as one article a reading passage, with ids and citations.

    Texts of fewer than 1,000 characters are an error: pages that were scanned, not printed.
    """
    text = F.when(F.length(T.stripped(F.coalesce("text", F.lit("")))) < 1000, F.raise_error(F.concat(F.lit("no text in paper "), F.col("slug")))).otherwise(T.exam_text(F.col("text")))
    rows = papers.select("slug", "url", "pdf_url", text.alias("text")).select("slug", "url", "pdf_url", F.posexplode(T.passages(F.col("text"))).alias("n", "text")).withColumn("n", (F.col("n") + 1).cast("string"))
    year = F.substring("slug", 1, 4)
    cited = F.concat(F.lit("pastpapers.cn "), "slug", F.lit(" Reading Text "), "n", F.lit(": "), "url")
    meta = F.to_json(F.struct(F.lit("kaoyan_exam").alias("corpus_type"), year.alias("year"), F.col("slug").alias("paper_slug"), F.concat(F.lit("reading-text-"), "n").alias("section"), cited.alias("citation"), "pdf_url"))
    return rows.select(F.concat(F.lit("pastpapers-"), "slug", F.lit("-text-"), "n").alias("id"), F.concat("slug", F.lit(" reading, text "), "n").alias("title"), F.lit("pastpapers.cn").alias("source"), "url", year.alias("published_at"), F.lit("unknown").alias("field"), "text", meta.alias("metadata_json"))


def import_summary(articles: DataFrame) -> DataFrame:
    """How many articles, of which years and papers (both sorted)."""
    slug = F.coalesce(F.get_json_object("metadata_json", "$.paper_slug"), F.lit(""))
    return articles.agg(F.count("*").alias("articles"), F.sort_array(F.collect_set(F.nullif("published_at", F.lit("")))).alias("years"), F.sort_array(F.collect_set(slug)).alias("papers"))


def pdf_link(html: Column) -> Column:
    """The address of a paper's file in its page; null without one."""
    return F.nullif(F.replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"""/uploads/[^"'<> ]+?\.pdf""", 0), F.lit("\\"), F.lit("")), F.lit(""))
