"""Review material: glosses, corpus examples, domains, and chapters in Markdown.

All of it is columns and joins; a chapter is one row. Titles and labels are parameters: ``LABELS`` has English ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from . import review
from .aggregate import Order, sorting
from .analyze import top_per_group

ENTRY = "domain string, ord int, headword string, kind string, pos string, importance int, chinese string, english string, common string, exam string, risk string, collocations array<string>, contrast array<struct<term:string,note:string>>, examples array<struct<sentence:string,zh:string>>"
PATTERN = "ord int, pattern string, function string, chinese string, example string, importance int"
#: domains that every book has, in order: key, title, overview
DOMAINS = [
    ("research_methods", "Research methods and argument", "Words of reports and empirical studies that present evidence, findings and chains of causes."),
    ("technology_ai", "Technology, internet and AI", "Core expressions of texts on AI, platforms, data governance, security and copyright."),
    ("health_biomedicine", "Medicine, health and life science", "Frequent words of reports on public health, medical research, mental health and life science."),
    ("media_culture", "Media, culture and digital copyright", "Common expressions of articles on reading, publishing, media, memory and copyright."),
    ("general_academic", "General academic core", "Words that recur across fields and help to follow an argument."),
]
#: an older key of a domain, and the domain that takes its entries
OLD_DOMAIN, NEW_DOMAIN = "science_academic", "research_methods"
CLASSES = {"sense": "special sense", "phrase": "phrase", "term": "domain term", "academic": "academic word", "core": "core word"}
LABELS = {
    "quick": "Quick list", "guide": "How to use", "contents": "Contents", "templates": "Sentence templates", "corpus": "Patterns of the corpus",
    "appendix": "Frequent words to be checked", "expressions": "Further expressions", "plan": "Seven-day plan",
    "entry": ["Entry", "Class", "Part of speech", "Importance", "Core sense"], "risky": ["Entry", "Domain", "Core sense", "Risk"],
    "checked": ["Entry", "Suggested domain", "Class", "Frequency", "Articles", "Kept for"], "found": ["Expression", "Type", "Meaning", "Frequency", "Example"],
    "day": ["Day", "Task"], "local": "local corpus", "none": "No data.",
}
GUIDE = [
    "Learn the special senses and the fixed pairs of a chapter first, then its domain terms.",
    "Keep the sense in exams and the risk in mind, not only the translation.",
    "Examples are the book's own or short excerpts of the corpus.",
]
PLAN = [
    ("Day 1", "Politics and law: issue, hold, find, case, challenge; at issue / take issue with."),
    ("Day 2", "Business and finance: acquisition, merger, takeover, capital, yield, regulation."),
    ("Day 3", "Science and technology: suggest, indicate, significant, robust, account for, underlie."),
    ("Day 4", "Environment and climate: emissions, mitigation, adaptation, resilience, biodiversity."),
    ("Day 5", "Education, society, psychology: school, position, concern, subject, discipline, bias, drive, move."),
    ("Day 6", "Templates: while/whereas, rather than, not so much A as B; read all examples again."),
    ("Day 7", "Cover the senses and say them from the examples; list what is still misread."),
]


# ---- domains


def normalised_domains(domains: DataFrame, entries: DataFrame, additions: Sequence[tuple[str, str, str]] = DOMAINS) -> tuple[DataFrame, DataFrame]:
    """A seed's domains (key, ord, title, overview) and entries (domain, ...) with all standing domains, the old key replaced.

    An old domain's entries and overview go to the new one, which stands after the seed's own domains.
    """
    spark = domains.sparkSession
    wanted = spark.createDataFrame([(k, 100_000 + i, t, o) for i, (k, t, o) in enumerate(additions)], "key string, ord int, title string, overview string")
    own = domains.where(F.col("key") != OLD_DOMAIN).select("key", F.col("ord").cast("int").alias("ord"), "title", "overview")
    old = domains.where(F.col("key") == OLD_DOMAIN).select(F.lit(NEW_DOMAIN).alias("key"), F.nullif("overview", F.lit("")).alias("said"))
    wanted = wanted.join(own.select("key"), "key", "left_anti").join(old, "key", "left").select("key", "ord", "title", F.coalesce("said", "overview").alias("overview"))
    return own.unionByName(wanted), entries.withColumn("domain", F.when(F.col("domain") == OLD_DOMAIN, NEW_DOMAIN).otherwise(F.col("domain")))


# ---- glosses and examples


def short(text: Column, limit: int) -> Column:
    """White space squeezed; longer texts are cut, with three dots within the limit."""
    clean = T.squeezed(text)
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.substring(clean, 1, limit - 3), F.lit("...")))


def truncated(text: Column, limit: int) -> Column:
    """Line breaks as blanks, trimmed; longer texts are cut, with three dots within the limit."""
    clean = T.stripped(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.substring(clean, 1, limit - 3), F.lit("...")))


GLOSS = "array<struct<lemma:string,meaning_in_context:string,common_meaning:string,why_chinese_students_misunderstand_it:string>>"


def gloss_index(vocabulary: DataFrame, payloads: DataFrame) -> DataFrame:
    """(word, zh, common, exam, en_short, en_long) of aggregated words and of payloads' vocabulary.

    vocabulary: word, and where known contextual_meaning, common_meaning, english_gloss. payloads: ord (articles' order),
    payload. Words come first; each value is the first that isn't empty; English is that of a payload's first entry.
    """
    text = lambda c: F.coalesce(F.btrim(F.col(c)), F.lit("")) if c in vocabulary.columns else F.lit("")
    meaning, common, english = text("contextual_meaning"), text("common_meaning"), text("english_gloss")
    own = vocabulary.select(
        F.lower(F.btrim(F.coalesce("word", F.lit("")))).alias("word"), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).alias("b")).alias("ord"),
        F.when(meaning != "", meaning).otherwise(common).alias("zh"), common.alias("common"), meaning.alias("exam"), english.alias("en_short"), english.alias("en_long"),
    )
    rows = payloads.select(F.col("ord").cast("long").alias("a"), F.posexplode(F.from_json(F.get_json_object("payload", "$.vocabulary"), GLOSS)).alias("b", "v"))
    part = lambda c: F.btrim(F.coalesce(F.col(f"v.{c}"), F.lit("")))
    lemma, zh, plain, exam = F.lower(part("lemma")), part("meaning_in_context"), part("common_meaning"), part("why_chinese_students_misunderstand_it")
    pick = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    given = rows.select(lemma.alias("word"), F.struct((F.col("a") + 1).alias("a"), "b").alias("ord"), zh.alias("zh"), plain.alias("common"), exam.alias("exam"), short(pick(zh, plain, lemma), 80).alias("en_short"), short(pick(plain, zh, lemma), 120).alias("en_long"))
    both = own.unionByName(given).where("word <> ''")
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.struct("ord", F.col(c)))), F.lit("")).alias(c)
    return both.groupBy("word").agg(*[first(c) for c in ("zh", "common", "exam", "en_short", "en_long")])


def with_details(entries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """entries with phonetic, zh and en: their own values, else the dictionary's (word, phonetic, zh, en)."""
    own = lambda *names: [F.nullif(F.col(n), F.lit("")) for n in names if n in entries.columns]
    word = F.lower(F.btrim(F.coalesce(*own("headword", "word"), F.lit(""))))
    book = dictionary.select(F.col("word").alias("__word"), *[F.nullif(F.col(c), F.lit("")).alias(f"__{c}") for c in ("phonetic", "zh", "en")])
    joined = entries.withColumn("__key", word).join(book, F.col("__key") == F.col("__word"), "left")
    filled = {"phonetic": own("phonetic"), "zh": own("exam", "chinese", "gloss"), "en": own("english", "english_gloss")}
    return joined.withColumns({c: F.coalesce(*values, F.col(f"__{c}"), F.lit("")) for c, values in filled.items()}).drop("__key", "__word", "__phonetic", "__zh", "__en")


def corpus_hits(headwords: DataFrame, vocabulary: DataFrame, expressions: DataFrame, *, k: int | None = None) -> DataFrame:
    """Examples of the corpus for each headword: aggregated words first, then expressions; rank 1 is the one to show.

    All of them, or the first k of each headword; k = 1 is an aggregate without a ranking.

    headwords: headword. vocabulary: word, field, category, frequency, article_count, sources, citation, example_sentence;
    expressions: expression, type, frequency, article_count, sources, example_sentence.
    """
    known = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    shape = lambda df, name, kind, group: df.select(F.lower(name).alias("key"), F.lit(kind).alias("kind"), F.col(group).alias("group"), known(df, "field").alias("field"), "frequency", "article_count", "sources", known(df, "citation").alias("citation"), "example_sentence")
    rows = shape(vocabulary, "word", 0, "category").unionByName(shape(expressions, "expression", 1, "type"))
    rows = rows.where(F.coalesce("example_sentence", F.lit("")) != "")
    asked = headwords.select("headword").distinct().withColumn("key", F.lower("headword"))
    hits = asked.join(rows, "key").drop("key")
    if k == 1:
        place = F.struct("kind", F.col("field").isNotNull().alias("some"), "field", (-F.col("frequency")).alias("n"), "group")
        others = [c for c in hits.columns if c != "headword"]
        return hits.groupBy("headword").agg(F.min_by(F.struct(*others), place).alias("h")).select("headword", "h.*", F.lit(1).alias("rank"))
    order = [F.asc("kind"), F.asc_nulls_first("field"), F.desc("frequency"), F.asc("group")]
    return top_per_group(hits, ["headword"], order, k) if k else hits.withColumn("rank", F.row_number().over(W.partitionBy("headword").orderBy(*order)))


def hit_source(rows: DataFrame, *, local: str = LABELS["local"]) -> Column:
    """Where an example comes from: its citation, else its sources, else its field and counts."""
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    count = lambda c, f: F.when(F.col(c) > 0, F.format_string(f, F.col(c).cast("long"))) if c in rows.columns else F.lit(None).cast("string")
    counts = F.concat_ws(", ", F.concat(F.lit("field "), text("field")), count("article_count", "%d articles"), count("frequency", "frequency %d"))
    return F.coalesce(text("citation"), text("sources"), F.nullif(counts, F.lit("")), F.lit(local))


def marked(sentence: Column, word: Column, forms: dict[str, Sequence[str]] = L.MARKED_FORMS) -> Column:
    """The sentence with the word's forms between double asterisks; phrases as they are, words with regular endings too."""
    plain = F.lower(F.btrim(F.coalesce(word, F.lit(""))))
    escaped = lambda w: F.regexp_replace(w, r"([^A-Za-z0-9 ])", r"\\$1")
    one = lambda w: F.concat(F.lit(r"\b"), escaped(w), F.when(F.contains(w, F.lit(" ")), r"\b").otherwise(r"(?:s|es|ed|ing|d|r|er)?\b"))
    more = F.array(*[F.lit(x) for x in []]).cast("array<string>")
    for w, extra in forms.items():
        more = F.when(plain == w, F.array(*[F.lit(x) for x in extra])).otherwise(more)
    every = F.reverse(F.array_sort(F.transform(F.concat(F.array(plain), more), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    pattern = F.concat(F.lit("(?iU)("), F.array_join(F.transform(every, lambda s: one(s["w"])), "|"), F.lit(")"))
    return F.when((plain == "") | sentence.isNull(), sentence).otherwise(F.regexp_replace(sentence, pattern, F.lit("**$1**")))


# ---- selections


def without_seed(rejected: DataFrame, seeds: DataFrame, *, word: str = "word") -> DataFrame:
    """Rejected entries whose word is no headword of the seed book."""
    known = seeds.select(F.lower(F.btrim("headword")).alias("__word")).distinct()
    plain = F.lower(F.btrim(F.coalesce(F.col(word), F.lit(""))))
    return rejected.where(plain != "").join(known, plain == F.col("__word"), "left_anti")


def appendix_words(rejected: DataFrame, seeds: DataFrame, *, limit: int = 120, zipf: str | None = None, least: str | None = None) -> DataFrame:
    """The best rejected entries (word, category, score, frequency, article_count, importance) that are still worth a look."""
    fit = without_seed(rejected, seeds).where(review.appendix_worthy(zipf=zipf, least=least))
    return ranked_entries(fit).limit(limit)


def entry_order(word: Column, category: Column, *, score: str = "score") -> Order:
    """Entries by score, value, category, articles and frequency."""
    valued = word.isin([*L.HIGH_VALUE_TERMS, *L.HIGH_VALUE_PHRASES]).cast("int")
    return [(F.col(score), True), (valued, True), (review.category_priority(category), True), (F.col("article_count"), True), (F.col("frequency"), True), (F.col("word"), False)]


def ranked_entries(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*sorting(entry_order(F.lower(F.btrim("word")), F.col("category"))))


def expression_candidates(aggregated: DataFrame, *, limit: int = 80, **rules) -> DataFrame:
    """The exportable expressions to show, those with a meaning first, then by articles and frequency."""
    fit = aggregated.where(review.exportable_expression(**rules))
    meaning = (F.coalesce("meaning", F.lit("")) != "").cast("int")
    return fit.orderBy(F.desc(meaning), F.desc("article_count"), F.desc("frequency"), "expression", "type").limit(limit)


# ---- Markdown


def table_head(names: Sequence[str]) -> str:
    return f"| {' | '.join(names)} |\n| {' | '.join('---' for _ in names)} |"


def table_line(*cells: Column) -> Column:
    clean = [F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *clean), F.lit(" |"))


def joined(column: str, *order: str, sep: str = "\n") -> Column:
    """The group's texts in order, as one."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(column).alias("__text")))), lambda r: r["__text"]), sep)


def entry_markdown(rows: DataFrame, *, classes: dict[str, str] = CLASSES) -> Column:
    """One entry's section. rows: word, phonetic, zh, en, category, pos, importance, frequency, article_count, common, risk,
    collocations, contrast, examples, example_sentence, source, seed (whether it is the seed book's)."""
    text = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    some = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)) if c in rows.columns else F.array().cast(kind)
    quoted = lambda value: F.concat(F.lit("`"), value, F.lit("`"))
    when = lambda label, value: F.concat(F.lit(label), value)
    count = lambda c, label: F.when(~F.col("seed") & (F.col(c) > 0), F.concat(F.lit(label), F.col(c).cast("string")))
    kind = T.mapped(review.category_class(F.col("category")), classes, F.lit("core word"))
    attributes = F.concat_ws(" · ", quoted(text("pos")), quoted(kind), when("importance ", F.nullif(T.stars(F.col("importance")), F.lit(""))), count("frequency", "frequency "), count("article_count", "articles "))
    contrast, examples = some("contrast", "array<struct<term:string,note:string>>"), some("examples", "array<struct<sentence:string,zh:string>>")
    apart = F.when(F.size(contrast) > 0, F.concat(F.lit("* Told apart:\n"), F.array_join(F.transform(contrast, lambda c: F.concat(F.lit("    * `"), c["term"], F.lit("`: "), c["note"])), "\n")))
    shown = F.transform(examples, lambda e: F.concat(F.lit("    > "), marked(e["sentence"], F.col("word")), F.when(F.coalesce(e["zh"], F.lit("")) != "", F.concat(F.lit("\n    > *"), e["zh"], F.lit("*"))).otherwise("")))
    given = F.when(F.size(examples) > 0, F.concat(F.lit("* Examples:\n"), F.array_join(shown, "\n")))
    corpus = F.when(text("example_sentence").isNotNull(), F.concat(F.lit("* From the corpus:\n    > "), truncated(marked(F.col("example_sentence"), F.col("word")), 220), F.lit("\n    > *"), F.coalesce(text("source"), F.lit(LABELS["local"])), F.lit("*")))
    pairs = some("collocations", "array<string>")
    head = F.concat(F.lit("### "), F.col("word"), F.coalesce(F.concat(F.lit(" `["), text("phonetic"), F.lit("]`")), F.lit("")))
    lines = F.concat_ws("\n", when("* ", F.nullif(attributes, F.lit(""))), F.concat(F.lit("* **"), F.coalesce(text("zh"), F.lit("")), F.lit("**")), when("* Usual sense: ", text("common")), when("* English: ", quoted(text("en"))), when("* Risk: ", text("risk")), F.when(F.size(pairs) > 0, F.concat(F.lit("* Collocations: "), F.array_join(F.transform(pairs, quoted), " | "))), apart, given, corpus)
    return F.concat(head, F.lit("\n\n"), lines, F.lit("\n\n---\n"))


def chapters(entries: DataFrame, domains: DataFrame, *, labels: dict = LABELS) -> DataFrame:
    """(key, ord, title, body): each domain's table and entries. Entries are those within the caps and the seed's: bounded.

    entries: what entry_markdown takes, and domain, ord. Seed entries come before others of the same rank.
    """
    rows = entries.withColumns({"line": table_line(F.col("word"), T.mapped(review.category_class(F.col("category")), CLASSES, F.lit("core word")), F.coalesce("pos", F.lit("")), T.stars(F.col("importance")), truncated(F.col("zh"), 40)), "section": entry_markdown(entries)})
    rows = rows.withColumns({"p1": -review.category_priority(F.col("category")), "p2": -F.coalesce("importance", F.lit(0)), "p3": -F.coalesce(F.col("frequency").cast("long"), F.lit(0).cast("long")), "p4": (~F.col("seed")).cast("int")})
    order = ("p1", "p2", "p3", "p4", "ord", "word")
    bodies = rows.groupBy("domain").agg(joined("line", *order).alias("lines"), joined("section", *order).alias("sections"))
    out = domains.join(bodies, F.col("key") == F.col("domain"), "left")
    body = F.concat_ws("\n", F.concat(F.lit("## "), "title"), F.lit(""), F.coalesce("overview", F.lit("")), F.lit(""), F.lit(table_head(labels["entry"])), "lines", F.lit(""), "sections")
    return out.select("key", "ord", "title", body.alias("body"))


def quick_list(entries: DataFrame, domains: DataFrame, *, labels: dict = LABELS) -> DataFrame:
    """(ord, domain, word, line): the seed's entries of importance 5 with their core sense and risk."""
    rows = entries.where(F.col("importance") >= 5).join(domains.select(F.col("key").alias("domain"), "title", F.col("ord").alias("place")), "domain")
    return rows.select("place", "ord", "domain", F.col("headword").alias("word"), table_line(F.col("headword"), F.col("title"), F.col("chinese"), F.col("risk")).alias("line"))


def lines_of(*parts: Column | str) -> Column:
    """Texts under each other; nulls are empty lines."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def pattern_guide(seeds: DataFrame, chosen: DataFrame, *, labels: dict = LABELS, names: dict[str, str] | None = None) -> DataFrame:
    """(body), one row: the guide to sentence patterns. seeds: as ``PATTERN``; chosen: of aggregate.diversified.

    The seed's templates, then the chosen patterns of the corpus by type, the types by priority.
    """
    names = names or {c: label for c, label, *_ in L.PATTERNS}
    priority = T.mapped(F.col("type"), {c: str(p) for c, _, p, _ in L.PATTERNS}, F.lit("1")).cast("int")
    dashed = lambda v: F.concat(F.lit("- "), v)
    own = lines_of(F.concat(F.lit("### "), "pattern"), "", dashed(F.col("function")), dashed(F.col("chinese")), dashed(T.stars(F.col("importance"))), "", F.concat(F.lit("> "), "example"), "")
    first = seeds.select("ord", own.alias("text")).groupBy().agg(joined("text", "ord").alias("templates"))
    counts = F.format_string("- %d times in %d articles", F.coalesce("frequency", F.lit(0)).cast("long"), F.coalesce("article_count", F.lit(0)).cast("long"))
    value = F.when(F.coalesce("importance", F.lit(0)) == 0, F.lit(3)).otherwise(F.col("importance"))
    said = F.concat_ws("\n", dashed(T.stars(value)), F.concat(F.lit("- "), F.nullif("example_source", F.lit(""))))
    text = lines_of(F.concat(F.lit("#### "), "pattern"), "", counts, said, "", F.concat(F.lit("> "), short(F.col("example_sentence"), 240)), "")
    by_type = chosen.select("type", "place", text.alias("text")).groupBy("type").agg(joined("text", "place").alias("text"), F.min("place").alias("place"))
    kinds = by_type.select((-priority).alias("p"), "place", lines_of(F.concat(F.lit("### "), T.mapped(F.col("type"), names, F.lit("Other structure"))), "", F.col("text")).alias("text"))
    second = kinds.groupBy().agg(joined("text", "p", "place").alias("corpus"))
    parts = [F.lit(f"## {labels['templates']}"), F.lit(""), F.nullif("templates", F.lit("")), F.when(F.col("corpus") != "", F.lit(f"## {labels['corpus']}\n")), F.nullif("corpus", F.lit(""))]
    return first.join(F.broadcast(second)).select(F.concat_ws("\n", *parts).alias("body"))


def appendix(words: DataFrame, expressions: DataFrame, *, labels: dict = LABELS) -> DataFrame:
    """(body), one row: the appendix from appendix_words (with domain) and expression_candidates, in their order."""
    reason = F.coalesce(F.nullif(F.array_join("reasons", "; "), F.lit("")), F.lit("high_frequency")) if "reasons" in words.columns else F.lit("high_frequency")
    kind = T.mapped(review.category_class(F.col("category")), CLASSES, F.lit("core word"))
    keyed = words.withColumns({"__place": F.row_number().over(W.orderBy(*sorting(entry_order(F.lower(F.btrim("word")), F.col("category"))))), "__line": table_line(F.col("word"), F.col("domain"), kind, F.col("frequency"), F.col("article_count"), reason)})
    meaning = (F.coalesce("meaning", F.lit("")) != "").cast("int")
    other = expressions.withColumns({"__place": F.row_number().over(W.orderBy(F.desc(meaning), F.desc("article_count"), F.desc("frequency"), "expression", "type")), "__line": table_line(F.col("expression"), F.col("type"), F.col("meaning"), F.col("frequency"), short(F.col("example_sentence"), 110))})
    one = lambda rows, name: rows.groupBy().agg(F.nullif(joined("__line", "__place"), F.lit("")).alias(name))
    part = lambda title, head, name: lines_of(f"## {title}", "", F.coalesce(F.concat(F.lit(table_head(head) + "\n"), name), F.lit(labels["none"])), "")
    both = one(keyed, "words").join(F.broadcast(one(other, "expressions")))
    return both.select(lines_of(part(labels["appendix"], labels["checked"], "words"), part(labels["expressions"], labels["found"], "expressions")).alias("body"))


def plan(days: Sequence[tuple[str, str]] = PLAN, *, labels: dict = LABELS) -> str:
    return "\n".join([f"## {labels['plan']}", "", table_head(labels["day"]), *[f"| {a} | {b} |" for a, b in days], ""])


def contents(pages: DataFrame, quick: DataFrame) -> DataFrame:
    """(links, anchors, quick), one row: the pages' titles as links to files and to headings, and the quick list's lines."""
    number = F.row_number().over(W.orderBy("place")).cast("string")  # a row a page
    entry = lambda target: F.concat(number, F.lit(". ["), "title", F.lit("]("), target, F.lit(")"))
    listed = pages.select("place", entry(F.concat(F.lit("./"), "name")).alias("link"), entry(F.concat(F.lit("#"), T.anchor(F.col("title")))).alias("anchor"))
    toc = listed.groupBy().agg(joined("link", "place").alias("links"), joined("anchor", "place").alias("anchors"))
    return toc.join(F.broadcast(quick.groupBy().agg(F.nullif(joined("line", "place", "ord"), F.lit("")).alias("quick"))))


def book_files(pages: DataFrame, quick: DataFrame, about: dict, *, labels: dict = LABELS) -> DataFrame:
    """(name, body): the pages (place, name, title, body) as a file each, and an index with the quick list and links."""
    title = about.get("title", "Review book")
    each = pages.select("name", lines_of(F.concat(F.lit(f"# {title}"), F.when(F.col("chapter"), F.concat(F.lit(" - "), "title")).otherwise("")), "", F.col("body"), "").alias("body"))
    table = F.coalesce(F.concat(F.lit(table_head(labels["risky"]) + "\n"), "quick"), F.lit(labels["none"]))
    body = lines_of(f"# {title}", "", about.get("subtitle", ""), "", f"## {labels['quick']}", "", table, "", f"## {labels['contents']}", "", F.col("links"), "", "")
    return each.unionByName(contents(pages, quick).select(F.lit("index.md").alias("name"), body.alias("body")))


def whole_book(pages: DataFrame, quick: DataFrame, about: dict, *, name: str = "book.md", labels: dict = LABELS, guide: Sequence[str] = GUIDE) -> DataFrame:
    """(name, body), one row: the book as a single document, with how to use it, the quick list, links to its chapters, and all pages."""
    title = about.get("title", "Review book")
    table = F.coalesce(F.concat(F.lit(table_head(labels["risky"]) + "\n"), "quick"), F.lit(labels["none"]))
    head = [f"# {title}", "", about.get("subtitle", ""), "", f"## {labels['guide']}", "", *[f"- {g}" for g in guide], "", f"## {labels['quick']}", "", table, "", f"## {labels['contents']}", "", F.col("anchors"), "", "---", ""]
    body = pages.groupBy().agg(joined("body", "place").alias("pages"))
    return contents(pages.where("chapter"), quick).join(F.broadcast(body)).select(F.lit(name).alias("name"), lines_of(*head, F.col("pages")).alias("body"))


def book_pages(chapter_rows: DataFrame, domains: DataFrame, late: dict[str, DataFrame], *, labels: dict = LABELS) -> DataFrame:
    """(place, name, title, body, chapter): the chapters in the domains' order, then the pages of late (title: body of one row)."""
    spark = domains.sparkSession
    named = lambda c: F.concat(T.slug(c), F.lit(".md"))
    out = chapter_rows.select(F.col("ord").cast("int").alias("place"), named(F.col("title")).alias("name"), "title", "body", F.lit(True).alias("chapter"))
    for i, (title, body) in enumerate(late.items()):
        if isinstance(body, str):
            body = spark.createDataFrame([(body,)], "body string")
        out = out.unionByName(body.select(F.lit(1_000_000 + i).alias("place"), named(F.lit(title)).alias("name"), F.lit(title).alias("title"), "body", F.lit(False).alias("chapter")))
    return out
