"""Exports: cards, table lines and reports as rows; files are written by Spark, one folder a document kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..sources.sink import FileSink
from .material import table_head as head
from .material import table_line as line
from .material import truncated


def cards(rows: DataFrame) -> DataFrame:
    """Front, back and tags of every aggregated word, for a flash-card program."""
    front = F.concat("word", F.when(F.col("lemma") != F.col("word"), F.concat(F.lit(" ("), "lemma", F.lit(")"))).otherwise(""))
    back = F.concat(T.stars(F.col("importance")), F.lit(" "), F.coalesce("example_sentence", F.lit("")))
    tags = F.regexp_replace(F.concat_ws(" ", "field", "category"), "[/ ]+", "_")
    return rows.select(front.alias("front"), back.alias("back"), tags.alias("tags"))


def write_cards(rows: DataFrame, path: str) -> None:
    cards(rows).write.mode("overwrite").option("sep", "\t").csv(path)


def table_rows(rows: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """Lines of a Markdown table."""
    cells = [F.regexp_replace((F.col(c) if isinstance(c, str) else c).cast("string"), r"\|", r"\\|") for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


#: titles of a report's parts; another language is another dict
REPORT = {
    "about": "About", "facts": ["Source", "URL", "Date", "Field", "Difficulty", "Exam value"], "words": "Frequent words", "senses": "Special senses",
    "expressions": "Frequent expressions", "patterns": "Sentence patterns", "model": "Model analysis", "text": "Text", "none": "Nothing found.", "empty": "No data.",
    "word_columns": ["Word", "Category", "Frequency", "Importance", "Example"], "expression_columns": ["Expression", "Type", "Meaning", "Frequency", "Importance", "Example"],
    "sense": ["Usual sense", "Sense here", "Risk"], "pattern": ["Type", "Importance"],
}


def in_order(rows: DataFrame, text: Column, name: str, order: Sequence[Column], k: int | None = None, *, sep: str = "\n") -> DataFrame:
    """(doc_id, name): each article's lines, in order, as one text; the first k of them."""
    ranked = rows.select("doc_id", text.alias("__line"), F.row_number().over(W.partitionBy("doc_id").orderBy(*order)).alias("__rank"))
    if k is not None:
        ranked = ranked.where(F.col("__rank") <= k)
    return ranked.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__rank", "__line"))), lambda r: r["__line"]), sep).alias(name))


def reports(articles: DataFrame, analyses: DataFrame, vocabulary: DataFrame, collocations: DataFrame, senses: DataFrame, patterns: DataFrame, *, labels: dict = REPORT, k: int = 25) -> DataFrame:
    """(doc_id, name, body): a Markdown report of each article; name is that of its file.

    Its k most frequent words and expressions, special senses, patterns, the model's payload and the text. One aggregate
    for each child table.
    """
    cut, star = (lambda c: truncated(F.col(c), 120)), (lambda: T.stars(F.col("importance")))
    by_count = lambda name: [F.desc("frequency"), F.desc("importance"), F.asc(name)]
    words = in_order(vocabulary, line(F.col("word"), F.col("category"), F.col("frequency"), star(), cut("example_sentence")), "words", by_count("word"), k)
    found = in_order(collocations, line(F.col("expression"), F.col("type"), F.col("meaning"), F.col("frequency"), star(), cut("example_sentence")), "expressions", by_count("expression"), k)
    part = lambda title, facts, quote: F.concat(F.lit("### "), title, F.lit("\n\n"), F.concat_ws("\n", *[F.concat(F.lit(f"- {n}: "), F.coalesce(v.cast("string"), F.lit(""))) for n, v in facts]), F.lit("\n\n> "), quote, F.lit("\n"))
    sense = part(F.col("word"), list(zip(labels["sense"], [F.col("ordinary_meaning"), F.col("contextual_meaning"), F.col("exam_risk")], strict=True)), F.col("sentence"))
    special = in_order(senses, sense, "senses", [F.asc("word")])
    rule = part(F.col("function"), list(zip(labels["pattern"], [F.col("type"), star()], strict=True)), F.col("sentence"))
    shapes = in_order(patterns, rule, "patterns", [F.asc("ord")])
    said = analyses.select("doc_id", F.nullif("field", F.lit("")).alias("a_field"), "difficulty", "exam_value", "llm_json")
    rows = articles.join(said, "doc_id", "left")
    for child in (words, found, special, shapes):
        rows = rows.join(child, "doc_id", "left")
    dash = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-"))
    out_of = lambda c: F.concat(F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, "-").otherwise(F.col(c).cast("string")), F.lit(" / 10"))
    facts = [F.col("source"), dash("url"), dash("published_at"), F.coalesce("a_field", F.nullif("field", F.lit("")), F.lit("unknown")), out_of("difficulty"), out_of("exam_value")]
    table = "\n".join(["| | |", "|---|---|"])
    about = F.concat_ws("\n", F.lit(table), *[line(F.lit(n), v) for n, v in zip(labels["facts"], facts, strict=True)])
    listed = lambda c, names: F.when(F.col(c).isNull(), labels["empty"]).otherwise(F.concat(F.lit(head(names) + "\n"), F.col(c)))
    payload = F.when(~F.coalesce("llm_json", F.lit("{}")).isin("", "{}"), F.concat(F.lit(f"## {labels['model']}\n\n```json\n"), F.col("llm_json"), F.lit("\n```\n")))
    body = F.concat_ws(
        "\n", F.concat(F.lit("# "), "title"), F.lit(f"\n## {labels['about']}\n"), about, F.lit(f"\n## {labels['words']}\n"), listed("words", labels["word_columns"]),
        F.lit(f"\n## {labels['senses']}\n"), F.coalesce("senses", F.lit(labels["none"] + "\n")), F.lit(f"## {labels['expressions']}\n"), listed("expressions", labels["expression_columns"]),
        F.lit(f"\n## {labels['patterns']}\n"), F.coalesce("patterns", F.lit(labels["none"] + "\n")), payload, F.lit(f"## {labels['text']}\n"), F.coalesce("text", F.lit("")), F.lit(""),
    )
    return rows.select("doc_id", T.slug(F.concat(F.col("doc_id").cast("string"), F.lit("-"), "title")).alias("name"), body.alias("body"))


def field_reports(vocabulary: DataFrame, *, columns: Sequence[str] = ("Word", "Lemma", "Category", "Frequency", "Articles", "Importance", "Example")) -> DataFrame:
    """(field, name, body): the aggregated words of each field, the most frequent first."""
    text = line(F.col("word"), F.col("lemma"), F.col("category"), F.col("frequency"), F.col("article_count"), T.stars(F.col("importance")), truncated(F.col("example_sentence"), 120))
    rows = vocabulary.select("field", F.struct((-F.col("frequency")).alias("n"), "word", "lemma", "category", text.alias("line")).alias("r"))
    lines = rows.groupBy("field").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]), "\n").alias("lines"))
    return lines.select("field", T.slug(F.col("field")).alias("name"), F.concat(F.lit("# "), "field", F.lit("\n\n" + head(columns) + "\n"), "lines", F.lit("\n")).alias("body"))


def expression_lines(aggregated: DataFrame) -> DataFrame:
    """(ord, line) of the exportable expressions, in the corpus order."""
    cells = [F.col(c) for c in ("expression", "type", "meaning", "frequency", "article_count")]
    order = [F.desc("class"), F.desc("n_words"), F.desc("n_chars"), F.desc("frequency"), F.desc("importance"), F.asc("expression"), F.asc("type")]
    return aggregated.orderBy(*order).select(line(*cells, T.stars(F.col("importance")), truncated(F.col("example_sentence"), 140)).alias("line"))


def sense_lines(aggregated: DataFrame) -> DataFrame:
    cells = [F.col("word"), F.col("ordinary_meaning"), F.col("contextual_meaning"), F.col("article_count"), truncated(F.col("sentence"), 140), F.col("sources")]
    return aggregated.orderBy(F.desc("article_count"), "word").select(line(*cells).alias("line"))


def pattern_lines(aggregated: DataFrame) -> DataFrame:
    labels = {c: label for c, label, _, _ in L.PATTERNS}
    cells = [T.mapped(F.col("type"), labels, F.lit("Other structure")), F.col("pattern"), F.col("article_count"), F.col("frequency"), T.stars(F.col("importance")), truncated(F.col("example_sentence"), 160)]
    return aggregated.orderBy(F.desc("priority"), F.desc("article_count"), F.desc("frequency"), "type", "pattern").select(line(*cells).alias("line"))


def index_lines(articles: DataFrame, analyses: DataFrame) -> DataFrame:
    """A line an article: title, source, field, difficulty, exam value; in the order of import."""
    said = analyses.select("doc_id", F.nullif("field", F.lit("")).alias("a_field"), "difficulty", "exam_value")
    dash = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, "-").otherwise(F.col(c).cast("string"))
    rows = articles.join(said, "doc_id", "left").orderBy("created_at", "doc_id")
    return rows.select(line(F.col("title"), F.col("source"), F.coalesce("a_field", "field"), dash("difficulty"), dash("exam_value")).alias("line"))


def write_lines(rows: DataFrame, path: str, title: str, columns: Sequence[str], *facts: str) -> None:
    """A table's lines below path, in order, as text: the first part of the folder begins with the title and heading."""
    spark = rows.sparkSession
    first = "\n".join([f"# {title}", "", *facts, *([""] if facts else []), head(columns)])
    spark.createDataFrame([(first,)], "value string").unionAll(rows.select(F.col("line").alias("value"))).write.mode("overwrite").text(path)


def write_files(rows: DataFrame, path: str) -> None:
    """Each of rows (name, body) as a file of its own below path, written by the executors and moved into place at the end."""
    rows.sparkSession.dataSource.register(FileSink)
    rows.select("name", "body").write.format(FileSink.name()).mode("append").save(path)


def write_by(rows: DataFrame, path: str, column: str, body: str) -> None:
    """One folder of text files for each value of the column."""
    rows.select(column, F.col(body).alias("value")).repartition(column).write.mode("overwrite").partitionBy(column).text(path)
