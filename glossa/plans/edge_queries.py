"""Queries of readers, payloads, reading views and upkeep, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyze, payloads, review, serve, store
from ..sources import files, providers
from . import fragments as D
from . import table_queries as Q
from .registry import query, table

# ---- readers


@query(f"""WITH l AS (SELECT doc_id AS line, doc_id % 3 = 0 AS named, coalesce(source, '') AS source, {D.squeezed('text')} AS text FROM documents)
SELECT CASE WHEN named THEN 'id-' || line ELSE substr(sha1('jsonl' || chr(10) || 'Untitled ' || line || chr(10) || left(text, 500)), 1, 16) END AS id, CASE WHEN named THEN 'Title ' || source ELSE 'Untitled ' || line END AS title, CASE WHEN named THEN source ELSE 'jsonl' END AS source, '' AS url, 'unknown' AS field, text, CASE WHEN named THEN '{{"n":"' || line || '"}}' ELSE '{{}}' END AS metadata_json FROM l""")
def jsonl_import(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("line"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    named = F.to_json(F.struct(F.concat(F.lit("id-"), F.col("line").cast("string")).alias("id"), F.concat(F.lit("Title "), "source").alias("title"), "source", "text", F.create_map(F.lit("n"), F.col("line").cast("string")).alias("metadata")))
    lines = docs.select("line", F.when(F.col("line") % 3 == 0, named).otherwise(F.to_json(F.struct("text"))).alias("value"))
    return files.line_articles(lines).select("id", "title", "source", "url", "field", "text", "metadata_json")


@query(f"""WITH e AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN (2000 + item_id % 10)::VARCHAR ELSE '' END AS year, {D.squeezed('text')} AS text FROM benchmark)
SELECT CASE WHEN item_id % 4 = 0 THEN 'own-' || item_id ELSE 'kaoyan-' || CASE WHEN year = '' THEN 'unknown' ELSE year END || '-reading-' || item_id END AS id, year AS published_at, 'kaoyan_exam' AS source, text, year AS said FROM e""")
def exam_import(spark, d):
    n = F.col("item_id")
    rows = table(spark, d, "benchmark").select(n.cast("string").alias("n"), F.when(n % 4 == 0, F.concat(F.lit("own-"), n.cast("string"))).otherwise("").alias("exam_id"), F.when(n % 2 == 0, (2000 + n % 10).cast("string")).otherwise("").alias("year"), F.lit("").alias("text"), F.col("text").alias("passage"))
    return files.exam_articles(rows).select("id", "published_at", "source", "text", F.get_json_object("metadata_json", "$.year").alias("said"))


@query("SELECT n_name AS word, CASE WHEN n_nationkey % 2 = 0 THEN 'a' || n_nationkey WHEN n_nationkey % 3 = 0 THEN 'b' || n_nationkey END AS entry FROM nation")
def dictionary_lookup(spark, d):
    words = table(spark, d, "nation")
    first = words.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("word"), F.concat(F.lit("a"), F.col("n_nationkey").cast("string")).alias("entry"))
    second = words.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("word"), F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("entry"))
    return providers.dictionary_entries(words.select(F.col("n_name").alias("word")), [first, second])


# ---- payloads

# ---- reading and upkeep

@query(f"SELECT doc_id, greatest(1, round(len({D.words('text')}) / 180)::INT) AS minutes FROM documents")
def reading_minutes(spark, d):
    return table(spark, d, "documents").select("doc_id", serve.reading_minutes(F.col("text")).alias("minutes"))


@query("SELECT o_orderkey, o_orderpriority, 'none' AS note, o_orderkey % 7 AS place FROM orders")
def added_columns(spark, d):
    return store.with_columns(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), {"o_orderpriority": "'x'", "note": "'none'", "place": "o_orderkey % 7"})


# ---- Zipf scores: of the generated words by their length

ZIPF = "CASE WHEN len(word) < 4 THEN 6.0 WHEN len(word) < 8 THEN 4.0 WHEN len(word) < 12 THEN 2.0 ELSE 0.0 END"


def zipf(word):
    n = F.length(word)
    return F.when(n < 4, 6.0).when(n < 8, 4.0).when(n < 12, 2.0).otherwise(0.0)


@query(f"WITH {Q.MERGED} SELECT word FROM mv WHERE CASE WHEN contains(category, 'polysemy') THEN true WHEN word = '' OR list_contains({D.listing(review.COMMON_WORDS)}, word) THEN false WHEN contains(word, '.') OR (len(word) <= 3 AND NOT regexp_matches(word, '[aeiouy]')) THEN CASE WHEN list_contains({D.listing(review.KNOWN_SHORT)}, word) THEN importance >= 4 OR article_count >= 2 ELSE false END WHEN NOT list_contains(['thththth'], word) AND {ZIPF} > 0 AND {ZIPF} < 2.5 THEN false WHEN {ZIPF} >= 5.5 THEN false ELSE importance >= 4 OR article_count >= 2 END")
def export_filter_zipf(spark, d):
    rows = Q.merged(spark, d).withColumn("zipf", zipf(F.col("word")))
    return rows.where(review.exportable_word(zipf="zipf", domain_words=["thththth"])).select("word")


EZ = ZIPF.replace("len(word)", "len(x)")


@query(f"WITH {Q.GRAMS}, gz AS (SELECT *, list_min(list_transform(string_split(expression, ' '), lambda x: {EZ})) AS least, len(list_filter(string_split(expression, ' '), lambda x: {EZ} >= 5.5)) AS common FROM ge) SELECT expression, frequency, article_count FROM gz WHERE CASE WHEN type = '2-gram' THEN (frequency >= 8 AND article_count >= 2 AND least < 5.2) OR (frequency >= 12 AND article_count >= 4 AND common < 2) ELSE frequency >= 4 AND article_count >= 2 AND least < 5.2 END")
def export_expressions_zipf(spark, d):
    parts = F.split("expression", " ")
    rows = Q.expressions(spark, d).withColumns({"least": F.array_min(F.transform(parts, zipf)), "common": F.size(F.filter(parts, lambda w: zipf(w) >= 5.5))})
    return rows.where(review.exportable_expression(least="least", common="common")).select("expression", "frequency", "article_count")


@query("SELECT count(*) AS n FROM documents WHERE source IN ('kaoyan_exam', 'pastpapers.cn') OR doc_id % 50 = 0")
def exam_corpus(spark, d):
    rows = table(spark, d, "documents").withColumn("metadata_json", F.when(F.col("doc_id") % 50 == 0, '{"corpus_type": "kaoyan_exam"}').otherwise("{}"))
    return rows.where(analyze.exam_text_rows()).agg(F.count("*").alias("n"))

