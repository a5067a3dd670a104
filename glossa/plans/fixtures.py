"""A few English articles of our own and small lexicons, as the generated documents hold almost no English words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .fragments import quoted

ARTICLES = [
    (1, "Court and case", "review", "law", "The court held that the criminal case was weak. However, critics argue that the policy may change. The judge found that the appeal was late. It was the ruling that mattered. Dr. Lee disagreed, although she was subject to pressure."),
    (2, "Markets", "wire", "economics", "Because the market fell, profit margins were at stake. The merger led to a takeover, which was costly. Not only did the firm issue bonds but also shares. The tariff may result in inflation. Investors claim that capital is scarce, and capital is not so much scarce as shy."),
    (3, "Climate study", "review", "science", "A study found that carbon emissions rise. Researchers address the issue with novel methods. If the sample is small, the evidence is weak. The data show a statistically significant effect. For example, the climate study was robust evidence of change."),
    (4, "Problems.", "blog", "unknown", "He saw the problems. She saw more than he did. Subscribe to our newsletter today! All rights reserved."),
    (5, "Football quiz", "blog", "sport", "The match was long. The quiz was short, but people liked it. What matters is the score."),
    (6, "Market and climate", "review", "economics", "The market study was late. The market study was costly. The market study may lead to policy. The climate policy is at issue. The climate policy is old."),
    (7, "School", "wire", "education", "The school of thought is old. Students argue that learning is hard. While teachers agree, the college may account for costs. Having failed before, the student, who was tired, left."),
    (8, "Empty", "blog", "unknown", ""),
    (9, "U.S. law", "kaoyan_exam", "law", "The U.S. court ruled. Mr. Hall said that the statute holds, e.g. in most states. The legal case against the firm was at issue. Rarely does the court reverse a precedent."),
    (10, "Again", "wire", "law", "The court held that the criminal case was weak. Therefore the appeal failed. The more it waited, the more it lost."),
]

#: test lexicons of words that the generated documents hold
DOMAINS = {"first": ["tion", "ment", "thon", "thnt"], "second": ["thhe", "thth", "thre", "eren"], "third": ["orre", "rewh", "thha", "thor"]}
TIERS = [("tion", "high_school"), ("thon", "high_school"), ("ment", "core"), ("thth", "core"), ("thhe", "key"), ("thre", "key"), ("rein", "key"), ("thnt", "gre"), ("er", "gre"), ("be", "core"), ("stat", "core"), ("stated", "gre")]





def articles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARTICLES, "doc_id long, title string, source string, field string, text string")


ARTICLES_SQL = "articles AS (SELECT * FROM (VALUES " + ", ".join(f"({a[0]}::BIGINT, {', '.join(quoted(x) for x in a[1:])})" for a in ARTICLES) + ") AS v(doc_id, title, source, field, text))"


CORPUS_SQL = ARTICLES_SQL.replace("articles AS", "fx AS", 1) + ", articles AS (SELECT doc_id, '' AS title, source, lang AS field, coalesce(text, '') AS text FROM main.documents UNION ALL SELECT -doc_id, title, source, field, text FROM fx)"


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, "word string, tier string")


TIERS_SQL = "tiers AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(w)}, {quoted(t)})" for w, t in TIERS) + ") AS v(word, tier))"
