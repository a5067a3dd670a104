"""Rows from model payloads (JSON text): vocabulary, expressions, patterns, digests. Broken payloads give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

VOCABULARY = "array<struct<lemma:string,category:string,classification:string,type:string,domain:string,field:string,topic:string,subdomain:string,meaning_in_context:string,common_meaning:string,source_sentence:string,estimated_level:string,exam_importance:string>>"
RHETORIC = "array<struct<original_sentence:string,canonical_type:string,type:string,explanation_zh:string,explanation:string,reading_tip_zh:string,template:string>>"


def first_of(*columns: Column | str) -> Column:
    """The first value that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns], F.lit(""))


def importance(value: Column) -> Column:
    v = F.lower(F.coalesce(value, F.lit("")))
    return F.when(v.isin("high", "postgraduate"), 5).when(v.isin("medium", "cet-6", "c1"), 4).when(v != "", 3).otherwise(0)


def frequency(value: Column) -> Column:
    v = F.lower(F.coalesce(value, F.lit("")))
    return F.when(v == "high", 5).when(v.isin("medium", "cet-6"), 3).when(v == "low", 1).when(v == "postgraduate", 4).otherwise(2)


def category(value: Column) -> Column:
    v = F.lower(value)
    return F.when(v.rlike("polysemy"), "polysemy").when(v.rlike("idiom|expression"), "phrase").when(v.rlike("legal|political"), "domain terminology").otherwise("academic/general")


#: fixed values: words that tell a field, in order of precedence
FIELD_HINTS = [
    ("law", ["law", "political"]),
    ("economics", ["econom", "market"]),
    ("environment", ["environment"]),
    ("education", ["education"]),
    ("psychology", ["psych"]),
    ("sociology", ["soc"]),
    ("health", ["health", "medical", "clinical", "patient", "disease"]),
    ("technology", ["technology", "digital", "algorithm", "ai", "data", "platform"]),
    ("science", ["science", "research", "postgraduate"]),
]


def field(text: Column) -> Column:
    low, out = F.lower(text), None
    for name, hints in FIELD_HINTS:
        hit = low.rlike("|".join(hints))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def vocabulary(payloads: DataFrame) -> DataFrame:
    """(doc_id, ord, lemma, category, field, frequency, importance, meaning, example_sentence) of (doc_id, payload)."""
    rows = payloads.select("doc_id", F.posexplode(F.from_json(F.get_json_object("payload", "$.vocabulary"), VOCABULARY)).alias("ord", "v")).select("doc_id", "ord", "v.*")
    lemma = F.lower(F.btrim(F.coalesce("lemma", F.lit(""))))
    about = F.concat_ws(" ", first_of("domain", "field", "topic", "subdomain"), F.coalesce("estimated_level", F.lit("")), F.coalesce("exam_importance", F.lit("")), lemma, first_of("meaning_in_context", "common_meaning"))
    kind = first_of("category", "classification", "type", "exam_importance")
    return rows.select("doc_id", "ord", lemma.alias("lemma"), category(kind).alias("category"), field(about).alias("field"), frequency(F.col("exam_importance")).alias("frequency"), importance(F.col("exam_importance")).alias("importance"), F.coalesce("meaning_in_context", F.lit("")).alias("meaning"), F.coalesce("source_sentence", F.lit("")).alias("example_sentence")).where("lemma <> ''")


def expressions(payloads: DataFrame) -> DataFrame:
    """Entries of several words and some importance, as expressions."""
    rows = vocabulary(payloads).where(F.contains("lemma", F.lit(" ")) & (F.col("importance") >= 3))
    return rows.select("doc_id", "ord", F.col("lemma").alias("expression"), F.lit("llm vocabulary phrase").alias("type"), "frequency", "importance", "meaning", F.col("meaning").alias("example_sentence"))


def patterns(payloads: DataFrame) -> DataFrame:
    """Sentences that have an explanation, with the canonical type and template."""
    rows = payloads.select("doc_id", F.posexplode(F.from_json(F.get_json_object("payload", "$.rhetoric"), RHETORIC)).alias("ord", "v")).select("doc_id", "ord", "v.*")
    rows = rows.withColumns({"sentence": F.btrim(F.coalesce("original_sentence", F.lit(""))), "function": F.btrim(first_of("explanation_zh", "explanation", "reading_tip_zh")), "raw": first_of("canonical_type", "type", F.lit("llm rhetorical pattern"))})
    rows = rows.where("sentence <> '' AND function <> ''").withColumns({"code": T.pattern_type(F.col("raw"), F.col("function")), "plain": F.lower(T.squeezed(F.col("sentence")))})
    return rows.select("doc_id", "ord", F.col("code").alias("type"), "function", "sentence", T.pattern_template(F.col("plain"), F.col("code"), F.coalesce("template", F.lit(""))).alias("pattern"), F.lit(4).alias("importance"))


def merged(base: DataFrame, extra: DataFrame, key: list[str]) -> DataFrame:
    """Base rows, and the payload's rows of keys that base lacks."""
    return base.unionByName(extra.join(base.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def first_of_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, *[f"r.{c}" for c in rest])


def digest(payloads: DataFrame) -> DataFrame:
    """Whether a payload is valid, its rhetoric types in order (the first three joined), its domain and model."""
    rhetoric = F.coalesce(F.from_json(F.get_json_object("payload", "$.rhetoric"), RHETORIC), F.array().cast(RHETORIC))
    types = F.array_distinct(F.filter(F.transform(rhetoric, lambda r: F.btrim(F.coalesce(F.nullif(r["canonical_type"], F.lit("")), r["type"], F.lit("")))), lambda t: t != ""))
    empty = F.coalesce(F.btrim("payload"), F.lit("")).isin("", "{}")
    status = F.when(empty, "local").when(T.complete_analysis(F.col("payload")), "valid").otherwise("invalid")
    return payloads.select("doc_id", status.alias("status"), F.array_join(F.slice(types, 1, 3), " → ").alias("structure"), F.coalesce(F.nullif(F.get_json_object("payload", "$.exam_value.primary_domain"), F.lit("")), F.lit("unknown")).alias("domain"), F.coalesce(F.get_json_object("payload", "$._meta.model"), F.lit("")).alias("model"), F.size(rhetoric).alias("rhetoric_count"))


def shown_vocabulary(tiered: DataFrame) -> DataFrame:
    """What a reader sees: no easy or rare words, unless they have a special sense or (rare ones) are domain terms."""
    easy = F.col("tier").isin("high_school", "rare")
    return tiered.where(~easy | (F.col("category") == "polysemy") | ((F.col("tier") == "rare") & (F.col("category") == "domain terminology")))
