"""Admission and classification of entries for review material. Word lists are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

#: fixed values
COMMON_WORDS = ["can", "people", "thing", "make", "good", "big", "small"]
KNOWN_SHORT = ["gdp", "ai", "ceo", "r&d", "rd", "it", "pr", "pc", "diy", "dna", "rna", "cpu", "covid"]
LIMITS = {"politics_law": 320, "economics_business": 240, "research_methods": 240, "technology_ai": 220, "health_biomedicine": 220, "environment": 180, "society_education_psychology": 280, "media_culture": 160, "general_academic": 120}
ALIASES = L.DOMAIN_ALIASES


def number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def form_in(word: Column, example: Column) -> Column:
    """The word's form as the example writes it; '' if it has none."""
    return F.coalesce(F.regexp_substr(F.coalesce(example, F.lit("")), T.inflected(word)), F.lit(""))


def proper_noun(word: Column, example: Column, names: Sequence[str] = ()) -> Column:
    """In the list of names, or written with a capital (but not all in capitals) away from the sentence's start."""
    form = form_in(word, example)
    first = F.substring(form, 1, 1)
    inside = F.position(form, F.coalesce(example, F.lit(""))) > 1
    return word.isin(list(names)) | ((form != "") & (first != F.lower(first)) & (form != F.upper(form)) & inside)


def abbreviation(word: Column, example: Column) -> Column:
    form = form_in(word, example)
    capitals = (F.length(form) >= 2) & (form == F.upper(form)) & (form != F.lower(form))
    return ~word.isin(KNOWN_SHORT) & (capitals | F.contains(word, F.lit(".")) | ((F.length(word) <= 3) & ~word.rlike("[aeiouy]")))


def exportable_word(*, known: Sequence[str] = (), names: Sequence[str] = (), domain_words: Sequence[str] = (), zipf: str | None = None) -> Column:
    """Over columns word, category, example_sentence, importance, article_count (and a Zipf score, null if unknown)."""
    word = F.lower(F.btrim(F.coalesce("word", F.lit(""))))
    out = (
        F.when(F.contains(F.lower(F.coalesce("category", F.lit(""))), F.lit("polysemy")), True)
        .when((word == "") | word.isin(COMMON_WORDS) | word.isin(list(known)), False)
        .when(proper_noun(word, F.col("example_sentence"), names) | abbreviation(word, F.col("example_sentence")), False)
    )
    if zipf:
        score = F.coalesce(F.col(zipf), F.lit(0.0))
        out = out.when(~word.isin(list(domain_words)) & (score > 0) & (score < 2.5), False).when(score >= 5.5, False)
    return out.otherwise((number("importance") >= 4) | (number("article_count") >= 2))


def exportable_expression(*, banned: Sequence[str] = L.LOW_VALUE_EXPRESSIONS, allowed: Sequence[str] = L.ALLOWED_EXPRESSIONS, least: str | None = None, common: str | None = None) -> Column:
    """Over columns expression, type, meaning, frequency, article_count.

    With Zipf scores: least is the smallest score among the words, common the number of words at 5.5 or more.
    """
    plain = F.lower(F.btrim(F.coalesce("expression", F.lit(""))))
    n_words, freq, arts = F.size(T.words_by_space(plain)), number("frequency"), number("article_count")
    out = F.when(plain.isin(list(banned)), False).when(plain.isin(list(allowed)), True).when(plain.rlike("[0-9]"), False)
    if least and common:
        two = ((freq >= 8) & (arts >= 2) & (F.col(least) < 5.2)) | ((freq >= 12) & (arts >= 4) & (F.col(common) < n_words))
        out = out.when((n_words >= 2) & (F.col("type") == "2-gram"), two).when((n_words >= 2) & (F.col("type") == "3-gram"), (freq >= 4) & (arts >= 2) & (F.col(least) < 5.2))
    out = out.when(F.coalesce("meaning", F.lit("")) != "", ~F.col("type").isin("2-gram", "3-gram") & (freq >= 2))
    return out.when(F.col("type") == "2-gram", (freq >= 8) & (arts >= 2) & (F.length("expression") >= 10)).when(F.col("type") == "3-gram", (freq >= 4) & (arts >= 2)).otherwise(freq >= 3)


def admitted_phrase(word: Column, *, valued: Sequence[str] = L.HIGH_VALUE_PHRASES, least: str | None = None) -> Column:
    n = F.size(F.regexp_extract_all(word, F.lit("[a-z]+"), F.lit(0)))
    out = F.when(word.isin(list(valued)), True).when((n > 5) | (n == 0), False)
    if least:
        out = out.when(F.col(least) <= 2.6, False)
    return out.otherwise((number("importance") >= 5) | ((number("frequency") >= 3) & (number("article_count") >= 2)))


def admitted(*, low: Sequence[str] = L.LOW_VALUE_WORDS, noise: Sequence[str] = L.NOISE_WORDS, terms: Sequence[str] = L.HIGH_VALUE_TERMS, phrases: Sequence[str] = L.HIGH_VALUE_PHRASES, zipf: str | None = None, least: str | None = None, domain: str = "domain") -> Column:
    """Whether an entry (word, category, frequency, article_count, importance, domain) is good enough for review.

    zipf: the word's Zipf score; least: the smallest score among the words of a phrase (both null if unknown).
    """
    word, kind = F.lower(F.btrim(F.coalesce("word", F.lit("")))), F.lower(F.coalesce("category", F.lit("")))
    freq, arts, imp = number("frequency"), number("article_count"), number("importance")
    score = F.coalesce(F.col(zipf), F.lit(4.0)) if zipf else F.lit(4.0)
    has = lambda x: F.contains(kind, F.lit(x))
    bad = (word == "") | word.isin([*low, *noise]) | word.rlike(r"https?://|www\.|[^a-z0-9 '&-]") | ((F.length(word) <= 2) & (word != "ai")) | (F.length(word) > 48)
    if noise:
        bad = bad | F.arrays_overlap(T.words_by_space(word), F.array(*[F.lit(x) for x in noise]))
    return (
        F.when(bad, False)
        .when(has("polysemy"), True)
        .when(word.isin([*phrases, *terms]), (freq >= 1) | (imp >= 4))
        .when(F.contains(word, F.lit(" ")), admitted_phrase(word, valued=phrases, least=least))
        .when((score <= 2.8) | ((score >= 5.45) & ~word.isin(list(terms))), False)
        .when(F.col(domain) == "general_academic", ((arts >= 4) & (freq >= 6)) | (imp >= 5))
        .when(has("llm"), (imp >= 5) & (word.isin(list(terms)) | (arts >= 2) | (score >= 3.2)))
        .when(has("term"), (imp >= 4) | (arts >= 2))
        .when(has("academic"), (arts >= 2) & (freq >= 3) & (imp >= 4))
        .otherwise((imp >= 5) & (arts >= 2))
    )


def appendix_worthy(*, low: Sequence[str] = L.LOW_VALUE_WORDS, noise: Sequence[str] = L.NOISE_WORDS, terms: Sequence[str] = L.HIGH_VALUE_TERMS, phrases: Sequence[str] = L.HIGH_VALUE_PHRASES, zipf: str | None = None, least: str | None = None) -> Column:
    word = F.lower(F.btrim(F.coalesce("word", F.lit(""))))
    score = F.coalesce(F.col(zipf), F.lit(4.0)) if zipf else F.lit(4.0)
    return (
        F.when((word == "") | word.isin([*low, *noise]), False)
        .when(F.contains(word, F.lit(" ")), admitted_phrase(word, valued=phrases, least=least))
        .when(word.rlike("[^a-z0-9'-]") | (score <= 2.8) | (score >= 5.55), False)
        .otherwise(word.isin(list(terms)) | (number("importance") >= 5) | (number("article_count") >= 3) | (number("frequency") >= 8))
    )


def domain_of(field: Column, word: Column, gloss: Column, *, aliases: dict[str, str] = L.DOMAIN_ALIASES, keywords: dict[str, Sequence[str]] = L.DOMAINS, votes: dict[str, Sequence[str]] = L.GLOSS_VOTES, general: str = "general_academic") -> Column:
    """A field's domain by its name; else by the word among the domains' keywords; else by the gloss; else the general one."""
    named = T.mapped(F.lower(F.btrim(F.coalesce(field, F.lit("")))), aliases, F.lit(None).cast("string"))
    plain, said = F.lower(F.btrim(F.coalesce(word, F.lit("")))), F.lower(F.coalesce(gloss, F.lit("")))
    by_word = F.lit(None).cast("string")
    for name, words in reversed(list(keywords.items())):
        by_word = F.when(plain.isin(list(words)), aliases.get(name, general)).otherwise(by_word)
    counts = [F.struct((-sum((F.contains(said, F.lit(k)).cast("int") for k in keys), F.lit(0))).alias("n"), F.lit(i).alias("i"), F.lit(d).alias("domain")) for i, (d, keys) in enumerate(votes.items())]
    by_gloss = F.get(F.filter(F.slice(F.array_sort(F.array(*counts)), 1, 1), lambda c: c["n"] < 0), F.lit(0))["domain"]
    return F.when(named.isNotNull(), named).when(plain == "", general).otherwise(F.coalesce(by_word, by_gloss, F.lit(general)))


def category_class(category: Column) -> Column:
    """sense, phrase, term, academic or core."""
    return T.mapped(F.lower(F.btrim(F.coalesce(category, F.lit("")))), L.CATEGORY_CLASSES, F.lit("core"))


def category_priority(category: Column) -> Column:
    c = F.lower(F.coalesce(category, F.lit("")))
    return F.when(c == "polysemy", 5).when(c.rlike("phrase|idiom"), 4).when(c.rlike("term|institutional|legal|political"), 3).when(c.rlike("academic"), 2).otherwise(1)


def classify(entries: DataFrame, profiles: dict[str, Sequence[str]], aliases: dict[str, str] = ALIASES, *, politics: str = "politics_law", research: str = "research_methods", general: str = "general_academic") -> DataFrame:
    """entries with domain, score and confidence by keyword profiles: hits in the word weigh more than in its context."""
    word, kind = F.lower(F.btrim(F.coalesce("word", F.lit("")))), F.lower(F.coalesce("category", F.lit("")))
    blob = F.lower(F.concat_ws(" ", F.nullif(word, F.lit("")), F.nullif("example_sentence", F.lit("")), F.nullif("sources", F.lit("")), F.nullif(kind, F.lit(""))))
    home = T.mapped(F.lower(F.btrim(F.coalesce("field", F.lit("")))), aliases, F.lit(None).cast("string"))
    names = list(dict.fromkeys([*profiles, politics, research, *aliases.values()]))
    scored, touched = {}, {}
    for d in names:
        score, hit = F.when(home == d, 2.0).otherwise(0.0), F.coalesce(home == d, F.lit(False))
        for k in profiles.get(d, ()):
            in_word, near = F.contains(word, F.lit(k)), F.contains(blob, F.lit(k))
            score = score + F.when(in_word, 4.0 if " " in k else 3.0).when(near, 1.0).otherwise(0.0)
            hit = hit | in_word | near
        for mark, by, where in ((kind.rlike("legal|political"), 2.5, politics), (kind.rlike("academic"), 1.2, research)):
            if d == where:
                score, hit = score + F.when(mark, by).otherwise(0.0), hit | mark
        extra = F.when(hit & (F.contains(kind, F.lit("domain terminology")) | (kind == "term")), 0.8).otherwise(0.0)
        scored[d], touched[d] = score + extra, hit
    # ties go to the domain scored first: the field's own, then the order of the profiles
    rows = F.filter(F.array(*[F.when(touched[d], F.struct((-scored[d]).alias("low"), F.when(home == d, -1).otherwise(i).alias("ord"), F.lit(d).alias("name"))) for i, d in enumerate(names)]), lambda r: r.isNotNull())
    ranked = entries.withColumn("__r", F.array_sort(rows))
    second = F.coalesce(-F.get("__r", F.lit(1))["low"], F.lit(0.0))
    some = F.size("__r") > 0
    first = F.when(some, F.get("__r", F.lit(0))["name"])
    best = F.when(some, -F.get("__r", F.lit(0))["low"]).otherwise(0.0)
    sure = F.when(some, T.rounded((best - second) / F.greatest(best, F.lit(1.0)), 3)).otherwise(0.0)
    fallback = domain_of(F.col("field"), word, F.col("gloss") if "gloss" in entries.columns else F.lit(""), aliases=aliases, general=general)
    domain = F.when(~some, fallback).when((best < 2.5) | (sure < 0.18), general).otherwise(first)
    # by a generator of one row: filters on the outcome are not pushed below it, which would repeat these expressions
    found = F.struct(domain.alias("domain"), T.rounded(best, 2).alias("score"), sure.alias("confidence"))
    return ranked.select(*entries.columns, F.inline(F.array(found)))


def payload_words(payloads: DataFrame, tiers: DataFrame, docs: DataFrame) -> DataFrame:
    """Admitted vocabulary of model payloads (doc_id, payload): easy words need a special sense, rare ones a sense or domain."""
    from .analyze import match_tiers, sense_words

    schema = "array<struct<lemma:string,category:string,meaning_in_context:string,source_sentence:string>>"
    rows = payloads.select("doc_id", F.posexplode(F.from_json(F.get_json_object("payload", "$.vocabulary"), schema)).alias("ord", "v")).select("doc_id", "ord", "v.*")
    rows = rows.withColumn("word", F.lower(F.btrim("lemma"))).where(F.coalesce("word", F.lit("")) != "")
    rows = rows.join(match_tiers(rows.select("word").distinct(), tiers).select("word", "tier"), "word").join(sense_words(docs), ["doc_id", "word"], "left")
    kind = F.lower(F.coalesce("category", F.lit("")))
    fit = ~((F.col("tier") == "high_school") & ~(F.contains(kind, F.lit("polysemy")) & F.coalesce("special", F.lit(False)))) & ~((F.col("tier") == "rare") & ~kind.rlike("polysemy|domain"))
    return rows.where(fit).select("doc_id", "ord", "word", "category", "tier", F.greatest(T.mapped(F.col("tier"), {t: str(i) for t, i in L.TIERS.items()}, F.lit("1")).cast("int"), F.lit(1)).alias("importance"), F.col("source_sentence").alias("example_sentence"))
