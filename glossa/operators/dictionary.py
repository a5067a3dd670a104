"""Dictionary entries of many words at once: a keyed cache, tables in order, remote answers, a model; what nobody knows is kept too.

One pass over the words: each stage is a join, or a provider that is asked only for the words which the stages before left open.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import providers

FIELDS = ("phonetic", "zh", "en", "pos")
ENTRY = "struct<phonetic:string,zh:string,en:string,pos:string>"
CACHE = "word string, phonetic string, zh string, en string, pos string, not_found boolean, policy string"
POLICY = "phrase_llm_v1"

Source = DataFrame | Callable[[], Callable[[str], str]]


def word_key(word: Column) -> Column:
    return F.lower(T.stripped(F.coalesce(word, F.lit(""))))


def phrase_like(word: Column) -> Column:
    return word.rlike("[ '-]")


def asks_remote(word: Column) -> Column:
    return word.rlike("^[a-z]{3,24}$")


def asks_model(word: Column, *, enabled: bool = False) -> Column:
    """Phrases of two to six words; single words only if that is enabled."""
    return F.when(phrase_like(word), F.regexp_count(word, F.lit("[a-z]+")).between(2, 6)).otherwise(F.lit(enabled) & asks_remote(word))


def means_something(entry: Column) -> Column:
    return (F.coalesce(entry["zh"], F.lit("")) != "") | (F.coalesce(entry["en"], F.lit("")) != "")


def entry_of(rows: DataFrame) -> Column:
    """The fields of rows as one value; missing columns and nulls are empty."""
    return F.struct(*[(F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in FIELDS])


def from_table(open_words: DataFrame, table: DataFrame, asks: Column) -> DataFrame:
    """open_words with ``got``: the table's entry (word, and any of the fields) where one is asked for; of several the first by value."""
    entries = table.select(word_key(F.col("word")).alias("__word"), entry_of(table).alias("__entry")).where(means_something(F.col("__entry")))
    entries = entries.groupBy("__word").agg(F.min("__entry").alias("got"))
    return open_words.join(entries, asks & (F.col("word") == F.col("__word")), "left").drop("__word")


def from_provider(open_words: DataFrame, make: Callable[[], Callable[[str], str]], asks: Column) -> DataFrame:
    """open_words with ``got`` by a provider of JSON entries, one a task; it is asked only where ``asks`` holds."""
    schema = open_words.select("*", F.lit(None).cast("string").alias("__answer"), F.lit(True).alias("__asks")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()

        def ask(word: str) -> str | None:
            try:
                return provider(word)
            except LookupError:
                return None

        for batch in batches:
            yield batch.assign(__answer=[ask(w) if wanted else None for w, wanted in zip(batch["word"], batch["__asks"], strict=True)])

    marked = open_words.select("*", F.lit(None).cast("string").alias("__answer"), F.coalesce(asks, F.lit(False)).alias("__asks"))
    got = F.from_json("__answer", ENTRY)
    filled = F.struct(*[F.coalesce(got[c], F.lit("")).alias(c) for c in FIELDS])
    return marked.mapInPandas(run, schema).withColumn("got", F.when(F.col("__answer").isNotNull() & means_something(filled), filled)).drop("__answer", "__asks")


def looked_up(words: DataFrame, cache: DataFrame, tables: Sequence[DataFrame], *, remote: Source | None = None, model: Source | None = None, model_for_words: bool = False, policy: str = POLICY) -> DataFrame:
    """(word, the fields, origin) of the distinct keys of words (word): origin is cache, table 0 and so on, remote, model or none.

    cache: as ``CACHE``; an entry that says "not found" answers single words for good and phrases only under the same policy.
    remote is asked for single words of plain letters, model for phrases. Providers are factories of functions, one a task,
    or tables of answers. Empty words have no row; unknown ones have empty fields.
    """
    keys = words.select(word_key(F.col("word")).alias("word")).where("word <> ''").distinct()
    negative = F.coalesce("not_found", F.lit(False))
    known = cache.select(word_key(F.col("word")).alias("word"), F.struct(negative.cast("int").alias("no"), entry_of(cache).alias("entry"), "policy").alias("__c")).groupBy("word").agg(F.min("__c").alias("__c"))
    no = F.col("__c.no") == 1
    valid = F.col("__c").isNotNull() & (~no | ~phrase_like(F.col("word")) | F.coalesce(F.col("__c.policy") == policy, F.lit(False)))
    rows = keys.join(known, "word", "left").select("word", F.when(valid & ~no, F.col("__c.entry")).alias("entry"), F.when(valid, F.when(no, "nowhere").otherwise("cache")).alias("origin"))
    stages = [(f"table {i}", t, F.lit(True)) for i, t in enumerate(tables)] + [("remote", remote, asks_remote(F.col("word"))), ("model", model, asks_model(F.col("word"), enabled=model_for_words))]
    for name, source, fit in stages:
        if source is None:
            continue
        asks = F.col("origin").isNull() & fit
        rows = from_table(rows, source, asks) if isinstance(source, DataFrame) else from_provider(rows, source, asks)
        rows = rows.select("word", F.coalesce("entry", "got").alias("entry"), F.coalesce("origin", F.when(F.col("got").isNotNull(), name)).alias("origin"))
    return rows.select("word", *[F.coalesce(F.col(f"entry.{c}"), F.lit("")).alias(c) for c in FIELDS], F.coalesce("origin", F.lit("none")).alias("origin"))


def cache_rows(found: DataFrame, *, policy: str = POLICY) -> DataFrame:
    """What looked_up has newly learned, as rows of the cache."""
    unknown = F.col("origin") == "none"
    return found.where(~F.col("origin").isin("cache", "nowhere")).select("word", *FIELDS, unknown.alias("not_found"), F.when(unknown, policy).otherwise("").alias("policy"))


def parsed(pages: DataFrame, parse: Callable[[str], dict[str, str]] = providers.first_dictionary_entry) -> DataFrame:
    """A dictionary's pages (word, html) as a table of entries; pages without a meaning are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entries = [parse(page or "") for page in batch["html"]]
            yield pd.DataFrame({"word": batch["word"], **{c: [e.get(c, "") for e in entries] for c in FIELDS}})

    rows = pages.select("word", "html").mapInPandas(run, "word string, " + ", ".join(f"{c} string" for c in FIELDS))
    return rows.where((F.col("zh") != "") | (F.col("en") != ""))


def from_json_file(text: str) -> list[tuple]:
    """Rows of the cache from the JSON of a single-user cache file: one object a word."""
    out = []
    for word, value in json.loads(text).items():
        if isinstance(value, dict):
            out.append((word, *[str(value.get(c, "") or "") for c in FIELDS], bool(value.get(providers.NOT_FOUND)), str(value.get("_not_found_policy", value.get("policy", "")) or "")))
    return out
