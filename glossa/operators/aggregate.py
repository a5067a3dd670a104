"""Corpus aggregates over the child tables of analysed articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..sources.work import written
from .analyze import top_per_group


def listed(column: str) -> Column:
    """Distinct values, sorted, separated by commas."""
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def vocabulary(vocab: DataFrame, articles: DataFrame) -> DataFrame:
    """vocab: doc_id, word, lemma, field, category, frequency, importance, example_sentence; articles: doc_id, source, metadata_json."""
    joined = vocab.join(articles.select("doc_id", "source", F.get_json_object("metadata_json", "$.citation").alias("citation")), "doc_id")
    return joined.groupBy("field", "word", "lemma", "category").agg(
        F.sum("frequency").alias("frequency"), F.max("importance").alias("importance"), F.count_distinct("doc_id").alias("article_count"),
        F.min("example_sentence").alias("example_sentence"), listed("source").alias("sources"), F.min("citation").alias("citation"),
    )


def marks(field: Column, source: Column, citation: Column) -> Column:
    """An aggregate over the rows of one text, for ``text_vocabulary``: what its words are added up by.

    A struct for each row, with its source, and one for each citation. Only the former carry frequencies (``n``), and only
    the first one of a field counts the text.
    """
    rows, none = F.collect_list(F.struct(field.alias("field"), source.alias("source"), citation.alias("citation"))), F.lit(None).cast("string")
    mark = lambda r, source, citation, n, counts: F.struct(r["field"].alias("field"), source.alias("source"), citation.alias("citation"), F.lit(n).alias("n"), counts.alias("counts"))
    sources = F.transform(rows, lambda r, i: mark(r, r["source"], none, 1, ~F.exists(F.slice(rows, F.lit(1), i), lambda x: x["field"].eqNullSafe(r["field"]))))
    citations = F.transform(F.filter(rows, lambda r: r["citation"].isNotNull()), lambda r: mark(r, none, r["citation"], 0, F.lit(False)))
    return F.concat(sources, citations)


def text_vocabulary(entries: DataFrame) -> DataFrame:
    """What ``vocabulary`` gives, of words counted inside their texts (``analyze.text_terms``): part, marks, word, lemma, category, frequency, importance, example_sentence.

    The words of all texts of a part are added up in its task, by field and source and by field and citation. Texts are keys
    there: a minimum of texts or a list would have Spark sort every word of every text. Lists and minima are made of the
    sums, and only these are shuffled: at most a row for each entry and part.
    """
    rows = entries.select("part", "word", "lemma", "category", "frequency", "importance", "example_sentence", F.explode("marks").alias("m"))
    sums = rows.groupBy("part", "m.field", "word", "lemma", "category", "m.source", "m.citation", F.when(F.col("m.counts"), F.col("example_sentence")).alias("example_sentence")).agg(
        F.sum(F.col("frequency") * F.col("m.n")).alias("frequency"), F.max("importance").alias("importance"), F.sum(F.col("m.counts").cast("long")).alias("article_count"),
    )
    return sums.groupBy("field", "word", "lemma", "category").agg(
        F.sum("frequency").alias("frequency"), F.max("importance").alias("importance"), F.sum("article_count").alias("article_count"),
        F.min("example_sentence").alias("example_sentence"), listed("source").alias("sources"), F.min("citation").alias("citation"),
    )


def collocations(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """Grouped by (expression, type), with the class, words and length by which they rank."""
    joined = rows.join(articles.select("doc_id", "source"), "doc_id")
    out = joined.groupBy("expression", "type").agg(
        F.sum("frequency").alias("frequency"), F.max("importance").alias("importance"), F.count_distinct("doc_id").alias("article_count"),
        F.max("meaning").alias("meaning"), F.min("example_sentence").alias("example_sentence"), listed("source").alias("sources"),
    )
    words = F.size(F.split("expression", " "))
    return out.withColumns({"class": F.when(F.col("meaning") != "", 3).when(F.col("type") == "3-gram", 2).otherwise(1), "n_words": words, "n_chars": F.length("expression")})


def senses(rows: DataFrame, articles: DataFrame) -> DataFrame:
    joined = rows.join(articles.select("doc_id", "source"), "doc_id")
    return joined.groupBy("word", "ordinary_meaning", "contextual_meaning").agg(F.count_distinct("doc_id").alias("article_count"), F.min("sentence").alias("sentence"), listed("source").alias("sources"))


def patterns(rows: DataFrame) -> DataFrame:
    """rows: doc_id, ord, type, function, sentence, pattern, importance, source.

    Types and templates are normalised; an occurrence (article, type, sentence) counts once, the first; templates are
    grouped without regard to case; up to four best examples with different sentences. The rows are made once and written.
    """
    rows = written(rows).withColumn("raw_type", F.col("type")).withColumn("type", T.pattern_type(F.col("raw_type"), F.col("function")))
    rows = rows.withColumn("plain", F.lower(T.squeezed(F.col("sentence"))))
    rows = rows.withColumn("pattern", T.pattern_template(F.col("plain"), F.col("type"), F.col("pattern")))
    once = top_per_group(rows, ["doc_id", "type", "sentence"], [F.asc("ord")], 1).drop("rank")
    once = once.withColumns({"key": F.lower("pattern"), "quality": T.example_quality(F.col("sentence"), F.col("pattern"), F.col("source"))})
    place = F.struct("doc_id", "ord")
    stats = once.groupBy("type", "key").agg(
        F.min_by("pattern", place).alias("pattern"), F.count("*").alias("frequency"), F.max("importance").alias("importance"),
        F.count_distinct("doc_id").alias("article_count"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"),
    )
    kinds = once.groupBy("type", "key", "raw_type").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    kinds = top_per_group(kinds, ["type", "key"], [F.desc("n"), F.asc("at")], 5).groupBy("type", "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "raw_type"))), lambda r: r["raw_type"]), ", ").alias("raw_types"))
    best = top_per_group(once, ["type", "key", "plain"], [F.desc("quality"), F.asc("doc_id"), F.asc("ord")], 1).drop("rank")
    best = top_per_group(best, ["type", "key"], [F.desc("quality"), F.asc("doc_id"), F.asc("ord")], 4)
    best = best.groupBy("type", "key").agg(F.sort_array(F.collect_list(F.struct("rank", "sentence", "source", "quality"))).alias("examples"))
    priority = T.mapped(F.col("type"), {c: str(p) for c, _, p, _ in L.PATTERNS}, F.lit("1")).cast("int")
    return stats.join(kinds, ["type", "key"]).join(best, ["type", "key"]).withColumns({"priority": priority, "example_sentence": F.col("examples")[0]["sentence"], "example_source": F.col("examples")[0]["source"], "example_quality": F.col("examples")[0]["quality"]}).drop("key")


def vocabulary_list(vocab: DataFrame, articles: DataFrame, mastery: DataFrame) -> DataFrame:
    """One row a lemma, with its mastery level."""
    joined = vocab.join(articles.select("doc_id", "source"), "doc_id")
    out = joined.groupBy("lemma").agg(
        F.min("word").alias("word"), F.sum("frequency").alias("frequency"), F.max("importance").alias("importance"), F.count_distinct("doc_id").alias("article_count"),
        F.min(F.nullif("example_sentence", F.lit(""))).alias("example_sentence"), listed("category").alias("categories"), listed("source").alias("sources"),
    )
    return out.join(mastery.select("lemma", "level"), "lemma", "left")


def merge_vocabulary(rows: DataFrame) -> DataFrame:
    """One row a word: sums and maxima; other values from the first row, the example from the first that has one."""
    place = F.col("ord")
    return rows.groupBy("word").agg(
        F.min_by("category", place).alias("category"), F.min_by("field", place).alias("field"), F.sum("frequency").alias("frequency"), F.max("article_count").alias("article_count"), F.max("importance").alias("importance"),
        F.coalesce(F.min_by("example_sentence", F.when(F.col("example_sentence") != "", place)), F.lit("")).alias("example_sentence"),
    )


Order = Sequence[tuple[Column, bool]]


def sorting(order: Order) -> list[Column]:
    """Sort columns of (value, whether large ones come first)."""
    return [c.desc() if down else c.asc() for c, down in order]


def limit_of(group: str, limits: dict[str, int], default: int) -> Column:
    return T.mapped(F.col(group), {g: str(n) for g, n in limits.items()}, F.lit(str(default))).cast("int")


def within_caps(rows: DataFrame, limits: dict[str, int], order: Order, *, group: str = "domain", default: int = 160) -> DataFrame:
    """Each group's first rows, up to its limit, with their rank. Spark prunes each task's rows before the shuffle."""
    return top_per_group(rows, [group], sorting(order), max([default, *limits.values()])).where(F.col("rank") <= limit_of(group, limits, default))


def cut_offs(rows: DataFrame, limits: dict[str, int], order: Order, *, group: str = "domain", default: int = 160) -> DataFrame:
    """(group, cut): the order's values of the last row within the limit, a row for each group that has more or as many."""
    values = F.struct(*[c.alias(f"v{i}") for i, (c, _) in enumerate(order)])
    kept = within_caps(rows.select(group, values.alias("cut")), limits, [(F.col(f"cut.v{i}"), down) for i, (_, down) in enumerate(order)], group=group, default=default)
    return kept.where(F.col("rank") == limit_of(group, limits, default)).select(group, "cut")


def beyond(order: Order, cut: Column) -> Column:
    """Whether a row comes after the one of the cut. Nulls come last in falling order and first in rising order, as in sorting."""
    out = F.lit(False)
    for i, (value, down) in reversed(list(enumerate(order))):
        last = cut[f"v{i}"]
        later = (value < last) | (value.isNull() & last.isNotNull()) if down else (value > last) | (value.isNotNull() & last.isNull())
        out = F.coalesce(later, F.lit(False)) | (value.eqNullSafe(last) & out)
    return out


def capped(rows: DataFrame, limits: dict[str, int], order: Order, *, group: str = "domain", default: int = 160) -> DataFrame:
    """All rows: those within their group's limit with their rank, the others without one, as overflow. The order must be total.

    The first ones are one pass of a pruned ranking; the others one pass that compares with each group's cut-off, a row a
    group. A filter on overflow leaves only the one or the other to be computed.
    """
    kept = within_caps(rows, limits, order, group=group, default=default).select(*rows.columns, "rank", F.lit(False).alias("overflow"))
    cuts = cut_offs(rows, limits, order, group=group, default=default).withColumnRenamed(group, "__group")
    over = rows.join(cuts, F.col(group) == F.col("__group")).where(beyond(order, F.col("cut")))
    return kept.unionByName(over.select(*rows.columns, F.lit(None).cast("int").alias("rank"), F.lit(True).alias("overflow")))


def diversified(rows: DataFrame, *, per_type: int = 4, limit: int = 40) -> DataFrame:
    """Round-robin over types: in each round each type gives its next row whose example hasn't been used; with place, from 0.

    rows: type, pattern, priority, article_count, frequency, example_quality, importance, example_sentence. At most
    ``limit`` rows come out; each type's first ``limit + per_type`` rows are enough, as at most ``limit`` examples can
    be used up. The choice is a fold over the turns, in one row of those bounded lists; the type "other" has two turns.
    """
    labels = [label for _, label, _, _ in L.PATTERNS] + ["Other structure"]
    order = [F.desc((~F.col("pattern").isin(labels)).cast("int")), F.desc("article_count"), F.desc("frequency"), F.desc("example_quality"), F.desc("importance"), F.asc("pattern")]
    sizes = rows.groupBy("type").agg(F.count("*").alias("size"))
    some = top_per_group(rows, ["type"], order, limit + per_type).join(sizes, "type").withColumn("plain", F.lower(T.squeezed(F.col("example_sentence"))))
    entry = F.struct("rank", "plain", F.struct(*rows.columns).alias("row"))
    lists = some.groupBy("type").agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.max_by("priority", -F.col("rank")).alias("priority"), F.first("size").alias("size"))
    place = F.struct((F.col("type") == "other").alias("a"), (-F.col("priority")).alias("b"), (-F.col("size")).alias("c"), F.col("type").alias("d"), "entries")
    whole = lists.groupBy().agg(F.sort_array(F.collect_list(place)).alias("types"))
    turns = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(per_type - 1)), lambda turn: F.filter(F.col("types"), lambda t: ~t["a"] | (turn < 2))))
    kind = lists.schema["entries"].dataType.simpleString()
    start = F.struct(F.expr("array()").cast(kind).alias("taken"), F.expr("array()").cast("array<string>").alias("used"))

    def take(state: Column, kind: Column) -> Column:
        fit = F.filter(kind["entries"], lambda e: ((e["plain"] == "") | ~F.array_contains(state["used"], e["plain"])) & ~F.array_contains(state["taken"], e))
        more = F.when(F.size(state["taken"]) < limit, F.slice(fit, 1, 1)).otherwise(F.slice(fit, 1, 0))
        return F.struct(F.concat(state["taken"], more).alias("taken"), F.concat(state["used"], F.transform(more, lambda e: e["plain"])).alias("used"))

    chosen = whole.select(F.posexplode(F.aggregate(turns, start, take, lambda s: s["taken"])).alias("place", "e"))
    return chosen.select("place", "e.row.*")
