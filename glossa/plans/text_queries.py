"""Queries over texts: tokens, n-grams, sentences, rules and scores, each beside its oracle SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import aggregate, analyze
from . import fixtures as X
from . import fragments as D
from .registry import query, table

DOMAINS = X.DOMAINS
FX = X.CORPUS_SQL
FXS = f"{FX}, s0 AS (SELECT doc_id, source, {D.sentences('text')} AS ss FROM articles), s1 AS (SELECT doc_id, source, unnest(ss) AS sentence, unnest(range(len(ss))) AS pos FROM s0), s AS (SELECT *, {D.plain('sentence')} AS plain_s FROM s1)"


def corpus(spark, d):
    """All documents, and the fixture's articles under negative ids, as the documents hold few English cue words."""
    docs = table(spark, d, "documents").select("doc_id", F.lit("").alias("title"), "source", F.col("lang").alias("field"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.unionByName(X.articles(spark).withColumn("doc_id", -F.col("doc_id")))


@query(f"WITH t AS (SELECT unnest({D.tokens('text')}) AS token FROM documents) SELECT token, count(*) AS frequency FROM t GROUP BY token")
def token_frequency(spark, d):
    return analyze.token_rows(table(spark, d, "documents")).groupBy("token").agg(F.count("*").alias("frequency"))


@query(f"WITH {D.C} SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM c")
def content_token_stats(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


COUNTS = f"{D.R}, f AS (SELECT doc_id, token, count(*) AS frequency, min(pos) AS first_pos FROM r GROUP BY ALL)"


@query(f"WITH {COUNTS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, first_pos) AS rank FROM f) SELECT doc_id, token, frequency, first_pos, rank FROM k WHERE rank <= 40")
def top_terms_per_doc(spark, d):
    return analyze.top_terms(table(spark, d, "documents"))


def grams_sql(n: int) -> str:
    leads = ", ".join(f"lead(token, {i}) OVER w AS t{i}" for i in range(1, n))
    stop = D.listing(L.STOPWORDS)
    ok = " AND ".join(f"NOT list_contains({stop}, {t})" for t in ["token", *[f"t{i}" for i in range(1, n)]])
    gram = " || ' ' || ".join(["token", *[f"t{i}" for i in range(1, n)]])
    return f"SELECT doc_id, {n} AS n, pos, {gram} AS gram FROM (SELECT doc_id, pos, token, {leads} FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE t{n - 1} IS NOT NULL AND {ok}"


@query(f"WITH {D.R}, g AS ({grams_sql(2)}) SELECT gram, count(*) AS frequency, count(DISTINCT doc_id) AS n_docs FROM g GROUP BY gram")
def bigram_counts(spark, d):
    return analyze.ngram_rows(table(spark, d, "documents"), 2).groupBy("gram").agg(F.count("*").alias("frequency"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {D.R}, g AS ({grams_sql(3)}) SELECT gram, count(*) AS frequency, count(DISTINCT doc_id) AS n_docs FROM g GROUP BY gram")
def trigram_counts(spark, d):
    return analyze.ngram_rows(table(spark, d, "documents"), 3).groupBy("gram").agg(F.count("*").alias("frequency"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {D.R}, g AS ({grams_sql(2)} UNION ALL {grams_sql(3)}), f AS (SELECT doc_id, n, gram, count(*) AS frequency, min(pos) AS first_pos FROM g GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, n, first_pos) AS rank FROM f) SELECT * FROM k WHERE rank <= 35")
def ngram_topk_per_doc(spark, d):
    return analyze.top_ngrams(table(spark, d, "documents"))


@query(f"""WITH {D.R}, q AS (SELECT token AS x, lead(token) OVER (ORDER BY doc_id, pos) AS y FROM r),
p AS (SELECT x, y, count(*) AS frequency FROM q WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 2), u AS (SELECT token, count(*) AS n FROM r GROUP BY token), t AS (SELECT count(*) AS total FROM r)
SELECT x || ' ' || y AS expression, frequency, {D.rounded('log2((frequency / total) / ((a.n / total) * (b.n / total)))', 3)} AS pmi FROM p JOIN u a ON a.token = x JOIN u b ON b.token = y, t ORDER BY pmi DESC, frequency DESC, expression LIMIT 50""")
def pmi_bigrams(spark, d):
    return analyze.pmi(table(spark, d, "documents"))


SEEDS = ["thth", "thhe", "tion", "orre", "thnt"]


@query(f"""WITH documents AS (SELECT item_id AS doc_id, text FROM benchmark UNION ALL SELECT doc_id + 1000000, text FROM main.documents), {D.R}, g AS ({grams_sql(2)} UNION ALL {grams_sql(3)}),
f AS (SELECT n, gram, count(*) AS frequency FROM g WHERE list_has_any(string_split(gram, ' '), {D.listing(SEEDS)}) AND len(list_filter(string_split(gram, ' '), lambda x: len(x) < 4)) = 0 GROUP BY ALL HAVING count(*) >= 2)
SELECT n, gram, frequency FROM f ORDER BY frequency DESC, n, gram LIMIT 24""")
def topic_queries(spark, d):
    docs = table(spark, d, "documents").select((F.col("doc_id") + 1000000).alias("doc_id"), "text")
    both = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text").unionByName(docs)
    return analyze.topic_queries(both, seeds=SEEDS)


@query(f"WITH {D.S} SELECT doc_id, pos, sentence FROM s")
def sentence_split(spark, d):
    return analyze.sentence_rows(table(spark, d, "documents"))


@query(f"WITH q AS (SELECT conv_id, turn, {D.sentences('text')} AS ss FROM conversations) SELECT conv_id, turn, len(ss) AS n_sentences, coalesce(ss[1], '') AS first_sentence FROM q")
def sentence_stats(spark, d):
    ss = table(spark, d, "conversations").select("conv_id", "turn", T.sentences(F.col("text")).alias("ss"))
    return ss.select("conv_id", "turn", F.size("ss").alias("n_sentences"), F.coalesce(F.get("ss", F.lit(0)), F.lit("")).alias("first_sentence"))


@query(f"WITH {D.S} SELECT doc_id, first(sentence ORDER BY pos) AS sentence FROM s WHERE contains(lower(sentence), 'tion') GROUP BY doc_id")
def word_context(spark, d):
    return analyze.sentence_rows(table(spark, d, "documents")).where(F.contains(F.lower("sentence"), F.lit("tion"))).groupBy("doc_id").agg(F.min_by("sentence", "pos").alias("sentence"))


SCORE = "least(2.0 + len(list_distinct(w)) / len(w) * 2.0 + least(len(w) / greatest(len(ss), 1) / 18, 1.5) + len(list_filter(w, lambda x: len(x) >= 9)) / len(w) * 4.0, 10.0)"
DIFFICULTY = f"CASE WHEN len(w) = 0 THEN 1.0 ELSE {D.rounded(SCORE, 1)} END"


@query(f"WITH c AS (SELECT doc_id, {D.content('text')} AS w, {D.sentences('text')} AS ss FROM documents) SELECT doc_id, ({DIFFICULTY})::DOUBLE AS difficulty FROM c")
def difficulty(spark, d):
    return analyze.scores(table(spark, d, "documents"), DOMAINS).select("doc_id", "difficulty")


HITS = ", ".join(f"len(list_filter(w, lambda x: list_contains({D.listing(k)}, x))) AS {n}" for n, k in DOMAINS.items())
TOTAL = " + ".join(DOMAINS)
DOMAIN = f"{D.C}, h AS (SELECT doc_id, {HITS} FROM c), p AS (SELECT doc_id, {', '.join(f'CASE WHEN {TOTAL} = 0 THEN 0.0 ELSE {D.rounded(f"{n} / ({TOTAL})", 4)} END::DOUBLE AS {n}' for n in DOMAINS)} FROM h)"
BEST = "CASE WHEN greatest(first, second, third) = 0 THEN 'unknown' WHEN first = greatest(first, second, third) THEN 'first' WHEN second = greatest(first, second, third) THEN 'second' ELSE 'third' END"


@query(f"WITH {DOMAIN} SELECT doc_id, first, second, third, {BEST} AS field FROM p")
def domain_scores(spark, d):
    return analyze.domain_scores(table(spark, d, "documents"), DOMAINS)


@query(f"WITH {DOMAIN} SELECT {BEST} AS field, count(*) AS n FROM p GROUP BY ALL")
def domain_argmax(spark, d):
    return analyze.domain_scores(table(spark, d, "documents"), DOMAINS).groupBy("field").agg(F.count("*").alias("n"))


PATTERN_HITS = " UNION ALL ".join(f"SELECT doc_id, source, pos, {i} AS ord, {D.quoted(c)} AS type, {D.quoted(label)} AS function, sentence FROM s WHERE regexp_matches(lower(plain_s), {D.quoted(p)})" for i, (c, label, _, p) in enumerate(L.PATTERNS))


def template_sql(code: str, sentence: str) -> str:
    low = f"lower({D.squeezed(D.plain(sentence))})"
    cases = " ".join(f"WHEN {code} = {D.quoted(k)} AND regexp_matches({low}, {D.quoted(p)}) THEN {D.quoted(label)}" for k, cues in L.TEMPLATES.items() for label, p in cues)
    labels = " ".join(f"WHEN {code} = {D.quoted(c)} THEN {D.quoted(label)}" for c, label, _, _ in L.PATTERNS)
    return f"CASE {cases} {labels} ELSE 'Other structure' END"


STRONG = D.listing(L.STRONG_PATTERNS)
PATTERNS = f"h AS ({PATTERN_HITS}), pr AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY pos, ord) AS ord, type, function, sentence, {template_sql('type', 'sentence')} AS pattern, CASE WHEN list_contains({STRONG}, type) THEN 4 ELSE 3 END AS importance FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos, ord) <= 60)"


@query(f"WITH {FXS}, {PATTERNS} SELECT doc_id, ord, type, function, sentence, pattern, importance FROM pr")
def pattern_hits(spark, d):
    return analyze.pattern_rows(corpus(spark, d))


@query(f"WITH {FXS}, {PATTERNS} SELECT type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM pr GROUP BY type")
def pattern_hits_by_type(spark, d):
    return analyze.pattern_rows(corpus(spark, d)).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


SENSES = " UNION ALL ".join(f"SELECT doc_id, pos, sentence, {D.quoted(w)} AS word, {D.quoted(o)} AS ordinary_meaning, {D.quoted(c)} AS contextual_meaning FROM s WHERE list_contains({D.content('sentence')}, {D.quoted(w)}) AND regexp_matches(plain_s, {D.quoted('(?i)' + p)})" for w, o, c, p in L.SENSES)
SENSE_ROWS = f"sh AS ({SENSES}), sr AS (SELECT doc_id, word, ordinary_meaning, contextual_meaning, first(sentence ORDER BY pos) AS sentence, 'high' AS exam_risk FROM sh GROUP BY doc_id, word, ordinary_meaning, contextual_meaning)"


@query(f"WITH {FXS}, {SENSE_ROWS} SELECT * FROM sr")
def polysemy_first_hit(spark, d):
    return analyze.sense_rows(corpus(spark, d))


@query(f"WITH {FXS}, {SENSE_ROWS} SELECT word, ordinary_meaning, contextual_meaning, count(DISTINCT doc_id) AS article_count, min(sentence) AS sentence, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM sr JOIN articles USING (doc_id) GROUP BY ALL")
def aggregate_polysemy(spark, d):
    docs = corpus(spark, d)
    return aggregate.senses(analyze.sense_rows(docs), docs)


TEXT, LENGTH = D.squeezed("sentence"), f"len({D.squeezed('sentence')})"
QUALITY = D.rounded(f"""(CASE WHEN {LENGTH} BETWEEN 70 AND 240 THEN 4.0 WHEN {LENGTH} BETWEEN 45 AND 320 THEN 2.0 ELSE -least(abs({LENGTH} - 150) / 80, 4.0) END
 + CASE WHEN len(regexp_extract_all({TEXT}, '[A-Za-z]+(?:[-''][A-Za-z]+)?')) BETWEEN 14 AND 42 THEN 3.0 WHEN len(regexp_extract_all({TEXT}, '[A-Za-z]+(?:[-''][A-Za-z]+)?')) BETWEEN 9 AND 55 THEN 1.0 ELSE -1.5 END
 + CASE WHEN right({TEXT}, 1) IN ('.', '!', '?', '"', '”', '’') THEN 0.5 ELSE 0 END + CASE WHEN pattern <> '' AND contains(lower({TEXT}), lower(pattern)) THEN 0.8 ELSE 0 END
 + CASE WHEN lower(source) IN ('kaoyan_exam', 'pastpapers.cn') THEN 1.5 ELSE 0 END - CASE WHEN regexp_matches(lower({TEXT}), 'subscribe|sign up|newsletter|all rights reserved') THEN 6.0 ELSE 0 END - CASE WHEN {LENGTH} > 420 THEN 5.0 ELSE 0 END)""", 3)
PRIORITY = "CASE type " + " ".join(f"WHEN {D.quoted(c)} THEN {p}" for c, _, p, _ in L.PATTERNS) + " ELSE 1 END"
PATTERN_GROUPS = f"""o AS (SELECT *, {QUALITY} AS quality, lower({TEXT}) AS plain FROM pr QUALIFY row_number() OVER (PARTITION BY doc_id, type, sentence ORDER BY ord) = 1),
ex AS (SELECT *, row_number() OVER (PARTITION BY type, lower(pattern) ORDER BY quality DESC, doc_id, ord) AS rk FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY type, lower(pattern), plain ORDER BY quality DESC, doc_id, ord) = 1)),
pg AS (SELECT o.type, min_by(o.pattern, o.doc_id * 1000 + o.ord) AS pattern, count(*) AS frequency, max(o.importance) AS importance, count(DISTINCT o.doc_id) AS article_count, string_agg(DISTINCT o.source, ', ' ORDER BY o.source) AS sources, o.type AS raw_types, lower(o.pattern) AS key FROM o GROUP BY o.type, lower(o.pattern)),
pa AS (SELECT pg.*, ex.sentence AS example_sentence, ex.source AS example_source, ex.quality AS example_quality, (SELECT count(*) FROM ex e WHERE e.type = pg.type AND lower(e.pattern) = pg.key AND e.rk <= 4) AS n_examples FROM pg JOIN ex ON ex.type = pg.type AND lower(ex.pattern) = pg.key AND ex.rk = 1)"""


@query(f"WITH {FXS}, {PATTERNS}, {PATTERN_GROUPS} SELECT type, pattern, frequency, importance, article_count, sources, raw_types, {PRIORITY} AS priority, example_sentence, example_source, example_quality, n_examples FROM pa")
def pattern_aggregate(spark, d):
    rows = aggregate.patterns(analyze.pattern_rows(corpus(spark, d), keep=["source"]))
    return rows.withColumn("n_examples", F.size("examples")).drop("examples")


DIVERSE = f"""WITH RECURSIVE {FXS}, {PATTERNS}, {PATTERN_GROUPS},
pl AS (SELECT type, pattern, example_sentence, lower({D.squeezed('example_sentence')}) AS plain, {PRIORITY} AS priority, row_number() OVER (PARTITION BY type ORDER BY (pattern NOT IN {tuple([label for _, label, _, _ in L.PATTERNS] + ['Other structure'])})::INT DESC, article_count DESC, frequency DESC, example_quality DESC, importance DESC, pattern) AS rank, count(*) OVER (PARTITION BY type) AS size FROM pa),
ty AS (SELECT type, row_number() OVER (ORDER BY type = 'other', priority DESC, size DESC, type) AS ty FROM pl WHERE rank = 1),
tn AS (SELECT row_number() OVER (ORDER BY turn, ty) AS step, type FROM ty, range(2) t(turn)),
di(step, taken, used) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[]
  UNION ALL
  SELECT step, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, CASE WHEN pick IS NULL THEN used ELSE list_append(used, plain) END
  FROM (SELECT tn.step, di.taken, di.used, first(pl.type || chr(1) || pl.pattern ORDER BY pl.rank) FILTER (WHERE len(di.taken) < 20 AND NOT list_contains(di.taken, pl.type || chr(1) || pl.pattern) AND (pl.plain = '' OR NOT list_contains(di.used, pl.plain))) AS pick,
      first(pl.plain ORDER BY pl.rank) FILTER (WHERE len(di.taken) < 20 AND NOT list_contains(di.taken, pl.type || chr(1) || pl.pattern) AND (pl.plain = '' OR NOT list_contains(di.used, pl.plain))) AS plain
    FROM di JOIN tn ON tn.step = di.step + 1 JOIN pl ON pl.type = tn.type GROUP BY tn.step, di.taken, di.used)
),
ch AS (SELECT unnest(taken) AS pick, unnest(range(len(taken)))::INT AS place FROM di WHERE step = (SELECT max(step) FROM di))
SELECT place, type, pattern, example_sentence FROM ch JOIN pl ON pick = type || chr(1) || pattern"""


@query(DIVERSE)
def pattern_diverse_select(spark, d):
    rows = aggregate.patterns(analyze.pattern_rows(corpus(spark, d), keep=["source"]))
    return aggregate.diversified(rows, per_type=2, limit=20).select("place", "type", "pattern", "example_sentence")


WORDS = [("tion",), ("thth",), ("thhe",), ("orre",), ("ment",)]
SQ_WORDS = "len(" + D.words("sentence") + ")"
SCORE = f"""CASE WHEN {SQ_WORDS} < 6 OR {SQ_WORDS} > 45 THEN 1.0 ELSE 15.0 + CASE WHEN {SQ_WORDS} BETWEEN 12 AND 28 THEN 3.0 ELSE 0 END + CASE WHEN left(sentence, 1) <> lower(left(sentence, 1)) THEN 2.0 ELSE 0 END
 + CASE WHEN right(sentence, 1) IN ('.', '?', '!') THEN 2.0 ELSE 0 END - CASE WHEN regexp_matches(sentence, '[{{}}|<>]|\\[\\]') THEN 5.0 ELSE 0 END
 - CASE WHEN NOT regexp_matches(left(sentence, 1), '[\\p{{L}}\\p{{N}}]') AND left(sentence, 1) NOT IN ('"', '''', '“', '‘') THEN 4.0 ELSE 0 END END"""


@query(f"""WITH {D.S}, words AS (SELECT * FROM (VALUES ('tion'), ('thth'), ('thhe'), ('orre'), ('ment')) v(word)),
direct AS (SELECT doc_id, word, sentence, pos, {SCORE} AS score FROM s, words WHERE regexp_matches(lower(sentence), '(^|[^a-z0-9_])' || word || '(s|es|ed|ing|d)?($|[^a-z0-9_])')),
best AS (SELECT doc_id, word, first(sentence ORDER BY score DESC, pos) AS sentence FROM direct GROUP BY ALL),
other AS (SELECT doc_id, word, first(sentence ORDER BY pos) AS sentence FROM s, words WHERE list_contains({D.content('sentence')}, word) GROUP BY doc_id, word)
SELECT d.doc_id, w.word, coalesce(b.sentence, o.sentence, '') AS example_sentence FROM documents d CROSS JOIN words w LEFT JOIN best b ON b.doc_id = d.doc_id AND b.word = w.word LEFT JOIN other o ON o.doc_id = d.doc_id AND o.word = w.word""")
def best_example_sentence(spark, d):
    docs = table(spark, d, "documents")
    asked = docs.select("doc_id", F.explode(F.array(*[F.lit(w[0]) for w in WORDS])).alias("word"))
    return analyze.best_examples(asked, docs, only=[w[0] for w in WORDS])


LISTED = "['" + "', '".join(t for t in L.TIERS) + "']"


def candidates_sql(w: str) -> str:
    cut = lambda k: f"left({w}, len({w}) - {k})"
    end = lambda x: f"ends_with({w}, {D.quoted(x)})"
    out = [f"CASE WHEN {end(chr(39) + 's')} THEN {cut(2)} END", f"map_extract({D.mapping(L.CONTRACTIONS)}, {w})[1]"]
    out += [f"CASE WHEN {end(x)} THEN {cut(len(x))} END" for x in ("'re", "'ve", "'ll", "'d", "'m", "n't")]
    out += [f"CASE WHEN len({w}) > 4 AND {end('ies')} THEN {cut(3)} || 'y' END"] + [f"CASE WHEN len({w}) > 4 AND {end('ves')} THEN {cut(3)} || '{x}' END" for x in ("f", "fe")]
    out += [f"CASE WHEN len({w}) > 3 AND {end('s')} AND NOT {end('ss')} THEN {cut(1)} END", f"CASE WHEN len({w}) > 4 AND {end('es')} THEN {cut(2)} END"]
    for suffix, least in (("ing", 5), ("ied", 4), ("ed", 4)):
        k = len(suffix)
        if suffix == "ied":
            out.append(f"CASE WHEN len({w}) > {least} AND {end(suffix)} THEN {cut(k)} || 'y' END")
            continue
        stem = cut(k)
        out += [f"CASE WHEN len({w}) > {least} AND {end(suffix)} THEN {stem} || 'e' END", f"CASE WHEN len({w}) > {least} AND {end(suffix)} AND len({stem}) > 2 AND right({stem}, 1) = {stem}[-2] THEN {cut(k + 1)} END", f"CASE WHEN len({w}) > {least} AND {end(suffix)} THEN {stem} END"]
    return "[" + ", ".join(out) + "]"


TIER_MATCH = f"""{X.TIERS_SQL}, li AS (SELECT word AS entry, min(list_position({LISTED}, tier) - 1) AS level FROM tiers GROUP BY word),
tk AS (SELECT DISTINCT unnest({D.tokens('text')}) AS word FROM documents), wd AS (SELECT word FROM tk WHERE regexp_full_match(word, '[a-z]+(?:[-''][a-z]+)*')),
cd AS (SELECT word, cand, ord FROM (SELECT word, unnest(cs) AS cand, unnest(range(len(cs))) AS ord FROM (SELECT word, {candidates_sql('word')} AS cs FROM wd)) WHERE cand IS NOT NULL AND len(cand) > 1 AND cand <> word),
cl AS (SELECT cd.word, ord, coalesce(map_extract({D.mapping(L.FORMS)}, cand)[1], cand) AS entry FROM cd),
cm AS (SELECT cl.word, ord, cl.entry, level FROM cl JOIN li ON li.entry = cl.entry),
ir AS (SELECT word, li.entry, level FROM wd JOIN li ON li.entry = map_extract({D.mapping(L.FORMS)}, word)[1]), ex AS (SELECT word, li.level FROM wd JOIN li ON li.entry = word),
f1 AS (SELECT word, min_by(entry, ord) AS entry, min_by(level, ord) AS level FROM cm GROUP BY word),
f2 AS (SELECT cm.word, min_by(cm.entry, ord) AS entry, min_by(cm.level, ord) AS level FROM cm JOIN ex ON ex.word = cm.word AND cm.level < ex.level GROUP BY cm.word),
tm AS (SELECT wd.word, CASE WHEN ir.word IS NOT NULL THEN ir.entry WHEN ex.word IS NULL THEN coalesce(f1.entry, wd.word) ELSE coalesce(f2.entry, wd.word) END AS lemma,
 {LISTED}[coalesce(CASE WHEN ir.word IS NOT NULL THEN ir.level WHEN ex.word IS NULL THEN f1.level ELSE coalesce(f2.level, ex.level) END, 4) + 1] AS tier
 FROM wd LEFT JOIN ir USING (word) LEFT JOIN ex USING (word) LEFT JOIN f1 USING (word) LEFT JOIN f2 USING (word))"""


@query(f"WITH {TIER_MATCH} SELECT word, lemma, tier FROM tm UNION ALL SELECT word, word, 'rare' FROM tk WHERE word NOT IN (SELECT word FROM wd)")
def tier_match(spark, d):
    words = analyze.token_rows(table(spark, d, "documents")).select(F.col("token").alias("word")).distinct()
    return analyze.match_tiers(words, X.tiers(spark))


HIGHLIGHTS = f"{TIER_MATCH}, tp AS (SELECT doc_id, unnest({D.tokens('text')}) AS word, unnest(range(len({D.tokens('text')}))) AS pos FROM documents), hl AS (SELECT doc_id, word, min(pos) AS pos FROM tp GROUP BY doc_id, word), hm AS (SELECT doc_id, pos, word, lemma, tier FROM hl JOIN tm USING (word) WHERE tier <> 'rare')"


def highlighted(spark, d):
    rows = analyze.token_rows(table(spark, d, "documents")).groupBy("doc_id", F.col("token").alias("word")).agg(F.min("pos").alias("pos"))
    found = analyze.match_tiers(rows.select("word").distinct(), X.tiers(spark)).where("tier <> 'rare'")
    return rows.join(found, "word").select("doc_id", "pos", "word", "lemma", "tier")


@query(f"WITH {HIGHLIGHTS} SELECT * FROM hm")
def highlights(spark, d):
    return highlighted(spark, d)


@query(f"WITH {HIGHLIGHTS}, la AS (SELECT doc_id, lemma, max_by(tier, pos) AS tier FROM hm GROUP BY ALL) SELECT doc_id, tier, count(*) AS lemmas FROM la GROUP BY ALL")
def tier_counts(spark, d):
    from ..operators.serve import tier_counts as counted

    return counted(highlighted(spark, d))


@query(f"""WITH {TIER_MATCH.replace("FROM documents", "FROM documents, (SELECT 1)")}, {COUNTS}, {DOMAIN.split(", ", 1)[1] if False else DOMAIN.replace(D.C + ", ", "")}, fl AS (SELECT doc_id, {BEST} AS field FROM p),
el AS (SELECT f.doc_id, f.token AS word, field, frequency, first_pos, coalesce(tier, 'rare') AS tier, CASE {' '.join(f"WHEN field = '{n}' AND f.token IN ({', '.join(map(D.quoted, k))}) THEN 'domain terminology'" for n, k in DOMAINS.items())} ELSE 'academic/general' END AS category FROM f JOIN fl USING (doc_id) LEFT JOIN tl ON tl.word = f.token),
ok AS (SELECT * FROM el WHERE tier <> 'high_school' AND NOT (tier = 'rare' AND category = 'academic/general')),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, first_pos) AS rank FROM ok)
SELECT doc_id, word, field, category, frequency, greatest(CASE tier WHEN 'core' THEN 5 WHEN 'key' THEN 4 WHEN 'gre' THEN 3 ELSE 1 END, 1) AS importance, rank FROM rk WHERE rank <= 40""".replace("tk AS (SELECT DISTINCT unnest(" + D.tokens("text") + ") AS word FROM documents, (SELECT 1))", f"tk AS (SELECT DISTINCT unnest({D.content('text')}) AS word FROM documents)").replace("LEFT JOIN tl ON", "LEFT JOIN tm AS tl ON"))
def review_vocabulary(spark, d):
    return analyze.review_terms(table(spark, d, "documents"), X.tiers(spark), DOMAINS)


def scored_articles(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.concat(F.lit("Title "), F.substring("text", 1, 20)).alias("title"), F.lit("").alias("url"), F.when(F.col("source") == "src1", "The Guardian").otherwise(F.col("source")).alias("source"), "text", F.when(F.col("doc_id") % 50 == 0, "kaoyan_exam").alias("corpus_type"), F.lit(0.75).alias("reliability"), F.when(F.col("source") == "src1", 1.137).otherwise(0.731).alias("weight"))


PATTERN_LIST = "list_slice(flatten(list_transform(ps, lambda x: list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(x), {D.quoted(p)}) THEN {D.quoted(c)} END" for c, _, _, p in L.PATTERNS) + "], lambda y: y IS NOT NULL))), 1, 60)"
SENSE_COUNT = " + ".join(f"CASE WHEN len(list_filter(range(1, len(ss) + 1), lambda i: regexp_matches(ps[i], {D.quoted('(?i)' + p)}) AND list_contains({D.content('ss[i]')}, {D.quoted(w)}))) > 0 THEN 1 ELSE 0 END" for w, _, _, p in L.SENSES)


def keyword_count(text: str, words) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({text}, '(^|[^A-Za-z0-9_]){k}($|[^A-Za-z0-9_])') THEN 1 ELSE 0 END" for k in words)


BOILER = "[" + ", ".join(f"CASE WHEN regexp_matches(lower(text), {D.quoted('|'.join(ps))}) THEN {D.quoted(n)} END" for n, ps in L.BOILERPLATE.items()) + "]"
GATE = f"""WITH a AS (SELECT doc_id, lower('Title ' || left(text, 20) || ' ') AS blob, CASE WHEN source = 'src1' THEN 1.137 ELSE 0.731 END AS weight, doc_id % 50 = 0 AS exam, text, {D.content('text')} AS w, {D.sentences('text')} AS ss FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)),
a2 AS (SELECT *, list_transform(ss, lambda x: {D.plain('x')}) AS ps FROM a),
b AS (SELECT *, {PATTERN_LIST} AS pl, {SENSE_COUNT} AS polysemy_count, list_filter({BOILER}, lambda y: y IS NOT NULL) AS bl, {keyword_count("blob || ' ' || array_to_string(list_slice(w, 1, 250), ' ')", L.TOPICS)} AS pref, {keyword_count('blob', L.EXCLUDED_TOPICS)} AS excl, len(w) / greatest(len(ss), 1) AS mean FROM a2),
e AS (SELECT *, (1.5::DOUBLE + CASE WHEN len(w) >= 900 THEN 1.5 WHEN len(w) >= 450 THEN 0.8 ELSE -1.5 END + CASE WHEN mean BETWEEN 18 AND 38 THEN 1.2 WHEN mean > 38 THEN 0.6 ELSE 0 END + least(1.4, 0.25 * pref) - CASE WHEN excl > 0 THEN 3.0 ELSE 0 END + least(1.2, 0.25 * polysemy_count) + least(1.0, 0.16::DOUBLE * len(list_distinct(pl))) - least(2.0, 0.5 * len(bl)) - CASE WHEN len(ss) <= 5 OR regexp_matches(lower(left(text, 400)), 'reuters|associated press') THEN 1.0 ELSE 0 END)::DOUBLE * weight AS score FROM b)
SELECT doc_id, len(w) AS token_count, len(ss) AS sentence_count, {D.rounded('mean', 2)} AS avg_sentence_len, polysemy_count, len(pl) AS pattern_count, len(list_distinct(pl)) AS pattern_diversity, CASE WHEN exam THEN 10.0 ELSE {D.rounded('greatest(0.0, least(score, 10.0))', 2)} END::DOUBLE AS quality_score, exam OR (excl = 0 AND len(w) >= 450) AS quality_keep, array_to_string(bl, ',') AS boilerplate FROM e"""


@query(GATE)
def quality_score(spark, d):
    return analyze.quality(scored_articles(spark, d))


@query(f"SELECT count(*) AS n, sum(CASE WHEN quality_keep THEN 1 ELSE 0 END)::BIGINT AS kept FROM ({GATE}) WHERE quality_score >= 2.0")
def quality_gate(spark, d):
    return gated(analyze.quality(scored_articles(spark, d)))


OWN_RULES = [("src1", "prefer", "tion"), ("src1", "prefer", "er th"), ("src2", "prefer", "thth"), ("src2", "exclude", "title"), ("src3", "prefer", "orre"), ("src3", "prefer", "c++"), ("src0", "prefer", "ment"), ("src0", "exclude", "the")]


def own_count(kind: str, text: str) -> str:
    return " + ".join(f"CASE WHEN source = {D.quoted(s)} AND regexp_matches({text}, {D.quoted('(^|[^A-Za-z0-9_])' + re.escape(k) + '($|[^A-Za-z0-9_])')}) THEN 1 ELSE 0 END" for s, x, k in OWN_RULES if x == kind)


BLOB_250 = "blob || ' ' || array_to_string(list_slice(w, 1, 250), ' ')"
RULED = GATE.replace("doc_id % 50 = 0 AS exam, text", "doc_id % 50 = 0 AS exam, source, text", 1).replace(f"{keyword_count(BLOB_250, L.TOPICS)} AS pref", f"{keyword_count(BLOB_250, L.TOPICS)} + {own_count('prefer', BLOB_250)} AS pref").replace(f"{keyword_count('blob', L.EXCLUDED_TOPICS)} AS excl", f"{keyword_count('blob', L.EXCLUDED_TOPICS)} + {own_count('exclude', 'blob')} AS excl")


@query(f"SELECT doc_id, quality_score, quality_keep FROM ({RULED})")
def quality_by_source(spark, d):
    """Each source's own keywords as a table: one scan, whatever the number of sources. Rules go to the texts, not texts to their source's rules."""
    docs = scored_articles(spark, d)
    rules = analyze.source_rules(spark.createDataFrame([("The Guardian" if s == "src1" else s, kind, k) for s, kind, k in OWN_RULES], "source string, kind string, keyword string"))
    return analyze.quality(docs.join(F.broadcast(rules), "source", "left")).select("doc_id", "quality_score", "quality_keep")


def gated(scored):
    return scored.where("quality_score >= 2.0").agg(F.count("*").alias("n"), F.sum(F.col("quality_keep").cast("long")).alias("kept"))


@query(f"WITH {FX}, b AS (SELECT doc_id, unnest(list_filter({BOILER}, lambda y: y IS NOT NULL)) AS marker FROM articles) SELECT * FROM b")
def boilerplate_hits(spark, d):
    return corpus(spark, d).select("doc_id", F.explode(T.boilerplate(F.col("text"))).alias("marker"))


PHRASE_ROWS = " UNION ALL ".join(f"SELECT doc_id, {D.quoted(n)} AS expression, len(regexp_extract_all(low, {D.quoted(p)})) AS frequency, {D.quoted(k)} AS type, {D.quoted(m)} AS meaning, coalesce(list_filter(ss, lambda x: regexp_matches(lower({D.plain('x')}), {D.quoted(p)}))[1], '') AS example_sentence FROM fs WHERE regexp_matches(low, {D.quoted(p)})" for n, p, m, k in L.PHRASES)


@query(f"WITH {FX}, fs AS (SELECT doc_id, lower({D.plain('text')}) AS low, {D.sentences('text')} AS ss FROM articles) {PHRASE_ROWS}")
def exam_phrases(spark, d):
    rows = analyze.collocations(corpus(spark, d)).where("meaning <> ''")
    return rows.select("doc_id", "expression", "frequency", "type", "meaning", "example_sentence")


FX_GRAMS = f"{FX}, documents AS (SELECT * FROM articles), {D.R}, g AS ({grams_sql(2)} UNION ALL {grams_sql(3)}), f AS (SELECT doc_id, n, gram, count(*) AS frequency, min(pos) AS first_pos FROM g GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, n, first_pos) AS rk FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, n, first_pos) <= 35), fs AS (SELECT doc_id, lower({D.plain('text')}) AS low, {D.sentences('text')} AS ss FROM articles), ph AS ({PHRASE_ROWS})"
LITERAL = "contains(marked, regexp_replace(gram, '\\b', chr(1), 'g'))"
COLLOCATIONS = f"""{FX_GRAMS}, fm AS (SELECT doc_id, ss, regexp_replace(lower({D.plain('array_to_string(ss, chr(10))')}), '\\b', chr(1), 'g') AS marked FROM fs), kw AS (SELECT k.*, ss FROM k JOIN fm USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM ph WHERE ph.doc_id = k.doc_id AND expression = gram) AND (frequency >= 4 OR (len(gram) >= 10 AND {LITERAL}))),
sx AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS pos FROM fs), sc AS (SELECT *, ' ' || array_to_string({D.content('sentence')}, ' ') || ' ' AS toks FROM sx),
ke AS (SELECT kw.doc_id, gram, min_by(sentence, pos) AS example_sentence FROM kw JOIN sc ON sc.doc_id = kw.doc_id AND contains(toks, ' ' || gram || ' ') GROUP BY kw.doc_id, gram),
ca AS (SELECT doc_id, expression, frequency, type, 5 AS importance, meaning, example_sentence, 0 AS kind, o AS n, 0 AS first_pos FROM ph JOIN (VALUES {", ".join(f"({D.quoted(n)}, {i})" for i, (n, *_) in enumerate(L.PHRASES))}) v(e, o) ON e = expression UNION ALL SELECT kw.doc_id, gram, frequency, n || '-gram', least(5, 1 + frequency), '', coalesce(example_sentence, ''), 1, rk, first_pos FROM kw LEFT JOIN ke USING (doc_id, gram)),
co AS (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, importance DESC, kind, n) <= 35)"""


@query(f"WITH {COLLOCATIONS} SELECT doc_id, expression, frequency, type, importance, meaning, example_sentence FROM co")
def collocations(spark, d):
    return analyze.collocations(corpus(spark, d), 35).select("doc_id", "expression", "frequency", "type", "importance", "meaning", "example_sentence")


@query(f"WITH {COLLOCATIONS} SELECT expression, type, sum(frequency)::BIGINT AS frequency, max(importance) AS importance, count(DISTINCT co.doc_id) AS article_count, max(meaning) AS meaning, min(example_sentence) AS example_sentence, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, CASE WHEN max(meaning) <> '' THEN 3 WHEN type = '3-gram' THEN 2 ELSE 1 END AS class, len(string_split(expression, ' ')) AS n_words, len(expression) AS n_chars FROM co JOIN articles USING (doc_id) GROUP BY expression, type")
def aggregate_collocations(spark, d):
    docs = corpus(spark, d)
    return aggregate.collocations(analyze.collocations(docs), docs)


@query(f"""WITH {FXS}, {PATTERNS}, {SENSE_ROWS}, pn AS (SELECT doc_id, count(*) AS p FROM pr GROUP BY doc_id), qn AS (SELECT doc_id, count(*) AS q FROM sr GROUP BY doc_id),
tw AS (SELECT doc_id, unnest(list_distinct({D.content('text')})) AS word FROM articles), tn AS (SELECT doc_id, count(*) AS t FROM tw WHERE list_contains({D.listing(sorted({w for ws in L.DOMAINS.values() for w in ws}))}, word) GROUP BY doc_id)
SELECT a.doc_id, {D.rounded('least(3::DOUBLE + least(coalesce(t, 0), 10) * 0.25::DOUBLE + least(coalesce(q, 0), 10) * 0.35::DOUBLE + least(coalesce(p, 0), 10) * 0.2::DOUBLE, 10::DOUBLE)', 1)} AS exam_value FROM articles a LEFT JOIN pn USING (doc_id) LEFT JOIN qn USING (doc_id) LEFT JOIN tn USING (doc_id)""")
def exam_value(spark, d):
    """Domain terms here: distinct keywords of any domain."""
    docs = corpus(spark, d)
    keys = sorted({w for ws in L.DOMAINS.values() for w in ws})
    terms = docs.select("doc_id", F.size(F.filter(F.array_distinct(T.content_tokens(F.col("text"))), analyze.member(keys))).alias("domain_terms"))
    p = analyze.pattern_rows(docs).groupBy("doc_id").agg(F.count("*").alias("patterns"))
    q = analyze.sense_rows(docs).groupBy("doc_id").agg(F.count("*").alias("senses"))
    return analyze.exam_value(terms.join(p, "doc_id", "left").join(q, "doc_id", "left"))


@query(f"SELECT doc_id, substr(sha1(source || chr(10) || lang || chr(10) || left(text, 500)), 1, 16) AS id FROM documents")
def stable_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.stable_id(F.col("source"), F.col("lang"), F.col("text")).alias("id"))


@query(f"SELECT doc_id, {D.squeezed('text')} AS clean, len({D.words('text')}) AS n_words FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.squeezed(F.col("text")).alias("clean"), F.size(T.words_by_space(F.col("text"))).alias("n_words"))


@query(f"WITH t AS (SELECT doc_id, {D.squeezed('text')} AS x FROM documents) SELECT doc_id, CASE WHEN len(x) <= 600 THEN x ELSE left(x, 330) || chr(10) || '...' || chr(10) || substr(x, (greatest((len(x) - 120) // 2, 0) + 1)::BIGINT, 120) || chr(10) || '...' || chr(10) || right(x, 150) END AS compact, CASE WHEN len(x) <= 80 THEN x ELSE rtrim(left(x, 79)) || '…' END AS short FROM t")
def compact_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.head_middle_tail(F.col("text"), 600).alias("compact"), T.shortened(F.col("text"), 80).alias("short"))


# ---- rules one by one: sentences of our own with the outcome written out, not taken from the rules
