"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, seconds a query (best of two after a warm-up)."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ["PYTHONPATH"] = f"{os.path.dirname(os.path.abspath(__file__))}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession

from glossa.plans.catalog import QUERIES

HEADLINE = [
    "token_frequency", "top_terms_per_doc", "bigram_counts", "trigram_counts", "ngram_topk_per_doc", "pmi_bigrams", "topic_queries", "sentence_split", "difficulty",
    "domain_scores", "quality_score", "best_example_sentence", "tier_match", "highlights", "review_vocabulary", "aggregate_vocabulary", "vocabulary_list", "merged_vocabulary",
    "review_classify", "domain_cap", "article_search", "article_page", "article_nested", "upsert_latest", "replace_by_key", "progress_last", "url_normalize", "anchor_discovery",
    "html_extract", "anki_cards", "stable_ids", "collocations", "article_highlights", "gloss_index", "dictionary_chain",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
