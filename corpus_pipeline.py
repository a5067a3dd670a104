"""The pipeline over documents: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet to
the shared work folder and read again as the next one's docs. All but the last return the columns of documents.

Edge cases: null texts and texts without a letter go in the first stage, as no language can be told; empty tables give an
empty result; very long texts, repeated rows, null ids and further columns are handled as each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.llm.common import discard, materialize
from glossa.llm.decontam import stage_decontaminate
from glossa.llm.langid import stage_language
from glossa.llm.linededup import stage_lines
from glossa.llm.neardup import stage_near_duplicates
from glossa.llm.packing import stage_packing

STAGES = [
    ("language_id", stage_language),
    ("line_dedup", stage_lines),
    ("near_dedup", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("pack", stage_packing),
]

#: No SQL: the stages train models, hash and tokenize. tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        done = materialize(stage(spark, docs, sf_dir), name)
        if i:
            discard(docs)
        docs = done
    return docs
