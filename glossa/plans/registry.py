"""Queries by name with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import spread

#: tables whose rows take much work each
TEXTS = ["documents", "pages", "conversations"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with DuckDB SQL over the same tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *, even: bool = True) -> DataFrame:
    """even: rows with much work are dealt to all cores; not wanted where a step deals them out itself."""
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(out) if even and name in TEXTS else out
