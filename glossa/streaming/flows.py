"""Streaming counterparts: reading progress, articles arriving in a folder. Extensions of the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.store import Store


def progress(events: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Furthest and last progress of each user and item, from events ts, user_id, item, progress (update mode)."""
    ts = F.col("ts").cast("timestamp")  # watermarks need a time zone
    return events.withColumn("ts", ts).withWatermark("ts", late).groupBy("user_id", "item").agg(F.max("progress").alias("progress"), F.max("ts").alias("last_read_at"))


def hourly(events: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Events by hour and type; a window is final once the watermark has passed it (append mode)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))


def new_articles(landing: DataFrame, *, late: str = "7 days") -> DataFrame:
    """Articles (url, text, arrived) whose url has not been seen within the watermark, with their words counted."""
    once = landing.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["url"])
    return once.withColumn("n_tokens", F.size(T.tokens(F.col("text"))))


def store_batches(stream: DataFrame, store: Store, table: str, key: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is merged into the buckets of a stored table that it touches; a repeated batch gives the same table."""

    def merge(batch: DataFrame, _: int) -> None:
        store.merge(table, batch, key)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def run_to_memory(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that is available now, into a table of the session's memory: for tests and small results only.

    State is kept below spark.checkpoint.dir where that is set.
    """
    spark: SparkSession = stream.sparkSession
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if root := spark.conf.get("spark.checkpoint.dir", None):
        writer = writer.option("checkpointLocation", f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}")
    query = writer.start()
    query.awaitTermination()
    return spark.table(name)
