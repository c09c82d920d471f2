"""Structured Streaming in place of a polled queue: stages by micro-batch, windows and sessions by watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """events as a file stream from a table's path (one file or a folder of part files), or from the files or folders `glob` names below path.

    The schema is read once from the files, times without a zone are read as the session's.
    """
    at = f"{path}/{glob}" if glob else path.rstrip("/")
    # as a pattern (its last letter as a class), since a plain stream path must be a folder
    pattern = at if any(c in at for c in "*?[{") else f"{at[:-1]}[{at[-1]}]"
    rows = spark.readStream.schema(spark.read.parquet(at).schema).parquet(pattern)
    return rows.select(*(F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in rows.dtypes))


def batch_events(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """The same rows as a table."""
    rows = spark.read.parquet(f"{path}/{glob}")
    return rows.select(*(F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in rows.dtypes))


def still_open(grouped: DataFrame, rows: DataFrame, end: str, late: str) -> DataFrame:
    """Of windows or sessions over a finished input those that its last watermark has not closed: a stream has not told them."""
    closed = rows.agg((F.max("ts") - F.expr(f"interval {late}")).alias("watermark"))
    return grouped.join(F.broadcast(closed), F.date_trunc("millisecond", F.col(end)) > F.date_trunc("millisecond", "watermark")).drop("watermark")


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and value sums by event type and window; events later than `late` behind the newest are left out."""
    w = F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, shared: str, mode: str = "append") -> str:
    """Run a stream over what is there and stop; returns the folder of its output. Sinks and checkpoints are in the shared folder."""
    base = f"{shared}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return f"{base}/out"


def stage_stream(source: DataFrame, stage, target: str, state: str, key: str):
    """Apply a stage to each micro-batch and append its rows; a batch that is tried again replaces its own rows (one folder a batch)."""

    def batch(rows: DataFrame, number: int) -> None:
        stage(rows.dropDuplicates([key])).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Sessions of a key, that a pause of `gap` ends: (key, began, ended, events), told once the watermark has passed their end."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("events"))
    return grouped.select(key, F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "events")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events whose keys have not been seen within the watermark: a retried delivery is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
