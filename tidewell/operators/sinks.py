"""Sinks: landing, artifacts, vectors written back, audit, reports (rows replaced by key: `versioned`). Each writes Parquet or JSON below a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.lifecycle import first_occurrences


def land(files: DataFrame, folder: str, now: Column) -> None:
    """Appends files(doc_id, owner_id, classification, sha256) as QUARANTINED documents, and a pending SCAN job for each."""
    files.withColumns({"status": F.lit("QUARANTINED"), "created_at": now}).write.mode("append").parquet(f"{folder}/documents")
    files.select("doc_id", F.lit("SCAN").alias("stage"), F.lit("PENDING").alias("status"), now.alias("scheduled_at")).write.mode("append").parquet(f"{folder}/jobs")


def write_artifacts(docs: DataFrame, folder: str, kind: str, key: str = "doc_id") -> None:
    """A JSON artifact (all columns) for each document below folder/kind; a second run replaces the first."""
    rows = docs.select(F.col(key), F.to_json(F.struct(*docs.columns)).alias("artifact"))
    rows.write.mode("overwrite").parquet(f"{folder}/{kind}")


def write_vectors(chunks: DataFrame, vectors: DataFrame, folder: str, key: str = "doc_id", width: int | None = None) -> None:
    """Passages with their vector (null where there is none, or where it has not the table's width), as a new version of the table."""
    fit = vectors if width is None else vectors.where(F.size("embedding") == width)
    chunks.drop("embedding").join(fit.select(key, "embedding"), key, "left").write.mode("errorifexists").parquet(folder)


def append_audit(old: DataFrame, fresh: DataFrame, folder: str, key: str, repeatable: tuple = ()) -> None:
    """Appends those events of fresh whose kind the key has not had yet; repeatable kinds in full. A null key is a key of its own."""
    once = first_occurrences(fresh, key, repeatable).join(fresh.drop(key, "event_type"), "event_id")
    seen = old.where(~F.col("event_type").isin(*repeatable)).select(F.col(key).alias("seen key"), F.col("event_type").alias("seen type")).distinct()
    once.join(seen, F.col(key).eqNullSafe(F.col("seen key")) & (F.col("event_type") == F.col("seen type")), "left_anti").write.mode("append").parquet(folder)


def write_report(rows: DataFrame, folder: str) -> None:
    """A report (a few rows) as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(folder)
