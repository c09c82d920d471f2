"""Decisions about documents, as columns: who may change what, and what a change does to the rows around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.joins import small_side
from tidewell.functions.text import terms
from tidewell.operators.access import visible
from tidewell.operators.lifecycle import INACTIVE, latest_event


def _owner(owner: Column, viewer: Column, admin: Column) -> Column:
    return admin | F.coalesce(owner == viewer, F.lit(False))


def reclassify_decision(docs: DataFrame, viewer: Column, admin: Column, tier: Column) -> Column:
    """404 unseen, 403 not the owner's to change, 410 erased, 409 no change, else 200."""
    seen = visible(F.col("classification"), F.col("owner_id"), viewer, admin)
    return (
        F.when(~seen, 404).when(~_owner(F.col("owner_id"), viewer, admin), 403).when(F.col("purged_at").isNotNull(), 410)
        .when(F.col("classification").eqNullSafe(tier), 409).otherwise(200)
    )


def delete_decision(docs: DataFrame, viewer: Column, admin: Column, busy: Column) -> Column:
    """404 unseen or erased, 403 not the owner's, 409 while a job runs, else 200."""
    seen = visible(F.col("classification"), F.col("owner_id"), viewer, admin)
    return F.when(~seen, 404).when(~_owner(F.col("owner_id"), viewer, admin), 403).when(F.col("purged_at").isNotNull(), 404).when(busy, 409).otherwise(200)


def restore_decision(docs: DataFrame, viewer: Column, admin: Column, outside: Column) -> Column:
    """404 unseen, 403 not the owner's, 410 erased, 409 not deleted, superseded, or gone from the outside folder, else 200."""
    seen = visible(F.col("classification"), F.col("owner_id"), viewer, admin)
    return (
        F.when(~seen, 404).when(~_owner(F.col("owner_id"), viewer, admin), 403).when(F.col("purged_at").isNotNull(), 410)
        .when(F.col("deleted_at").isNull() | (F.col("status") == "SUPERSEDED") | outside, 409).otherwise(200)
    )


def erase(docs: DataFrame, chunks: DataFrame, jobs: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, jobs) after erasing asked(doc_id).

    A document with a running job stays. Erased ones become tombstones without content fields, as do refused copies
    of them; their passages go, their pending jobs fail.
    """
    busy = jobs.where("status = 'RUNNING'").select("doc_id").distinct()
    going = asked.select("doc_id").distinct().join(busy, "doc_id", "left_anti").join(docs.where("purged_at is null").select("doc_id", "sha256"), "doc_id")
    digests = going.where("sha256 is not null").select("sha256", F.lit(True).alias("copy")).distinct()
    marked = docs.join(going.select("doc_id", F.lit(True).alias("gone")), "doc_id", "left").join(digests, "sha256", "left")
    hit = F.coalesce("gone", F.lit(False)) | (F.coalesce("copy", F.lit(False)) & (F.col("status") == "DUPLICATE"))
    after = marked.withColumn("hit", hit).select(
        "doc_id", "status", "owner_id", "classification",
        F.when(~F.col("hit"), F.col("sha256")).alias("sha256"),
        F.when(F.col("hit"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at")).alias("deleted_at"),
        F.when(F.col("hit"), now).otherwise(F.col("purged_at")).alias("purged_at"),
    )
    left = chunks.join(going.select("doc_id"), "doc_id", "left_anti")
    failed = jobs.join(going.select("doc_id", F.lit(True).alias("gone")), "doc_id", "left")
    failed = failed.withColumn("status", F.when(F.coalesce("gone", F.lit(False)) & (F.col("status") == "PENDING"), "FAILED").otherwise(F.col("status"))).drop("gone")
    return after, left, failed


def document_status(docs: DataFrame, audit: DataFrame) -> DataFrame:
    """Each document with its newest event and, for a refused copy, the active document of the same content."""
    return with_status(docs, latest_event(audit, "doc_id"))


def with_status(docs: DataFrame, newest: DataFrame) -> DataFrame:
    """document_status where the newest events (doc_id, event_id, event_type) are known."""
    newest = newest.select("doc_id", F.col("event_type").alias("last_event"), "event_id")
    canonical = docs.where(~F.col("status").isin(*INACTIVE) & F.col("sha256").isNotNull()).groupBy("sha256").agg(F.min("doc_id").alias("active_id"))
    rows = docs.join(newest, "doc_id", "left").join(canonical, "sha256", "left")
    return rows.select("doc_id", "status", "last_event", "event_id", F.when(F.col("status") == "DUPLICATE", F.col("active_id")).alias("duplicate_of"))


def replace_chunks(stored: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stored passages with those of every document in fresh replaced by the fresh ones."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def flips(old: DataFrame, new: DataFrame, key: str, flag: str) -> DataFrame:
    """How many rows a re-run turned one way and the other: (flag before, flag after, n)."""
    both = old.select(key, F.col(flag).alias("before")).join(new.select(key, F.col(flag).alias("after")), key)
    return both.groupBy("before", "after").agg(F.count("*").alias("n"))


def search_documents(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(question_id, doc_id, rank): documents that hold every term of the question in title, name or description.

    A term weighs 1.0 in the title, 0.4 in the name (its punctuation read as blanks), 0.2 in the description; terms
    are compared as words, not stemmed. Only question terms are exploded into the join.
    """
    wanted = asked.select("question_id", F.array_distinct(terms(F.col("question"))).alias("ts")).where(F.size("ts") > 0)
    want = wanted.select("question_id", F.size("ts").alias("n"), F.explode("ts").alias("term"))
    vocabulary = small_side(want.select("term").distinct())
    parts = None
    for field, weight in (("title", 1.0), ("filename", 0.4), ("description", 0.2)):
        hit = docs.select("doc_id", F.explode_outer(F.array_distinct(terms(F.col(field)))).alias("term")).join(vocabulary, "term", "left_semi").withColumn("w", F.lit(weight))
        parts = hit if parts is None else parts.unionByName(hit)
    per = parts.groupBy("doc_id", "term").agg(F.sum("w").alias("w"))
    found = want.join(per, "term").groupBy("question_id", "doc_id", "n").agg(F.count("*").alias("m"), F.round(F.sum("w"), 6).alias("rank"))
    return found.where("m = n").select("question_id", "doc_id", "rank")
