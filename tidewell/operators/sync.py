"""Keeping a corpus in step with an outside folder: tiers, diff, decisions, versions, schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.access import stricter
from tidewell.sources.shared import stored

RETRY_SECONDS = 3600
FAILED = ("VALIDATION_FAILED", "REJECTED", "EXTRACTION_FAILED", "NORMALIZATION_FAILED", "CHUNKING_FAILED", "EMBEDDING_FAILED")


def folder_tiers(folders: DataFrame, roots: DataFrame, depth: int = 10) -> DataFrame:
    """folders(folder, parent), roots(folder, tier) -> (folder, tier): tiers go down the tree, the stricter wins where they meet.

    One join a level, `depth` at most, each written; a folder goes on to the next level only where it is new or its
    tier got stricter, so cycles end. Null folders and parents lead nowhere.
    """
    strict = F.max(F.col("tier") == "RESTRICTED").alias("strict")
    known = front = stored(roots.where("folder is not null").groupBy("folder").agg(strict), "tiers")
    for _ in range(depth):
        below = folders.join(front.withColumnRenamed("folder", "parent"), "parent").where("folder is not null").groupBy("folder").agg(F.max("strict").alias("strict"))
        met = below.join(known.withColumnRenamed("strict", "before"), "folder", "left")
        front = stored(met.where(F.col("before").isNull() | (F.col("strict") & ~F.col("before"))).select("folder", "strict"), "tiers")
        if front.isEmpty():
            break
        known = stored(known.unionByName(front).groupBy("folder").agg(F.max("strict").alias("strict")), "tiers")
    return known.select("folder", F.when(F.col("strict"), "RESTRICTED").otherwise("PUBLIC").alias("tier"))


def content_changed(old_md5: Column, new_md5: Column, old_time: Column, new_time: Column) -> Column:
    return F.when(old_md5.isNotNull() & new_md5.isNotNull(), old_md5 != new_md5).otherwise(~old_time.eqNullSafe(new_time))


def diff(known: DataFrame, listing: DataFrame, partial: bool = False) -> DataFrame:
    """(file_id, action, tier) from what is known and what is listed now.

    known(file_id, md5, modified, state, tier), listing(file_id, md5, modified, tier, size, reason). Files that are no
    longer listed are removed, unless the listing is partial.
    """
    a, b = known.select(*(F.col(c).alias(f"old_{c}") if c != "file_id" else F.col(c) for c in known.columns)), listing
    rows = a.join(b.withColumn("listed", F.lit(True)), "file_id", "full_outer")
    had = F.col("old_state").isin("IMPORTED", "REMOVED")
    changed = content_changed(F.col("old_md5"), F.col("md5"), F.col("old_modified"), F.col("modified"))
    gone = F.col("listed").isNull()
    action = (
        F.when(gone & (F.lit(partial) | (F.col("old_state") != "IMPORTED")), "KEEP")
        .when(gone, "REMOVE")
        .when(had & ~changed & (F.col("old_state") == "REMOVED"), "RESTORE")
        .when(had & ~changed & ~F.col("old_tier").eqNullSafe(F.col("tier")), "RECLASSIFY")
        .when(had & ~changed, "UNCHANGED")
        .when(F.col("reason").isNotNull(), "SKIP")
        .when(F.col("size") > 100 * 1024 * 1024, "SKIP")
        .when(had & (F.col("old_state") == "IMPORTED"), "EDIT")
        .otherwise("IMPORT")
    )
    edited = F.when(F.col("old_tier").eqNullSafe(F.col("tier")), stricter(F.col("old_tier"), F.col("tier"))).otherwise(F.col("tier"))
    return rows.select("file_id", action.alias("action"), F.when(gone, F.col("old_tier")).when(action == "EDIT", edited).otherwise(F.col("tier")).alias("tier"))


def reconcile(versions: DataFrame) -> DataFrame:
    """versions(file_id, document_id, imported_at, state, status) -> plus new_state.

    Pending versions settle as DUPLICATE or FAILED; a newest version that is LIVE becomes CURRENT and retires the
    current and pending ones before it; until then nothing is retired. The newest is an aggregate (combined before the
    shuffle) joined back, so a file with very many versions is split by adaptive skew joins. Rows without a file only
    settle; repeated rows of the newest version are all the newest.
    """
    settled = F.when((F.col("state") == "PENDING") & (F.col("status") == "DUPLICATE"), "DUPLICATE").when((F.col("state") == "PENDING") & F.col("status").isin(*FAILED), "FAILED").otherwise(F.col("state"))
    rows = versions.withColumn("settled", settled)
    last = rows.where("file_id is not null").groupBy("file_id").agg(F.max(F.struct("imported_at", "document_id", "settled", "status")).alias("last"))
    live = last.where("last.settled = 'PENDING' and last.status = 'LIVE'").select("file_id", "last.imported_at", "last.document_id")
    rows = rows.join(live.select("file_id", F.struct("imported_at", "document_id").alias("current")), "file_id", "left")
    same = F.col("current").eqNullSafe(F.struct("imported_at", "document_id"))
    new = F.when(F.col("current").isNull(), F.col("settled")).when(same, "CURRENT").when(F.col("settled").isin("CURRENT", "PENDING"), "SUPERSEDED").otherwise(F.col("settled"))
    return rows.select("file_id", "document_id", "state", "status", new.alias("new_state"))


def next_run(now: Column, last_success: Column, last_attempt: Column, last_failed: Column, hour: int, minute: int, zone: str) -> Column:
    """When to sync next: after a failure RETRY_SECONDS later; never synced, now; else the next local HH:MM after the last success."""
    local = F.from_utc_timestamp(last_success, zone)
    slot = F.date_trunc("day", local) + F.expr(f"interval {hour} hours {minute} minutes")
    slot = F.when(slot <= local, slot + F.expr("interval 1 day")).otherwise(slot)
    return F.when(last_failed & last_attempt.isNotNull(), last_attempt + F.expr(f"interval {RETRY_SECONDS} seconds")).when(last_success.isNull(), now).otherwise(F.to_utc_timestamp(slot, zone))
