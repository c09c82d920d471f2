"""Lifecycle as relational operators: validation, deduplication, tiers, versions, audit, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.files import MEMBERS

# States, limits and signatures.
INACTIVE = ("SUPERSEDED", "ARCHIVED", "REJECTED", "DUPLICATE")
MAX_BYTES, MAX_FILES, MAX_BATCH_BYTES = 100 * 1024 * 1024, 5, 250 * 1024 * 1024
MAX_PARTS, MAX_UNPACKED = 10_000, 500 * 1024 * 1024
PDF_MARK, PDF_END, OLE_MARK = b"%PDF-", b"%%EOF", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
TYPES_PART, MACRO_PART = "[content_types].xml", "vbaproject.bin"
SIGNATURES = ("/Launch", "/JavaScript", "powershell.exe", "cmd.exe", "EICAR-STANDARD-ANTIVIRUS-TEST-FILE!")
FAILED_STATUS = {"EXTRACT": "EXTRACTION_FAILED", "NORMALIZE": "NORMALIZATION_FAILED", "CHUNK": "CHUNKING_FAILED", "EMBED": "EMBEDDING_FAILED"}
STAGE_NEEDS = {"EXTRACT": "VALIDATED", "NORMALIZE": "EXTRACTED", "CHUNK": "AWAITING_CLASSIFICATION", "EMBED": "CHUNKED"}


def active(status: Column) -> Column:
    return ~status.isin(*INACTIVE)


def rejection(content: Column, size: Column, supported: Column, container: Column | None = None, structure: Column | None = None) -> Column:
    """The first rule that a file breaks, or null: size, type, container, threat, structure, in this order.

    container and structure are what container_fault and structure_fault say (null: nothing broken); without them the
    two steps are left out. Null content holds no threat.
    """
    threat = F.lit(False)
    for s in SIGNATURES:
        threat = threat | F.contains(content.cast("binary"), F.lit(s.encode()))
    none = F.lit(None).cast("string")
    early = F.when(size == 0, "EMPTY_FILE").when(size > MAX_BYTES, "FILE_TOO_LARGE").when(~supported, "INVALID_MIME_TYPE")
    scan = F.when(F.coalesce(threat, F.lit(False)), "MALICIOUS_THREAT_DETECTED")
    return F.coalesce(early, none if container is None else container, scan, none if structure is None else structure)


def container_fault(content: Column, fmt: Column, parts: Column) -> Column:
    """What is wrong with a file as the container of its declared format; parts: the members it lists (null: unreadable).

    A PDF starts with its mark and has its end mark in the last 1024 bytes; an Office file is a readable archive, not
    an encrypted or old compound file, that holds the list of content types. Names are compared without case.
    """
    tail = F.substring(content, -1024, 1024)
    marks = (F.substring(content, 1, len(PDF_MARK)) == F.lit(PDF_MARK)) & F.contains(F.when(F.length(content) < 1024, content).otherwise(tail), F.lit(PDF_END))
    typed = F.exists(parts, lambda p: F.lower(p) == TYPES_PART)
    office = F.when(F.substring(content, 1, len(OLE_MARK)) == F.lit(OLE_MARK), "ENCRYPTED_OOXML").when(~F.coalesce(typed, F.lit(False)), "CORRUPTED_OOXML_STRUCTURE")
    return F.when(fmt == "PDF", F.when(~F.coalesce(marks, F.lit(False)), "CORRUPTED_PDF_STRUCTURE")).otherwise(office)


def structure_fault(fmt: Column, parts: Column, unpacked: Column) -> Column:
    """What is wrong inside an Office file: too many members, too much when unpacked, macros, paths that leave the folder, another format.

    All of it is told from the list of members. A PDF's inside is left to a reader, of which there is none here.
    """
    path = lambda p: F.translate(p, "\\", "/")
    leaves = F.exists(parts, lambda p: path(p).startswith("/") | F.array_contains(F.split(path(p), "/"), "..") | (F.substring(path(p), 2, 1) == ":"))
    macros = F.exists(parts, lambda p: F.lower(F.element_at(F.split(p, "/"), -1)) == MACRO_PART)
    wanted = F.coalesce(*(F.when(fmt == kind, member) for member, kind in MEMBERS.items()))
    held = F.exists(parts, lambda p: F.lower(p) == wanted)
    office = (
        F.when(F.size(parts) > MAX_PARTS, "TOO_MANY_ARCHIVE_ENTRIES")
        .when(unpacked > MAX_UNPACKED, "ARCHIVE_TOO_LARGE")
        .when(macros, "MACRO_ENABLED_DOCUMENT")
        .when(leaves, "UNSAFE_ARCHIVE_ENTRY")
        .when(~F.coalesce(held, F.lit(False)), "CORRUPTED_OOXML_STRUCTURE")
    )
    return F.when(fmt != "PDF", office)


def dedup_canonical(docs: DataFrame, digest: str = "sha256") -> DataFrame:
    """docs plus canonical_id (the earliest active document of equal content) and is_duplicate.

    With a column status, only active documents can be canonical and only they can be duplicates; content without one
    has none. A document without a digest has nothing equal: it is its own canonical one. The earliest row is an
    aggregate (combined before the shuffle) joined back, so content with very many copies is split by adaptive skew
    joins rather than gathered in one window.
    """
    live = active(F.coalesce("status", F.lit(""))) if "status" in docs.columns else F.lit(True)
    known = docs.where(live & F.col(digest).isNotNull())
    first = known.groupBy(F.col(digest).alias("of digest")).agg(F.min(F.struct("created_at", "doc_id"))["doc_id"].alias("first id"))
    rows = docs.join(first, F.col(digest) == F.col("of digest"), "left")
    own = F.when(F.col(digest).isNull(), F.col("doc_id")).otherwise(F.col("first id"))
    duplicate = live & F.col("first id").isNotNull() & (F.col("doc_id") != F.col("first id"))
    return rows.select(*docs.columns, own.alias("canonical_id"), F.coalesce(duplicate, F.lit(False)).alias("is_duplicate"))


def escalate_tiers(docs: DataFrame, digest: str = "sha256") -> DataFrame:
    """(digest, canonical_id, copies, tier, escalated): a copy that is stricter than the first one raises it, never lowers it.

    Documents without a digest are copies of nothing; each is a row of its own. With a column status, the first one is
    the earliest active document; content without an active one has no row.
    """
    rank = F.when(F.col("classification") == "RESTRICTED", 1).when(F.col("classification") == "PUBLIC", 0)
    live = active(F.coalesce("status", F.lit(""))) if "status" in docs.columns else F.lit(True)
    alone = F.when(F.col(digest).isNull(), F.col("doc_id"))
    order = F.when(live, F.struct("created_at", "doc_id", "classification"))
    groups = docs.groupBy(digest, alone.alias("alone")).agg(F.min(order).alias("first"), F.max(rank).alias("most"), F.count("*").alias("copies")).where(F.col("first").isNotNull())
    tier = F.when(F.col("most") == 1, "RESTRICTED").when(F.col("most") == 0, "PUBLIC")
    return groups.select(digest, F.col("first.doc_id").alias("canonical_id"), "copies", tier.alias("tier"), (~tier.eqNullSafe(F.col("first.classification"))).alias("escalated"))


def version_chain(rows: DataFrame, key: str, order: list[str], item: str) -> DataFrame:
    """Successive items of a key as versions: version, supersedes, status."""
    w = Window.partitionBy(key).orderBy(*order)
    last = F.lead(item).over(w).isNull()
    return rows.select(key, item, F.row_number().over(w).alias("version"), F.lag(item).over(w).alias("supersedes"), F.when(last, "LIVE").otherwise("SUPERSEDED").alias("status"))


def top_of_each(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their place: Spark keeps k rows of a group in each task before it shuffles."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)


def latest_event(audit: DataFrame, key: str) -> DataFrame:
    """The newest event of each key, by time and id."""
    return audit.groupBy(key).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e")).select(key, "e.ts", "e.event_id", "e.event_type")


def first_occurrences(audit: DataFrame, key: str, repeatable: tuple = ()) -> DataFrame:
    """The audit as an append-only log keeps it: one event of each kind for a key, but repeatable kinds in full."""
    firsts = audit.where(~F.col("event_type").isin(*repeatable)).groupBy(key, "event_type").agg(F.min(F.struct("ts", "event_id")).alias("e")).select(key, "event_type", "e.event_id")
    return firsts.unionByName(audit.where(F.col("event_type").isin(*repeatable)).select(key, "event_type", "event_id"))


def backfill_candidates(docs: DataFrame, jobs: DataFrame, stage: str | None = None) -> DataFrame:
    """Documents that have no live job; with a stage, only those in the status that it takes up."""
    if stage is not None:
        docs = docs.where(F.col("status") == STAGE_NEEDS[stage])
    live = jobs.where(F.col("status").isin("PENDING", "RUNNING")).select("doc_id")
    return docs.join(live, "doc_id", "left_anti")


def stage_guard(status: Column) -> Column:
    """The stage that takes up a document of this status, null where none does."""
    stage = F.lit(None).cast("string")
    for name, needs in STAGE_NEEDS.items():
        stage = F.when(status == needs, name).otherwise(stage)
    return stage


def backfill_reset(docs: DataFrame, jobs: DataFrame, stage: str) -> DataFrame:
    """(doc_id, status, stage): failed documents of a stage without a live job, set back to the status that it takes up."""
    failed = docs.where(F.col("status") == FAILED_STATUS[stage])
    return backfill_candidates(failed, jobs).select("doc_id", F.lit(STAGE_NEEDS[stage]).alias("status"), F.lit(stage).alias("stage"))


def batch_check(files: DataFrame, batch: str) -> DataFrame:
    """Upload limits of each batch: files, bytes, and whether it is accepted."""
    sums = files.groupBy(batch).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.min("size").alias("smallest"))
    ok = (F.col("files") <= MAX_FILES) & (F.col("bytes") <= MAX_BATCH_BYTES) & (F.col("largest") <= MAX_BYTES) & (F.col("smallest") > 0)
    return sums.select(batch, "files", "bytes", ok.alias("accepted"))


def restorable(docs: DataFrame, viewer: Column, is_admin: Column) -> DataFrame:
    """Deleted documents, neither erased nor superseded nor duplicates, that their owner (or an admin) may bring back."""
    there = F.col("deleted_at").isNotNull() & F.col("purged_at").isNull() & ~F.col("status").isin("SUPERSEDED", "DUPLICATE")
    return docs.where(there & (is_admin | F.coalesce(F.col("owner_id") == viewer, F.lit(False))))
