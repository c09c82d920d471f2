"""Listings and checks: passages of a document, pending files, owners, formats, tables' rules, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a page of a listing holds at most, how documents of an office suite are exported, and what is not.
PAGE_MOST = {"documents": 200, "chunks": 1000, "deleted": 500}
EXPORTS = {
    "application/vnd.google-apps.document": "docx",
    "application/vnd.google-apps.spreadsheet": "xlsx",
    "application/vnd.google-apps.presentation": "pptx",
}
NO_EXPORT = {
    "application/vnd.google-apps.folder": "a folder",
    "application/vnd.google-apps.form": "a form",
    "application/vnd.google-apps.shortcut": "a shortcut",
}
TRANSIENT = ("StorageError", "OperationalError", "TimeoutError", "ConnectionError")


def page_size(asked: int, kind: str) -> int:
    return min(PAGE_MOST[kind], max(1, asked))


def chunk_listing(chunks: DataFrame, embedded: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of each document's passages by chunk_index, with whether they have a vector (a page is the feature).

    Chunk numbers have no gaps, so a page is a range of them: a filter, no sort.
    """
    first, last = offset, offset + page_size(limit, "chunks")
    rows = chunks.where((F.col("chunk_index") >= first) & (F.col("chunk_index") < last))
    return rows.join(embedded.select("doc_id", F.lit(True).alias("embedded")).distinct(), "doc_id", "left").withColumn("embedded", F.coalesce("embedded", F.lit(False)))


def pending_files(versions: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, name, pending): files that have pending versions, and how many."""
    per = versions.where("state = 'PENDING'").groupBy("file_id").agg(F.count("*").alias("pending"))
    return per.join(files.select("file_id", "name"), "file_id")


def with_owner(docs: DataFrame, users: DataFrame) -> DataFrame:
    """docs plus the owner's email, null for owners that are gone."""
    return docs.join(users.select(F.col("user_id").alias("owner_id"), "email"), "owner_id", "left")


def export_format(mime: Column) -> tuple[Column, Column]:
    """(suffix to export to, why not): null and null for a file that is taken as it is."""
    lookup = lambda table: F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), mime)
    other = F.startswith(mime, F.lit("application/vnd.google-apps."))
    suffix = lookup(EXPORTS)
    return suffix, F.when(suffix.isNull(), F.coalesce(lookup(NO_EXPORT), F.when(other, "no export")))


def is_transient(error: Column) -> Column:
    """Whether an error of this class is worth another try."""
    return F.coalesce(error, F.lit("")).isin(*TRANSIENT)


def broken_rules(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks; a rule that is null is broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def tally(rows: DataFrame, kind: str, passed: Column) -> DataFrame:
    """Per kind: cases and passes."""
    return rows.groupBy(kind).agg(F.count("*").alias("cases"), F.count_if(passed).alias("passed"))
