"""Files as a source: recursive discovery, format by content, content-addressed keys, HTML units."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported suffixes, and the member that tells each zip format.
SUFFIXES = {".pdf": "PDF", ".docx": "DOCX", ".xlsx": "XLSX", ".pptx": "PPTX"}
MEMBERS = {"word/document.xml": "DOCX", "xl/workbook.xml": "XLSX", "ppt/presentation.xml": "PPTX"}


def discover(spark: SparkSession, root: str) -> DataFrame:
    """All supported files below root, without lock files: path, length, modificationTime, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(name).rlike(r"\.(pdf|docx|xlsx|pptx)$") & ~name.startswith("~$"))


def _archive_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"parts": pa.list_(pa.string()), "unpacked": pa.int64()}
    for b in batches:
        at = b.schema.get_field_index("content")
        parts, unpacked = [], []
        for content in b.column(at):
            listed = _central_directory(content.as_py())
            parts.append(None if listed is None else [m.filename for m in listed])
            unpacked.append(None if listed is None else sum(m.file_size for m in listed))
        rest = [i for i in range(b.num_columns) if i != at]
        made = [pa.array(v, k) for v, k in zip((parts, unpacked), kinds.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), *made], [*(b.schema.field(i).name for i in rest), *kinds])


def _central_directory(content: bytes | None) -> list[zipfile.ZipInfo] | None:
    """The members that a zip container lists, none of them unpacked; None where it cannot be read."""
    if content is None:
        return None
    try:
        return zipfile.ZipFile(io.BytesIO(content)).infolist()
    except (zipfile.BadZipFile, OSError):
        return None


def archive_facts(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, parts, unpacked): names and declared size of the members of a zip container, null where it is none.

    Only central directories are read, in Arrow batches; one scan, no shuffle. Null or empty content gives nulls,
    repeated rows stay, an empty table gives an empty table, further columns are dropped.
    """
    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "content").mapInArrow(_archive_facts, f"{key} {kind}, parts array<string>, unpacked long")


def detect_formats(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, format) by content: the PDF mark in the JVM, members of zip containers in Arrow batches."""
    pdf = F.coalesce(F.substring("content", 1, 5) == F.lit(b"%PDF-"), F.lit(False))
    lower = F.transform("parts", F.lower)
    kind = F.coalesce(*(F.when(F.array_contains(lower, member), label) for member, label in MEMBERS.items()))
    zips = archive_facts(files.where(~pdf & (F.substring("content", 1, 4) == F.lit(b"PK\x03\x04"))), key)
    rest = files.where(~pdf & ~F.coalesce(F.substring("content", 1, 4) == F.lit(b"PK\x03\x04"), F.lit(False)))
    none = F.lit(None).cast("string").alias("format")
    return files.where(pdf).select(key, F.lit("PDF").alias("format")).unionByName(zips.select(key, kind.alias("format"))).unionByName(rest.select(key, none))


def storage_key(content: Column, suffix: Column) -> Column:
    """Where raw content is kept: its digest and suffix."""
    return F.concat(F.sha2(content, 256), F.lower(suffix))


def html_units(pages: DataFrame) -> DataFrame:
    """Headings of pages with their level: (page_id, place, level, heading)."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<h[1-6][^>]*>.*?</h[1-6]>)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("place", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.select("page_id", "place", F.regexp_extract("raw", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), text.alias("heading"))
