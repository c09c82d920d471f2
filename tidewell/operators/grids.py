"""Tables as arrays of rows: cells, headers, captions, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.chunking import MAXIMUM, cell_text, row_groups


def number_cell(value: Column, number_format: Column | None = None) -> Column:
    """A number as a reader sees it: whole numbers without a fraction, percentages with four figures at most."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    plain = F.when(whole, value.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.12f", value), r"\.?0+$", ""))
    if number_format is None:
        return F.when(value.isNull(), "").otherwise(plain)
    percent = F.concat(F.regexp_replace(F.format_string("%.2f", value * 100), r"\.?0+$", ""), F.lit("%"))
    return F.when(value.isNull(), "").when(F.contains(F.coalesce(number_format, F.lit("")), F.lit("%")), percent).otherwise(plain)


def date_cell(value: Column) -> Column:
    """A time as a date where it is midnight, else to the minute."""
    return F.when(value.isNull(), "").when(value == F.date_trunc("day", value), F.date_format(value, "yyyy-MM-dd")).otherwise(F.date_format(value, "yyyy-MM-dd HH:mm"))


def fill_down(cells: DataFrame, table: str, row: str, col: str, value: str, merge: str) -> DataFrame:
    """Cells (one row each) with the value of a vertical merge written into every row that it covers."""
    from pyspark.sql import Window

    first = F.first(value).over(Window.partitionBy(table, col, merge).orderBy(row))
    return cells.withColumn(value, F.when(F.col(merge).isNotNull() & (F.coalesce(value, F.lit("")) == ""), first).otherwise(F.col(value)))


def clean_rows(rows: Column) -> Column:
    """Rows of one-line cells, without rows that have no cells."""
    return F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: F.transform(r, lambda c: cell_text(c)))


def header_row(rows: Column) -> Column:
    """0-based place of the header: the first of three rows that is more than half as full as the fullest of twelve."""
    filled = F.transform(rows, lambda r: F.size(F.filter(r, lambda c: c != "")))
    widest = F.array_max(F.slice(filled, 1, 12))
    at = F.array_position(F.transform(F.slice(filled, 1, 3), lambda n: n * 2 > widest), F.lit(True))
    return F.when(at > 0, at.cast("int") - 1).otherwise(0)


def render_tables(tables: DataFrame, key: str, rows: str = "rows", maximum: int = MAXIMUM) -> DataFrame:
    """(key, group, rows, text): captions above the header, header repeated, whole rows in groups that fit."""
    t = tables.withColumn("clean", clean_rows(F.col(rows))).where(F.size("clean") > 0).withColumn("at", header_row(F.col("clean")))
    line = lambda r: F.array_join(r, " | ")
    caption = F.transform(F.slice(F.col("clean"), F.lit(1), F.col("at")), lambda r: F.array_join(F.filter(r, lambda c: c != ""), " "))
    header = F.array_join(F.concat(caption, F.array(line(F.get("clean", F.col("at"))))), "\n")
    body = F.transform(F.slice(F.col("clean"), F.col("at") + 2, F.size("clean")), line)
    t = t.select(key, header.alias("header"), body.alias("lines"))
    bare = t.where(F.size("lines") == 0).select(key, F.lit(0).alias("group"), F.lit(0).cast("long").alias("rows"), F.col("header").alias("text"))
    return row_groups(t.where(F.size("lines") > 0), key, "header", "lines", maximum).unionByName(bare)


def merge_headers(upper: Column, lower: Column) -> Column:
    """Two header rows as one of joined names; a name that repeats the one above is written once."""
    return F.zip_with(upper, lower, lambda a, b: F.trim(F.when(a == b, a).otherwise(F.concat_ws(" ", F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))))))


def flat_header(rows: Column, spans: Column) -> Column:
    """rows with a header of two or three rows turned into one row of joined names, in columns only.

    spans: for each cell the block (row, col, height, width) that covers it, null for a cell of its own. Blocks over
    the whole width at the top are titles and stay. Below them the header is as high as the highest block that starts
    there, two rows at least where a block covers some of the columns. Other heights, tables of which nothing would be
    left, null and empty tables stay as they are; a name that repeats the one above is written once.
    """
    height, width = F.size(rows), F.size(F.get(rows, F.lit(0)))
    left = lambda i: F.get(F.get(spans, i), F.lit(0))
    below = lambda at, i: F.when((at == i) & (width > 1) & (left(i)["width"] == width), left(i)["row"] + left(i)["height"]).otherwise(at)
    top = F.aggregate(F.sequence(F.lit(0), F.greatest(height - 1, F.lit(0))), F.lit(0), below)
    part = lambda b: F.when((b["width"] > 1) & (b["width"] < width), 2).otherwise(1)
    grown = lambda d, b, at: F.when(b["row"] == at, F.greatest(d, b["height"], part(b))).otherwise(d)
    depth = F.coalesce(F.aggregate(F.get(spans, top), F.lit(1), lambda d, b: grown(d, b, top)), F.lit(1))
    add = lambda names, cell: F.when((F.coalesce(cell, F.lit("")) == "") | F.coalesce(F.get(names, F.size(names) - 1) == cell, F.lit(False)), names).otherwise(F.array_append(names, cell))
    name = lambda c: F.array_join(F.aggregate(F.slice(rows, top + 1, depth), F.array().cast("array<string>"), lambda names, r: add(names, F.get(r, c))), " ")
    header = F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), name)
    joined = F.concat(F.slice(rows, F.lit(1), top), F.array(header), F.slice(rows, top + depth + 1, height))
    return F.when((depth > 1) & (depth <= 3) & (top + depth < height), joined).otherwise(rows)


def figure_text(caption: Column, text: Column) -> Column:
    """A picture's words as a passage that says where they come from."""
    label = F.concat_ws(" ", F.lit("[Figure] (text read from a picture by OCR)"), F.nullif(F.coalesce(caption, F.lit("")), F.lit("")))
    return F.when(F.coalesce(text, F.lit("")) == "", label).otherwise(F.concat(label, F.lit("\n"), text))


def place_in_section(items: DataFrame, headings: DataFrame, doc: str, unit: str) -> DataFrame:
    """items(doc, unit, heading?) plus section: their own heading; else the unit's only one; else none."""
    per = headings.groupBy(doc, unit).agg(F.count("*").alias("n"), F.first("text").alias("only"))
    rows = items.join(per, [doc, unit], "left")
    return rows.withColumn("section", F.coalesce("heading", F.when(F.col("n") == 1, F.col("only")))).drop("n", "only")


def drop_logos(pictures: DataFrame, doc: str, content: str, most: int = 40, repeats: int = 3) -> DataFrame:
    """Pictures of a document, equal ones once; those that occur `repeats` times or more are logos and go."""
    from pyspark.sql import Window

    digest = F.sha2(F.col(content), 256)
    rows = pictures.withColumn("digest", digest)
    w = Window.partitionBy(doc, "digest")
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("place"))).where((F.col("n") < repeats) & (F.col("k") == 1))
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(doc).orderBy("place"))).where(F.col("at") <= most).drop("n", "k", "at")
