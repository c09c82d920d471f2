"""Structure from layout: headings by size, subject lines, words in cells, rows of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.shared import stored

# What makes a line a heading, and a word part of a cell.
HEADING_RATIO, HEADING_CHARS, SUBJECT_CHARS = 1.15, 120, 200
SUBJECT = r"(?i)^\s*(subject|sub)\s*[.:\-]+\s*\S"
WIDTH_SHARE, HEIGHT_SHARE, ROW_GAP = 0.8, 0.5, 2.0
#: Fixed values, in heights of a word: what parts rows, words of a row, and stacked pieces; how pieces line up.
SAME_ROW, WORD_GAP, STACK_GAP, OVERLAP, ALIGNED = 0.6, 2.0, 1.8, 0.3, 1.5


def infer_headings(lines: DataFrame, doc: str, text: str = "text", size: str = "size") -> DataFrame:
    """lines plus level (null: body): the body size carries most characters; sizes 1.15 times as large are levels, largest first."""
    rounded = F.round(F.col(size), 1)
    weights = lines.where(F.col(size) > 0).groupBy(doc, rounded.alias("s")).agg(F.sum(F.length(text)).alias("chars"))
    body = weights.groupBy(doc).agg(F.max(F.struct("chars", F.col("s").alias("s")))["s"].alias("body"))
    large = lines.join(body, doc).where(F.col(size) >= F.col("body") * HEADING_RATIO).select(doc, rounded.alias("s")).distinct()
    levels = large.withColumn("level", F.row_number().over(Window.partitionBy(doc).orderBy(F.col("s").desc())))
    return lines.withColumn("s", rounded).join(levels, [doc, "s"], "left").withColumn("level", F.when(F.length(text) <= HEADING_CHARS, F.col("level"))).drop("s")


def subject_lines(units: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, place, heading): subject lines of scanned units, without a word that the line breaks off."""
    rows = units.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("place", "raw")).withColumn("line", F.trim("raw"))
    rows = rows.where(F.col("line").rlike(SUBJECT) & (F.length("line") <= SUBJECT_CHARS))
    cut = F.regexp_replace("line", r"\s+\S*$", "")
    return rows.select(key, "place", F.when(F.col("line").endswith("-") & F.contains(F.col("line"), F.lit(" ")), cut).otherwise(F.col("line")).alias("heading"))


def words_in_cells(words: DataFrame, cells: DataFrame, page: str, grid: float) -> DataFrame:
    """(page, cell, text): words whose box lies in a cell by 80 % of its width and half its height, read line by line.

    An overlap join: words and cells meet through the grid squares they touch (an equal key), then by their boxes.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / grid).cast("int"), F.floor(F.col(hi) / grid).cast("int"))
    tiles = cells.select(page, "cell", "cx1", "cy1", "cx2", "cy2", F.explode(span("cx1", "cx2")).alias("gx")).withColumn("gy", F.explode(span("cy1", "cy2")))
    centre = words.withColumn("gx", F.floor((F.col("x1") + F.col("x2")) / 2 / grid).cast("int")).withColumn("gy", F.floor((F.col("y1") + F.col("y2")) / 2 / grid).cast("int"))
    both = centre.join(tiles, [page, "gx", "gy"])
    wide = F.least("x2", "cx2") - F.greatest("x1", "cx1")
    high = F.least("y2", "cy2") - F.greatest("y1", "cy1")
    inside = both.where((wide >= WIDTH_SHARE * (F.col("x2") - F.col("x1"))) & (high >= HEIGHT_SHARE * (F.col("y2") - F.col("y1"))))
    return inside.groupBy(page, "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "word"))), lambda s: s["word"]), " ").alias("text"))


def rows_of_words(words: DataFrame, page: str) -> DataFrame:
    """words plus row: a new row starts where the vertical gap exceeds twice the median height (gaps and islands)."""
    w = Window.partitionBy(page).orderBy("y1", "x1")
    height = F.percentile(F.col("y2") - F.col("y1"), 0.5).over(Window.partitionBy(page))
    gap = F.col("y1") - F.max("y2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("starts", F.coalesce(gap > ROW_GAP * height, F.lit(True)).cast("int")).withColumn("row", F.sum("starts").over(w)).drop("starts")


def pieces_of_words(words: DataFrame, page: str) -> DataFrame:
    """words(page, word, x1, y1, x2, y2) -> (page, row, piece, text, left, right, cy, h): words of one row without a wide gap between them.

    A row ends where the centres of the next words are 0.6 heights lower; a piece, where no word so far reaches
    within 2 heights of the next. Heights are the page's median. Windows hold the words of one page, or of one row.
    """
    down, across = Window.partitionBy(page).orderBy("cy", "x1", "word"), Window.partitionBy(page, "row").orderBy("x1", "x2", "word")
    rows = words.withColumn("cy", (F.col("y1") + F.col("y2")) / 2).withColumn("h", F.percentile(F.col("y2") - F.col("y1"), 0.5).over(Window.partitionBy(page)))
    below = F.col("cy") - F.lag("cy").over(down) > SAME_ROW * F.col("h")
    rows = rows.withColumn("starts", F.coalesce(below, F.lit(True)).cast("int")).withColumn("row", F.sum("starts").over(down))
    apart = F.col("x1") - F.max("x2").over(across.rowsBetween(Window.unboundedPreceding, -1)) > WORD_GAP * F.col("h")
    rows = rows.withColumn("starts", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("piece", F.sum("starts").over(across))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "x2", "word"))), lambda s: s["word"]), " ")
    return rows.groupBy(page, "row", "piece").agg(text.alias("text"), F.min("x1").alias("left"), F.max("x2").alias("right"), F.round(F.avg("cy"), 6).alias("cy"), F.first("h").alias("h"))


def text_blocks(words: DataFrame, page: str) -> DataFrame:
    """(page, block, pieces, text): pieces that stand under one another and line up, a line for each, as one block.

    A piece hangs on the nearest piece above it within 1.8 heights that it overlaps by a third of the narrower one, or
    lines up with on the left (of equally near ones the leftmost). What hangs together is a block, found by doubling:
    in each round a piece looks where the piece it hangs on hangs, so rounds grow with the logarithm of the tallest
    block. Pieces meet through bands of their height (an equal key). Blocks are numbered by their top piece.
    """
    band = F.floor(F.col("cy") / (STACK_GAP * F.col("h"))).cast("int")
    pieces = stored(pieces_of_words(words, page).withColumn("band", band).withColumn("id", F.struct("row", "piece")), "pieces")
    upper = pieces.select(page, F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("id").alias("up"), F.col("left").alias("l"), F.col("right").alias("r"), F.col("cy").alias("c"))
    over = F.least("right", "r") - F.greatest("left", "l") >= OVERLAP * F.least(F.col("right") - F.col("left"), F.col("r") - F.col("l"))
    fits = (F.col("cy") > F.col("c")) & (F.col("cy") - F.col("c") <= STACK_GAP * F.col("h")) & (over | (F.abs(F.col("left") - F.col("l")) <= ALIGNED * F.col("h")))
    hung = pieces.join(upper, [page, "band"]).where(fits).groupBy(page, "id").agg(F.max(F.struct("c", (-F.col("l")).alias("l"), "up"))["up"].alias("up"))
    links = stored(pieces.select(page, "id").join(hung, [page, "id"], "left").select(page, "id", F.coalesce("up", "id").alias("up")), "hung")
    while True:
        next_ = links.select(page, F.col("id").alias("up"), F.col("up").alias("top"))
        links_ = stored(links.join(next_, [page, "up"]).select(page, "id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "hung")
        links = links_.drop("moved")
        if links_.where("moved").isEmpty():
            break
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda s: s["text"]), "\n")
    blocks = pieces.join(links, [page, "id"]).groupBy(page, "up").agg(F.count("*").alias("pieces"), lines.alias("text"))
    return blocks.select(page, F.row_number().over(Window.partitionBy(page).orderBy("up")).alias("block"), "pieces", "text")
