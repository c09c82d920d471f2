"""Text rules as column expressions: cleaning, ratios, tokens, trimming. All JVM-side but Unicode folding."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a lexical question loses.
LEXICAL_STOPWORDS = (
    "a an the this that these those is are was were be been being am do does did done have has had having "
    "what which who whom whose when where why how of in on at to for from by with within into onto about as and or but nor so then than if else while during "
    "it its they them their there here i me my we us our you your he she his her can could shall should will would may might must "
    "any some all each both few more most other such not no only own same please tell show give list explain describe summarise summarize"
).split()
# Words that say nothing about what a passage must hold.
UNINFORMATIVE = (
    "the a an of for and or in on to is are was were what which who whom when where why how does do did can could should would that this these those "
    "with from by at as be been being it its any all best about there their you your our we they them has have had will may must"
).split()
MIN_TERMS = 2
# Characters without content, and lines that are only page furniture.
INVISIBLE = "​‌‍﻿­"
FURNITURE = (
    r"(?im)^[ \t]*(?:cont(?:d|inued)?\.*[ \t.]*(?:p(?:age|\.)?[ \t.]*)?\d{0,3}[ \t]*/?-?|[-–—][ \t]*\d{1,3}[ \t]*[-–—]"
    r"|page[ \t]+\d{1,4}(?:[ \t]+of[ \t]+\d{1,4})?)[ \t]*(?:\n|\z)"
)
PARAGRAPH, SENTENCE = r"\n\s*\n", r"(?<=[.!?])\s+"
MIN_PDF_CHARS_PER_PAGE = 50
PROSE_FLOOR = 0.15


def nfkc(df: DataFrame, column: str) -> DataFrame:
    """df with column folded to NFKC in Arrow batches; texts of ASCII only are passed on unread."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            new = [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return df.mapInArrow(fold, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]))


def clean(c: Column) -> Column:
    """Cleaning after Unicode folding: invisible and control characters, line ends, furniture, broken words, blanks."""
    # fixed values: the characters and patterns of each step
    controls = "".join(chr(x) for x in [*range(1, 9), *range(0x0E, 0x20), 0x7F])
    c = F.translate(F.coalesce(c, F.lit("")), INVISIBLE, "")
    c = F.translate(c, "\x0b\x0c", "\n\n")
    c = F.regexp_replace(F.translate(c, controls, ""), "\\x00", "")
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, FURNITURE, "")
    c = F.regexp_replace(c, r"(?U)(\w)-\n([a-z])", "$1$2")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    c = F.regexp_replace(c, r"(?m)[ \t]+$", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def split_blank(c: Column) -> Column:
    """Tokens between white space, without empty ones."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def prose_ratio(c: Column) -> Column:
    """Share of characters in tokens of three or more characters without a digit."""
    counted = F.aggregate(F.filter(split_blank(c), lambda t: (F.length(t) >= 3) & ~t.rlike(r"\p{Nd}")), F.lit(0), lambda a, t: a + F.length(t))
    return F.when(F.length(F.coalesce(c, F.lit(""))) == 0, 0.0).otherwise(counted / F.length(c))


MIN_DETECT_CHARS = 40


def detected_language(c: Column, detector: Column) -> Column:
    """What the detector says; nothing for texts under MIN_DETECT_CHARS characters, which say too little."""
    return F.when(F.length(strip(F.coalesce(c, F.lit("")))) >= MIN_DETECT_CHARS, detector)


def clean_all(items: Column) -> Column:
    """Headings (or figure texts) cleaned one by one; those with nothing left go."""
    return F.filter(F.transform(items, clean), lambda t: t != "")


def effective_language(ratio: Column, detected: Column) -> Column:
    return F.when(ratio < PROSE_FLOOR, F.lit("en")).otherwise(detected)


def quality_failures(char_count: Column, unit_count: Column, is_pdf: Column, floor: int = MIN_PDF_CHARS_PER_PAGE) -> Column:
    density = F.when(unit_count > 0, char_count / unit_count)
    return (
        F.when(char_count == 0, F.array(F.lit("EMPTY_TEXT")))
        .when(is_pdf & (unit_count > 0) & (density < floor), F.array(F.lit("LOW_TEXT_DENSITY")))
        .otherwise(F.array().cast("array<string>"))
    )


def terms(c: Column) -> Column:
    """Index terms: runs of letters and digits, lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def lexical_question(c: Column) -> Column:
    """The question without function words; unchanged where fewer than two terms would be left."""
    # fixed value: what goes from the edges of a word
    edge = r"(?U)^[^\w(]+|(?<!\.\w)[^\w).]+$|(?<![A-Z])\.$"
    tokens = F.filter(F.transform(split_blank(c), lambda t: F.regexp_replace(t, edge, "")), lambda t: t != "")
    label = lambda t: (F.length(t) == 1) & t.rlike(r"^\p{Lu}$")
    kept = F.filter(tokens, lambda t: label(t) | ~F.lower(t).isin(LEXICAL_STOPWORDS))
    return F.when(F.size(kept) >= MIN_TERMS, F.array_join(kept, " ")).otherwise(c)


def informative_terms(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)([\w-]+)"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(UNINFORMATIVE))


def title_of(title: Column, filename: Column) -> Column:
    """A trimmed title, else the file's name without folders."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.regexp_replace(filename, r"^.*/", ""))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), SENTENCE), strip), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), PARAGRAPH), strip), lambda s: s != "")
