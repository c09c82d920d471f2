"""Checks on answers, and follow-up questions: all column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import SENTENCE, strip

# Patterns and limits of the checks.
MARKER = r"\[(\d+)\]"
NUMBER = r"(?<![\w.])((?:\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+\.\d+|\d{4,}|\d{1,3}(?:st|nd|rd|th)?))(?!\w)"
QUOTED = "[“\"]([^”\"]*)[”\"]"
TRIVIAL = [str(k) for k in range(11)]
MIN_SENTENCE = MIN_QUOTE = 25
HEDGES = ("do not", "does not", "no mention", "not mention", "not specify", "cannot", "no information")
OPENERS = (
    "what about|and what|and the|what of|how about|and how|is it|are they|are these|does it|do they|did it|was it|"
    "why is|why are|why did|when is|when did|who is|who are|and|but|also|then|so"
)
DANGLING = r"\b(it|its|they|them|their|this|that|these|those|the same|above|there)\b"
MAX_PASSAGES = 8


def normalised(c: Column) -> Column:
    """Figures and words as compared: lower case, no commas, no ordinal endings, single blanks."""
    c = F.replace(F.lower(c), F.lit(","), F.lit(""))
    return F.regexp_replace(F.regexp_replace(c, r"(\d)(st|nd|rd|th)\b", "$1"), r"\s+", " ")


def markers(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1)), lambda m: m.cast("long"))


def verify_citations(answer: Column, n_passages: Column) -> tuple[Column, Column, Column]:
    """(cleaned answer, valid markers in order, invalid markers in order)."""
    found = F.array_distinct(markers(answer))
    good = lambda n: (n >= 1) & (n <= n_passages)
    valid, invalid = F.array_sort(F.filter(found, good)), F.array_sort(F.filter(found, lambda n: ~good(n)))
    cleaned = F.aggregate(invalid, answer, lambda text, n: F.replace(text, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.lit("")))
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, " {2,}", " "), r" +([.,;:])", "$1")
    return strip(cleaned), valid, invalid


def checkable_numbers(answer: Column) -> Column:
    """Distinct normalised figures of an answer, without markers and trivial ones."""
    plain = F.regexp_replace(answer, r"\[\d+\]", " ")
    found = F.transform(F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(1)), normalised)
    return F.array_distinct(F.filter(found, lambda n: ~n.isin(TRIVIAL)))


def supported(numbers: Column, context: Column) -> Column:
    """The figures that stand in the normalised context (as substrings)."""
    return F.filter(numbers, lambda n: F.contains(context, n))


def claims(answer: Column) -> Column:
    return F.filter(F.transform(F.split(answer, SENTENCE), strip), lambda s: F.length(s) >= MIN_SENTENCE)


def cited(sentences: Column) -> Column:
    return F.filter(sentences, lambda s: s.rlike(r"\[\d+\]"))


def quotations(answer: Column) -> Column:
    found = F.regexp_extract_all(answer, F.lit(QUOTED), F.lit(1))
    return F.filter(F.transform(found, lambda q: strip(F.regexp_replace(q, r"\[\d+\]", " "))), lambda q: F.length(q) >= MIN_QUOTE)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where there was nothing to check."""
    return F.try_divide(part, F.nullif(whole, F.lit(0)))


def hedges(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(HEDGES))


def is_followup(question: Column) -> Column:
    q = F.lower(strip(F.coalesce(question, F.lit(""))))
    words = F.size(F.split(q, r"\s+"))
    return F.when(q == "", False).otherwise((words <= 3) | q.rlike(f"^({OPENERS}) ") | ((words < 8) & q.rlike(DANGLING)))


def expand_followups(turns: DataFrame) -> DataFrame:
    """User turns of conversations with the question to search for: (conv_id, turn, question, searched, expanded)."""
    asked = turns.where("role = 'user'").withColumn("question", strip(F.coalesce("text", F.lit(""))))
    w = Window.partitionBy("conv_id").orderBy("turn", "question")
    rows = asked.withColumn("before", F.lag("question").over(w)).withColumn("expanded", (F.coalesce("before", F.lit("")) != "") & (F.col("question") != "") & is_followup(F.col("question")))
    return rows.select("conv_id", "turn", "question", F.when(F.col("expanded"), F.concat_ws(" ", "before", "question")).otherwise(F.col("question")).alias("searched"), "expanded")


def compose_context(found: DataFrame, docs: DataFrame, place: str = "fusion_rank") -> DataFrame:
    """(question_id, passages, context): the first MAX_PASSAGES passages, numbered and labelled with their source."""
    rows = found.where(F.col(place) <= MAX_PASSAGES).join(docs.select("doc_id", "title", "text"), "doc_id")
    body = F.concat(F.lit("["), F.col(place).cast("string"), F.lit("] ("), "title", F.lit(")\n"), "text")
    return rows.groupBy("question_id").agg(F.count("*").alias("passages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("i"), body.alias("b")))), lambda s: s["b"]), "\n\n").alias("context"))
