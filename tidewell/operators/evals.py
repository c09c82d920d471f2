"""Retrieval quality: hit rates, reciprocal rank, question templates, candidate passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.joins import small_side
from tidewell.functions.text import prose_ratio, terms

# Patterns, the questions they give, and what they test.
TEMPLATES = (
    (r"(?i)\b(?:by|before|upto|up to)\s+(\d{1,2}(?:st|nd|rd|th)?\s+\w+\s+\d{4}|\w+\s+\d{4})", "What is the deadline of {0} for?", "a date"),
    (r"\b(Category\s+[ABC])\b", "What applies to {0} thermal power plants?", "a category"),
    (r"(?i)\b((?:Rs\.?|₹)\s?[\d.]+(?:\s?(?:per unit|paise|crore|lakh))?)", "What is {0} charged for?", "an amount"),
    (r"\b(Section\s+\d+[A-Z]?)\b", "What does {0} provide for?", "a section reference"),
    (r"(?i)\b((?:S\.?O\.?|G\.?S\.?R\.?)\s?\d+\s?\(E\))", "What does notification {0} cover?", "a notification number"),
    (r"\b(\d{1,3}(?:,\d{2,3})*\s?MW)\b", "What does the figure {0} refer to?", "a capacity figure"),
    (r"\b(FGD|CEMS|SO2|NOx|ESP|SNCR|SCR)\b", "What does this corpus say about {0}?", "an abbreviation"),
)
#: How long a passage for a question is, and how much of it is prose.
MIN_CHARS, MAX_CHARS, MIN_PROSE = 320, 2400, 0.45
#: The order of the sample.
SEED = 5077


def derive_questions(docs: DataFrame, id_col: str = "doc_id", text: str = "text", heading: str = "title") -> DataFrame:
    """(question, tests, doc_id): one question for the first match of each pattern and for a heading; of equal questions the smallest id."""
    made = []
    for pattern, question, tests in TEMPLATES:
        value = F.trim(F.regexp_extract(F.col(text), pattern, 1))
        before, after = question.split("{0}")
        made.append(F.when(value != "", F.struct(F.concat(F.lit(before), value, F.lit(after)).alias("question"), F.lit(tests).alias("tests"))))
    h = F.trim(F.coalesce(heading, F.lit("")))
    named = (F.length(h) > 8) & (F.length(h) < 90) & ~h.rlike(r"^\p{Nd}")
    made.append(F.when(named, F.struct(F.concat(F.lit("What does the corpus say about "), h, F.lit("?")).alias("question"), F.lit("a section heading").alias("tests"))))
    rows = docs.select(id_col, F.explode(F.array_compact(F.array(*made))).alias("q")).select(id_col, "q.*")
    return rows.groupBy(F.lower("question").alias("k")).agg(F.min(F.struct(id_col, "question", "tests")).alias("m")).select(f"m.{id_col}", "m.question", "m.tests")


def candidates(docs: DataFrame, per_group: int, group: str) -> DataFrame:
    """Passages fit for questions, spread over groups in a fixed pseudo-random order (the sampling is the feature).

    docs(doc_id, text, status, deleted_at, is_table, group): live, not deleted, no tables, neither short nor long, prose.
    """
    docs = docs.where((F.col("status") == "LIVE") & F.col("deleted_at").isNull() & ~F.coalesce("is_table", F.lit(False)))
    fit = docs.where(F.length("text").between(MIN_CHARS, MAX_CHARS) & (prose_ratio(F.col("text")) >= MIN_PROSE))
    w = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(str(SEED)), F.col("doc_id").cast("string"))), "doc_id")
    return fit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_group)


def holders_of(docs: DataFrame, items: DataFrame, words: int = 8) -> DataFrame:
    """(question_id, doc_id): documents that hold any `words` terms in a row of an item, or all terms of a shorter one.

    An equal-key join: documents explode into their runs of terms, which meet the items' runs before any shuffle
    where those are few. Runs of fewer terms are made only for the lengths that items have (a few numbers).
    """
    own = items.select("question_id", terms(F.col("text")).alias("ts")).where(F.size("ts") > 0).withColumn("k", F.least(F.size("ts"), F.lit(words)))
    run = lambda k: F.transform(F.sequence(F.lit(1), F.size("ts") - k + 1), lambda i: F.array_join(F.slice("ts", i, k), " "))
    keys = own.select("question_id", "k", F.explode(run(F.col("k"))).alias("run")).distinct()
    texts = docs.select("doc_id", terms(F.col("text")).alias("ts"))
    out = None
    for k in sorted(r.k for r in keys.select("k").distinct().collect()):
        runs = texts.where(F.size("ts") >= k).select("doc_id", F.explode_outer(run(F.lit(k))).alias("run"))
        part = runs.join(small_side(keys.where(F.col("k") == k).select("question_id", "run")), "run").select("question_id", "doc_id")
        out = part if out is None else out.unionByName(part)
    return out.distinct() if out is not None else docs.sparkSession.createDataFrame([], "question_id long, doc_id long")


def ranks_of(found: DataFrame, expected: DataFrame, place: str = "fusion_rank") -> DataFrame:
    """(question_id, rank): place of the first expected document, null where none was found."""
    hit = found.join(expected, ["question_id", "doc_id"]).groupBy("question_id").agg(F.min(place).alias("rank"))
    return expected.select("question_id").distinct().join(hit, "question_id", "left")


def summary(ranks: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    r = F.col("rank")
    more = [F.median("seconds").alias("median_seconds")] if "seconds" in ranks.columns else []
    return ranks.agg(*more, F.count("*").alias("n"), share(r == 1).alias("hit_at_1"), share(r <= 5).alias("hit_at_5"), share(r.isNotNull()).alias("hit_at_k"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"))
