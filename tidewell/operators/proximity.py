"""Reranking by nearness: how many of a question's terms a passage holds, and in how small a window.

Of the n informative terms of a question a passage holds m, and the smallest stretch of its words that covers those m
is w words long; its score is m / n * (1 + m / w) / 2: 1 where it holds all terms next to each other, 0 where it holds
none. Only candidates are looked at, whole. Where a score of a question is missing (null or no number), whatever made
it, that question keeps its fused order, and its scores are null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import informative_terms
from tidewell.operators.lexical import top

WORD = re.compile(r"[\w-]+")


def smallest_window(places: list[tuple[int, str]]) -> int:
    """Words of the smallest stretch that holds every term of places(word number, term), which are in order."""
    kinds = len({t for _, t in places})
    have: dict[str, int] = {}
    least, left = None, 0
    for at, term in places:
        have[term] = have.get(term, 0) + 1
        while len(have) == kinds:
            begin, first = places[left]
            size = at - begin + 1
            least = size if least is None or size < least else least
            have[first] -= 1
            if not have[first]:
                del have[first]
            left += 1
    return least or 0


def nearness(wanted: list[str], text: str | None) -> float:
    """The score of one passage for the terms of a question."""
    terms = set(wanted)
    places = [(k, w) for k, w in enumerate(WORD.findall((text or "").lower())) if w in terms]
    m = len({t for _, t in places})
    return round(m / len(terms) * (1 + m / smallest_window(places)) / 2, 6) if m else 0.0


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        scores = [nearness(w or [], t) for w, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["question_id", "doc_id", "rerank_score"])


def near_scores(found: DataFrame, asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, doc_id, rerank_score) of the candidates."""
    terms = asked.select("question_id", F.array_distinct(informative_terms(F.col("question"))).alias("wanted"))
    rows = found.select("question_id", "doc_id").join(terms, "question_id").join(docs.select("doc_id", "text"), "doc_id")
    kinds = [f"{c} {found.schema[c].dataType.simpleString()}" for c in ("question_id", "doc_id")]
    return rows.select("question_id", "doc_id", "wanted", "text").mapInArrow(_scored, ", ".join([*kinds, "rerank_score double"]))


def reranked(found: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """The first `limit` candidates of each question by rerank_score, ties by fused place; the fused order where a score is missing."""
    rows = found.join(scores, ["question_id", "doc_id"], "left")
    lost = F.max(F.col("rerank_score").isNull() | F.isnan("rerank_score")).over(Window.partitionBy("question_id"))
    rows = rows.withColumn("rerank_score", F.when(~lost, F.col("rerank_score")))
    return top(rows, "question_id", [F.col("rerank_score").desc_nulls_last(), F.col("fusion_rank")], limit, "position")
