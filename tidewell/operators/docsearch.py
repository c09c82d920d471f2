"""Search of documents by stemmed words in weighted fields: all words of a question must stand in a document.

The index has a row for each (stem, document): the places of the stem in the document's fields, read one after the
other, with the weight of the field. It is written once, in folders by a hash of the stem; a common stem is in several
files. A search starts from each question's rarest stem, whose documents are the only candidates, and looks the other
stems up for those alone, so what is shuffled goes with the rarest stem, not the commonest.

Rank, as published for text search with weights: of one stem, weights over squared ordinals; of more, each pair of
places of two stems adds by how near they are (pairs over 100 words apart add nothing to nine digits).

Stop words take a place but are not indexed; questions of stop words alone, blank or null ones find nothing. Repeated
documents are found each; ties are ranked alike; null fields are empty; an empty table finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.joins import small_side
from tidewell.functions.stems import STOP_WORDS, stems
from tidewell.functions.text import terms
from tidewell.operators.lexical import bucket_of
from tidewell.sources.shared import stored

# Weights of the fields, and the divisor that a single stem's rank is scaled by.
WEIGHTS = {"title": 1.0, "filename": 0.4, "description": 0.2}
SQUARES = 1.64493406685
NEAR = 100
BUCKETS = 64
FILE_ROWS = 2_000_000


def _weighed(field: str, weight: float) -> Column:
    return F.transform(terms(F.col(field)), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))


def indexed_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term, place, weight) of all words but stop words; docs(doc_id, title, filename, description)."""
    rows = docs.select("doc_id", F.posexplode_outer(F.concat(*(_weighed(f, w) for f, w in WEIGHTS.items()))).alias("place", "t"))
    return rows.select("doc_id", "t.term", "place", "t.weight").where(F.col("term").isNotNull() & ~F.col("term").isin(*STOP_WORDS))


def write_document_index(docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    words = stored(indexed_terms(docs), "words")
    stem_of = stored(stems(words.select("term").distinct()), "stems")
    places = words.join(small_side(stem_of), "term").groupBy("stem", "doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("at"))
    rows = stored(places.withColumn("bucket", bucket_of(F.col("stem"), buckets)), "places")
    spread = max(1, rows.count() // (buckets * FILE_ROWS))
    rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(spread))).sortWithinPartitions("stem", "doc_id").write.partitionBy("bucket").parquet(f"{path}/places")
    rows.groupBy("stem").agg(F.count("*").alias("df")).write.parquet(f"{path}/stems")
    docs.sparkSession.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/shape")


def question_stems(asked: DataFrame) -> DataFrame:
    """(question_id, stem, n): the different stems of a question, and how many they are."""
    words = asked.select("question_id", F.explode(F.array_distinct(terms(F.col("question")))).alias("term")).where(~F.col("term").isin(*STOP_WORDS))
    rows = stems(words).select("question_id", "stem").distinct()
    return rows.join(rows.groupBy("question_id").agg(F.count("*").alias("n")), "question_id")


def search_document_index(asked: DataFrame, path: str) -> DataFrame:
    """(question_id, doc_id, rank) of the documents that hold every stem of a question."""
    spark = asked.sparkSession
    places, buckets = spark.read.parquet(f"{path}/places"), spark.read.parquet(f"{path}/shape").first()["buckets"]
    want = question_stems(asked).join(spark.read.parquet(f"{path}/stems"), "stem").withColumn("bucket", bucket_of(F.col("stem"), buckets))
    want = stored(want, "wanted")
    rarest = want.groupBy("question_id", "n").agg(F.min(F.struct("df", "stem", "bucket")).alias("r"), F.count("*").alias("known")).where("known = n")
    first = places.join(small_side(rarest.select("question_id", "n", "r.stem", "r.bucket")), ["bucket", "stem"]).select("question_id", "doc_id", "n")
    asked_of = stored(first, "candidates").join(want.select("question_id", "stem", "bucket"), "question_id")
    met = places.join(asked_of, ["bucket", "stem", "doc_id"]).groupBy("question_id", "doc_id", "n").agg(F.collect_list("at").alias("stems")).where(F.size("stems") == F.col("n"))
    return met.select("question_id", "doc_id", "stems").mapInArrow(_ranked, f"question_id {asked.schema['question_id'].dataType.simpleString()}, doc_id {places.schema['doc_id'].dataType.simpleString()}, rank double")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ranks = [rank_of([(np.array([p["place"] for p in s]), np.array([p["weight"] for p in s])) for s in own]) for own in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ranks, pa.float64())], ["question_id", "doc_id", "rank"])


def rank_of(places: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """The rank of one document: places and weights of each stem, in order of place."""
    if len(places) == 1:
        w = places[0][1]
        j, squares = int(w.argmax()), np.arange(1, len(w) + 1) ** 2
        return round(float((w[j] + (w / squares).sum() - w[j] / squares[j]) / SQUARES), 6)
    apart = 0.0  # logarithm of the product of what each pair leaves
    for i in range(1, len(places)):
        at, w = places[i]
        for other, v in places[:i]:
            low, high = np.searchsorted(other, at - NEAR), np.searchsorted(other, at + NEAR, "right")
            mine = np.repeat(np.arange(len(at)), high - low)
            ends = np.cumsum(high - low)
            theirs = np.arange(len(mine)) + np.repeat(low - ends + (high - low), high - low)
            near = 1 / (1.005 + 0.05 * np.exp(np.abs(at[mine] - other[theirs]) / 1.5 - 2))
            apart += float(np.log1p(-np.sqrt(w[mine] * v[theirs] * near)).sum())
    return round(1 - float(np.exp(apart)), 6)
