"""An inverted-file index over vectors: cells around centroids, probed nearest first, filtered before candidates count.

Centroids are fitted on at most SAMPLE vectors (a documented bound); every vector is indexed. The index is a table
with one row per vector and its cell, to be written partitioned by cell. A search takes each question to the cells that
it probes and ranks what the asker may see: a block of questions and a block of one cell's vectors are one matrix
product, so pairs of a question and a vector are never rows. Where fewer than `pool` visible rows were found in the
probed cells, that question probes all cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.retrieval import VECTORS, best_of, make_room, met_blocks, nothing, packed_vectors, question_blocks, told, top
from tidewell.sources.shared import stored

SAMPLE = 20_000
ROUNDS = 8


def fit_centroids(vectors: DataFrame, cells: int) -> np.ndarray:
    """Unit centroids by Lloyd's rounds over a sample in hash order."""
    rows = vectors.where("embedding is not null").orderBy(F.xxhash64("doc_id"), "doc_id").select("embedding").limit(SAMPLE).toPandas()
    x = np.array(rows["embedding"].tolist(), float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = (x / np.where(norm > 0, norm, 1.0))[norm[:, 0] > 0]  # vectors without a direction have no say
    centres = x[: max(1, min(cells, len(x)))].copy()
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = x[near == k].sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def index(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(doc_id, embedding, cell) for every vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["embedding"].tolist(), float)
                yield pdf.assign(cell=(x @ centres.T).argmax(axis=1).astype("int32"))

    rows = vectors.where("embedding is not null").select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInPandas(run, "doc_id long, embedding array<double>, cell int")


def _cell_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, VECTORS) from (doc_id, embedding, classification, owner_id, cell): the vectors of one cell in a row."""
    for b in batches:
        cells = b.column(4).to_numpy()
        for cell in np.unique(cells).tolist():
            own = b.take(pa.array(np.flatnonzero(cells == cell))).select(range(4))
            for some in packed_vectors(iter([own])):
                yield pa.RecordBatch.from_arrays([pa.array([cell] * some.num_rows, pa.int32()), *some.columns], ["cell", *some.schema.names])


def _within(centres: np.ndarray, pool: int, start: int, stop: int):
    """The best `pool` of a block of one cell for those questions of a block that have its cell at the places from start to stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                if (at := row["block"]) not in so_far:
                    make_room(so_far)
                    order = np.argsort(-(np.frombuffer(row["asked"]).reshape(len(row["ids"]), -1) @ centres.T), axis=1)
                    so_far[at] = np.argsort(order, axis=1).astype(np.int32), nothing(len(row["ids"]), pool)
                places, best = so_far[at]
                among = np.flatnonzero((places[:, row["cell"]] >= start) & (places[:, row["cell"]] < stop))
                if len(among):
                    yield told(*best_of(row, pool, best, among))

    return run


def search(asked: DataFrame, indexed: DataFrame, docs: DataFrame, centres: np.ndarray, pool: int, probes: int) -> DataFrame:
    """(question_id, doc_id, similarity, semantic_rank) of the best `pool` visible vectors in the probed cells.

    Vectors of a cell and questions are blocks that meet on the number of the question block, one matrix product for
    each pair. Vectors and questions of another length than the centres are not met.
    """
    rows = indexed.where(F.size("embedding") == centres.shape[1]).join(docs.where("deleted_at is null").select("doc_id", "classification", "owner_id"), "doc_id")
    packed = rows.select("doc_id", "embedding", "classification", "owner_id", "cell").mapInArrow(_cell_blocks, f"cell int, {VECTORS}")
    asked = asked.where(F.size("vector") == centres.shape[1])

    def found(some: DataFrame, start: int, stop: int) -> DataFrame:
        met = met_blocks(packed, question_blocks(some)).where("dim = size").drop("dim", "size")
        return met.mapInArrow(_within(centres, pool, start, stop), "question_id long, doc_id long, similarity double")

    first = stored(found(asked, 0, probes), "cells-found")
    short = asked.join(first.groupBy("question_id").count().where(F.col("count") >= pool), "question_id", "left_anti")
    more = found(short, probes, len(centres))
    return top(first.unionByName(more), "question_id", [F.col("similarity").desc(), F.col("doc_id")], pool, "semantic_rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(question_id, expected, hit) of an approximate against an exact ranking."""
    both = exact.select("question_id", "doc_id").join(found.select("question_id", "doc_id", F.lit(1).alias("hit")), ["question_id", "doc_id"], "left")
    return both.groupBy("question_id").agg(F.count("*").alias("expected"), F.count("hit").alias("hit"))
