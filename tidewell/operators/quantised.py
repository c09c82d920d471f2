"""A vector index of cells and product codes, read in strict order of what a cell can still hold.

A vector of length one is its cell's centre and a residual; the residual is cut into `parts` pieces, each named by the
nearest of 256 words: a byte a piece instead of eight a number. The likeness of a code is the question's product with
the vector that it stands for; vectors themselves are read for the best `short` codes alone.

Cells are read by their bound, centre's likeness plus `reach` times the cell's radius, largest first, twice as many in
each round, until a question has `short` visible codes and no unread cell's bound comes up to the last of them. Rights
are in the index, so codes that may not be seen fill no place. With reach 1 no vector outside what was read can be
nearer (by codes); smaller ones read less. Centres and words are fitted on at most SAMPLE vectors (a documented
bound), every vector is indexed; radii are taken over all of them. Null, empty and zero vectors are not indexed, those
of another length than the fitted ones neither; questions of such vectors have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.vectors import cosine
from tidewell.operators.ann import ROUNDS, SAMPLE, fit_centroids
from tidewell.operators.retrieval import LOWEST, SLACK, make_room, met_blocks, seen_nearest, told, top
from tidewell.sources.shared import stored

WORDS = 256
#: Codes and questions that meet at a time, and bytes of a quantiser that tasks are sent.
CODE_ROWS, QUESTION_ROWS, MAX_BYTES = 4096, 1000, 64 << 20
#: Files that a cell's codes are dealt over.
CELL_FILES = 4
BLOCKS = "cell int, docs array<long>, owners array<string>, open array<boolean>, codes binary, radius double"
QUESTIONS = "block long, ids array<long>, viewers array<string>, admins array<boolean>, asked binary, cells binary, least binary"


@dataclass
class Quantiser:
    centres: np.ndarray  # cells x dimensions
    books: list[np.ndarray]  # for each part: words x dimensions of the part
    edges: list[int]  # where parts begin and end


def _units(column) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of those that have a direction; all must be of one length."""
    x = np.array(column.tolist(), float)
    norm = np.linalg.norm(x, axis=1)
    good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
    return good, x[good] / norm[good, None]


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(axis=1) - 2 * x @ words.T).argmin(axis=1)


def fit(vectors: DataFrame, cells: int, parts: int) -> Quantiser:
    """Centres by ann's rounds, words by Lloyd's rounds over the residuals of the same sample (in hash order); of several lengths the most frequent."""
    usable = vectors.where("size(embedding) > 0 and exists(embedding, v -> v <> 0) and forall(embedding, v -> v is not null and abs(v) < double('infinity') and not isnan(v))")
    length = usable.groupBy(F.size("embedding").alias("length")).count().orderBy(F.col("count").desc(), "length").first()
    if length is None:
        raise ValueError("no vector to fit on")
    usable = usable.where(F.size("embedding") == length["length"])
    centres = fit_centroids(usable, cells)
    rows = usable.orderBy(F.xxhash64("doc_id"), "doc_id").select("embedding").limit(SAMPLE).toPandas()
    _, x = _units(rows["embedding"])
    rest = x - centres[(x @ centres.T).argmax(axis=1)]
    edges = [int(e) for e in np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1)]
    books = []
    for a, b in zip(edges, edges[1:], strict=False):
        sub = rest[:, a:b]
        words = sub[:WORDS].copy()
        for _ in range(ROUNDS):
            near = _nearest(sub, words)
            for k in np.unique(near):
                words[k] = sub[near == k].mean(axis=0)
        books.append(words)
    if 8 * (centres.size + sum(w.size for w in books)) > MAX_BYTES:
        raise ValueError("a quantiser of this many cells is too large to be sent to tasks")
    return Quantiser(centres, books, edges)


def index(vectors: DataFrame, quantiser: Quantiser) -> DataFrame:
    """vectors(doc_id, embedding, classification, owner_id) as BLOCKS of one cell each, to be written by cell."""
    c, dim = quantiser.centres, quantiser.centres.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), CODE_ROWS):
                some = pdf.iloc[at : at + CODE_ROWS]
                good, x = _units(some["embedding"])
                if not len(good):
                    continue
                some, near = some.iloc[good], (x @ c.T).argmax(axis=1)
                rest = x - c[near]
                code = np.stack([_nearest(rest[:, a:b], w) for a, b, w in zip(quantiser.edges, quantiser.edges[1:], quantiser.books, strict=False)], axis=1).astype(np.uint8)
                far = np.linalg.norm(rest, axis=1)
                rows = []
                for k in np.unique(near).tolist():
                    i = np.flatnonzero(near == k)
                    of = some.iloc[i]
                    rows.append((k, of["doc_id"].tolist(), of["owner_id"].tolist(), (of["classification"] != "RESTRICTED").tolist(), code[i].tobytes(), float(far[i].max())))
                yield pd.DataFrame(rows, columns=["cell", "docs", "owners", "open", "codes", "radius"])

    rows = vectors.where(F.size("embedding") == dim).select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), "classification", "owner_id")
    return rows.mapInPandas(run, BLOCKS)


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """BLOCKS sorted by cell -> BLOCKS, those of a cell put together up to CODE_ROWS."""
    held: list = []

    def out() -> pd.DataFrame:
        docs, owners, open_ = ([x for r in held for x in r[k]] for k in (1, 2, 3))
        return pd.DataFrame([(held[0][0], docs, owners, open_, b"".join(r[4] for r in held), max(r[5] for r in held))], columns=["cell", "docs", "owners", "open", "codes", "radius"])

    for pdf in batches:
        for r in pdf.itertuples(index=False, name=None):
            if held and (held[0][0] != r[0] or sum(len(h[1]) for h in held) + len(r[1]) > CODE_ROWS):
                yield out()
                held = []
            held.append(r)
    if held:
        yield out()


def write_index(vectors: DataFrame, quantiser: Quantiser, folder: str) -> None:
    """The index as one folder a cell: a round reads the cells that its questions ask for."""
    dealt = index(vectors, quantiser).repartition("cell", F.pmod(F.xxhash64(F.get("docs", F.lit(0))), F.lit(CELL_FILES)))
    dealt.sortWithinPartitions("cell").mapInPandas(_merged, BLOCKS).write.mode("errorifexists").partitionBy("cell").parquet(folder)


def _ordered(asked: DataFrame, quantiser: Quantiser, radius: dict[int, float], reach: float) -> DataFrame:
    c, dim = quantiser.centres, quantiser.centres.shape[1]
    filled = np.array(sorted(radius), int)
    far = np.array([radius[k] for k in filled.tolist()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                good, x = _units(pdf["vector"])
                if not len(good):
                    continue
                bound = x @ c[filled].T + reach * far
                order = np.argsort(-bound, axis=1, kind="stable")
                yield pdf.iloc[good].assign(vector=list(x), cells=[filled[o].tolist() for o in order], bounds=[b[o].tolist() for b, o in zip(bound, order, strict=True)])

    rows = asked.where(F.size("vector") == dim).select("question_id", F.col("vector").cast("array<double>").alias("vector"), "viewer_id", F.coalesce("is_admin", F.lit(False)).alias("is_admin"))
    return rows.mapInPandas(run, "question_id long, vector array<double>, viewer_id string, is_admin boolean, cells array<int>, bounds array<double>")


def _packed(take: int):
    """Waiting questions of a block as QUESTIONS; cells: those of this round, -1 where a question has no more."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        q = np.array(rows["vector"], float)
        cells = np.array([c + [-1] * (take - len(c)) for c in rows["cells"]], np.int32)
        least = np.array([LOWEST if x is None else x for x in rows["least"]])
        listed = {name: pa.array([rows[of]], pa.list_(kind)) for name, of, kind in (("ids", "question_id", pa.int64()), ("viewers", "viewer_id", pa.string()), ("admins", "is_admin", pa.bool_()))}
        return pa.table({"block": table.column("block")[:1], **listed, **{name: pa.array([x.tobytes()], pa.binary()) for name, x in (("asked", q), ("cells", cells), ("least", least))}})

    return run


def _scored(quantiser: Quantiser, short: int):
    """(question_id, doc_id, guess) of the best `short` codes of a block of one cell, for those questions of a block that want it.

    A code's likeness is the question's product with the vector that it stands for, so a pair of blocks is one matrix product.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[int, np.ndarray] = {}
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                ids, docs = row["ids"], row["docs"]
                some = np.flatnonzero((np.frombuffer(row["wanted"], np.int32).reshape(len(ids), -1) == row["cell"]).any(axis=1))
                if not len(some):
                    continue
                if (at := row["block"]) not in so_far:
                    make_room(so_far)
                    so_far[at] = np.repeat(np.frombuffer(row["least"])[:, None], short, axis=1)
                code = np.frombuffer(row["codes"], np.uint8).reshape(len(docs), -1)
                known = quantiser.centres[row["cell"]] + np.concatenate([words[code[:, j]] for j, words in enumerate(quantiser.books)], axis=1)
                asked = np.frombuffer(row["asked"]).reshape(len(ids), -1)
                yield told(*seen_nearest(row, asked, known, short, so_far[at], some)).rename_columns(["question_id", "doc_id", "guess"])

    return run


def search(asked: DataFrame, blocks: DataFrame, vectors: DataFrame, quantiser: Quantiser, pool: int, short: int = 50, first: int = 4, reach: float = 0.5) -> DataFrame:
    """(question_id, doc_id, similarity, semantic_rank, cells_read) of the best `pool` of the `short` best codes.

    asked(question_id, vector, viewer_id, is_admin); blocks: the index; vectors(doc_id, embedding) for the exact
    similarities, joined on the id. A document deleted since has no row in vectors and takes no place of the result.
    Questions go in blocks, and a block meets the blocks of the round's cells; what a question has found already is the
    least that a code must have to leave a task. Guesses are rounded to 9 places, ties go to the smaller doc_id.
    """
    radius = {r["cell"]: r["radius"] for r in blocks.groupBy("cell").agg(F.max("radius").alias("radius")).collect()}  # at most one row a cell
    waiting = stored(_ordered(asked, quantiser, radius, reach).withColumn("least", F.lit(None).cast("double")), "quantised-asked")
    found = ended = None
    done, take = 0, first
    while done < len(radius):
        parts = max(1, -(-waiting.count() // QUESTION_ROWS))
        round_ = waiting.select(F.pmod(F.xxhash64("question_id"), F.lit(parts)).alias("block"), "question_id", "vector", "viewer_id", "is_admin", "least", F.slice("cells", done + 1, take).alias("cells"))
        packed = stored(round_.groupBy("block").applyInArrow(_packed(min(take, len(radius))), QUESTIONS), "quantised-round").withColumnRenamed("cells", "wanted")
        named = [r["cell"] for r in round_.select(F.explode("cells").alias("cell")).distinct().collect()]  # at most one row a cell
        met = met_blocks(blocks.where(F.col("cell").isin(named)).drop("radius"), packed)
        fresh = met.mapInArrow(_scored(quantiser, short), "question_id long, doc_id long, guess double")
        best = fresh if found is None else found.join(waiting.select("question_id"), "question_id", "left_semi").select("question_id", "doc_id", "guess").unionByName(fresh)
        found = stored(top(best, "question_id", [F.col("guess").desc(), F.col("doc_id")], short, "place"), "quantised-found")
        done, take = done + take, 2 * take
        state = waiting.drop("least").join(found.groupBy("question_id").agg(F.count("*").alias("n"), F.min("guess").alias("least")), "question_id", "left")
        ends = (F.lit(done) >= F.size("cells")) | F.coalesce((F.col("n") >= short) & (F.get("bounds", F.lit(done)) < F.col("least") - SLACK), F.lit(False))
        state = stored(state.withColumn("ends", ends).withColumn("least", F.when(F.col("n") >= short, F.col("least"))).drop("n"), "quantised-state")
        over = found.join(state.where("ends").select("question_id"), "question_id", "left_semi").select("question_id", "doc_id", F.lit(min(done, len(radius))).alias("cells_read"))
        ended = over if ended is None else ended.unionByName(over)
        waiting = state.where("not ends").drop("ends")
        if waiting.isEmpty():
            break
    if ended is None:
        return asked.sparkSession.createDataFrame([], "question_id long, doc_id long, similarity double, semantic_rank int, cells_read int")
    exact = ended.join(vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding")), "doc_id").join(asked.select("question_id", F.col("vector").cast("array<double>").alias("vector")), "question_id")
    exact = exact.select("question_id", "doc_id", F.round(cosine(F.col("vector"), F.col("embedding")), 9).alias("similarity"), "cells_read")
    return top(exact, "question_id", [F.col("similarity").desc(), F.col("doc_id")], pool, "semantic_rank")


def arm(blocks: DataFrame, quantiser: Quantiser, **law):
    """A semantic arm for retrieval.search that goes through an index: at least five codes for each place of its pool."""

    def run(asked: DataFrame, vectors: DataFrame, pool: int) -> DataFrame:
        return search(asked, blocks, vectors.select("doc_id", "embedding"), quantiser, pool, **{"short": 5 * pool, **law}).drop("cells_read")

    return run
