"""Permission-scoped hybrid retrieval for batches of questions.

Two arms rank passages for each question: cosine similarity of vectors, and BM25 over text and title (`lexical`). Both
filter by permission, deletion and scope before they rank, and both keep `pool` candidates. Ranks are fused by
reciprocal rank.

The semantic arm packs questions and vectors into blocks, each a row of bounded bytes, and joins them on the number of
the question block. A pair of blocks is one matrix product that keeps its own best `pool`, so the final ranking
shuffles a few rows for each question and block. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.joins import small_side
from tidewell.functions.text import informative_terms, terms
from tidewell.functions.vectors import cosine
from tidewell.operators import lexical
from tidewell.operators.access import visible
from tidewell.operators.lexical import top
from tidewell.sources.shared import borrowed, stored

# Parameters of the ranking.
RRF_K = 60
POOL_FACTOR, POOL_MAX, RERANK_FETCH = 5, 200, 50
RERANK_CHARS = 900
MIN_SIMILARITY = 0.55
#: Questions of a block, bytes of a block of vectors, and bytes of all question blocks that may be broadcast.
QUESTION_BLOCK, VECTOR_BYTES, BROADCAST_BYTES = 1000, 2 << 20, 64 << 20
#: Products that differ by less may be equal once they are rounded; the error of single precision for each dimension of unit
#: vectors, with room; what every product is above.
SLACK, SINGLE, LOWEST = 2e-9, 1.2e-7, float(np.finfo(np.float32).min)
#: Askers of a block that have a product each, products taken again at a time, and question blocks whose best a task remembers.
ASKERS, TAKEN, HELD = 32, 1 << 16, 64


def candidate_pool(limit: int) -> int:
    return min(POOL_MAX, max(limit, POOL_FACTOR * limit))


QUESTIONS = "block long, ids array<long>, viewers array<string>, admins array<boolean>, asked binary, dim int"
VECTORS = "docs array<long>, owners array<string>, open array<boolean>, known binary, size int"


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def question_blocks(asked: DataFrame) -> DataFrame:
    """The questions in blocks of about QUESTION_BLOCK by a hash of their id, as QUESTIONS, written."""
    n = max(1, -(-asked.count() // QUESTION_BLOCK))
    rows = asked.select(F.pmod(F.xxhash64("question_id"), F.lit(n)).alias("block"), "question_id", F.col("vector").cast("array<double>").alias("vector"), "viewer_id", "is_admin")

    def packed(table: pa.Table) -> pa.Table:
        ask = _matrix(table.column("vector").combine_chunks())
        listed = {name: pa.array([table.column(of).to_pylist()], pa.list_(kind)) for name, of, kind in (("ids", "question_id", pa.int64()), ("viewers", "viewer_id", pa.string()), ("admins", "is_admin", pa.bool_()))}
        return pa.table({"block": table.column("block")[:1], **listed, "asked": pa.array([ask.tobytes()], pa.binary()), "dim": pa.array([ask.shape[1]], pa.int32())})

    return stored(rows.where("vector is not null").groupBy("block").applyInArrow(packed, QUESTIONS), "questions")


def packed_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors, in rows of VECTOR_BYTES at most and of one length."""
    for b in batches:
        b = b.filter(b.column(1).is_valid())
        sizes = b.column(1).value_lengths().to_numpy()
        for size in np.unique(sizes).tolist():
            same = b.take(pa.array(np.flatnonzero(sizes == size)))
            rows = max(1, VECTOR_BYTES // (8 * max(1, size)))
            for at in range(0, same.num_rows, rows):
                some = same.slice(at, rows)
                docs, vectors, tiers, owners = some.columns
                open_ = [t != "RESTRICTED" for t in tiers.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([docs.to_pylist()], pa.list_(pa.int64())), pa.array([owners.to_pylist()], pa.list_(pa.string())), pa.array([open_]), pa.array([_matrix(vectors).tobytes()]), pa.array([size], pa.int32())], ["docs", "owners", "open", "known", "size"])


def met_blocks(packed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every row of packed beside every row of blocks(block, asked, ...): broadcast if they may be, else joined on the number of the block."""
    some = blocks.select("block", F.octet_length("asked").alias("bytes")).agg(F.max("block").alias("last"), F.sum("bytes").alias("bytes")).first()
    numbers = F.sequence(F.lit(0), F.lit(some["last"] or 0)).cast("array<long>")
    return packed.withColumn("block", F.explode(numbers)).join(F.broadcast(blocks) if (some["bytes"] or 0) <= BROADCAST_BYTES else blocks, "block")


def semantic_arm(asked: DataFrame, vectors: DataFrame, pool: int) -> DataFrame:
    """(question_id, doc_id, similarity, semantic_rank).

    asked(question_id, vector, viewer_id, is_admin); vectors(doc_id, embedding, classification, owner_id), without
    deleted rows. Similarities are rounded to 9 places, ties go to the smaller doc_id. Null vectors, and vectors of
    another length than a question's, are not met; those of length zero come last.
    """
    blocks = question_blocks(asked)
    packed = vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), "classification", "owner_id").mapInArrow(packed_vectors, VECTORS)
    met = met_blocks(packed, blocks).where("dim = size").drop("dim", "size")
    found = met.mapInArrow(_best(pool), "question_id long, doc_id long, similarity double")
    return top(found, "question_id", [F.col("similarity").desc(), F.col("doc_id")], pool, "semantic_rank")


def scoped_arm(asked: DataFrame, vectors: DataFrame, scope: DataFrame, pool: int) -> DataFrame:
    """The semantic arm inside scope(question_id, doc_id): equal-key joins, so only named documents are compared."""
    pairs = scope.select("question_id", "doc_id").distinct().join(asked.select("question_id", F.col("vector").cast("array<double>").alias("vector"), "viewer_id", "is_admin"), "question_id")
    rows = pairs.join(vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), "classification", "owner_id"), "doc_id")
    rows = rows.where(F.col("embedding").isNotNull() & visible(F.col("classification"), F.col("owner_id"), F.col("viewer_id"), F.col("is_admin")))
    rows = rows.select("question_id", "doc_id", F.round(cosine(F.col("vector"), F.col("embedding")), 9).alias("similarity"))
    return top(rows, "question_id", [F.col("similarity").desc(), F.col("doc_id")], pool, "semantic_rank")


def _best(pool: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[int, np.ndarray] = {}
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                if (at := row["block"]) not in so_far:
                    make_room(so_far)
                    so_far[at] = nothing(len(row["ids"]), pool)
                yield told(*best_of(row, pool, so_far[at]))

    return run


def nothing(questions: int, pool: int) -> np.ndarray:
    return np.full((questions, pool), LOWEST)


def make_room(held: dict) -> None:
    """Before a block's figures are added: a task holds those of HELD blocks of questions; without them it gives more rows than it must."""
    if len(held) >= HELD:
        held.clear()


def told(ids: np.ndarray, docs: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array(sims, pa.float64())], ["question_id", "doc_id", "similarity"])


def best_of(row: dict, pool: int, so_far: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best `pool` vectors of a block for each question of a block (or those at `among`), among those that its asker may see.

    so_far: see nearest(); it is kept for all questions of the block.
    """
    ask, known = np.frombuffer(row["asked"]).reshape(len(row["ids"]), -1), np.frombuffer(row["known"]).reshape(len(row["docs"]), -1)
    return seen_nearest(row, ask, known, pool, so_far, np.arange(len(ask)) if among is None else among)


def seen_nearest(row: dict, ask: np.ndarray, known: np.ndarray, pool: int, so_far: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest() as ids, for the questions at `some` and what their askers may see: of few askers one product each, else one with a mask."""
    ids, docs, everyone = np.array(row["ids"]), np.array(row["docs"]), np.array(row["open"], bool)
    names = {v: k for k, v in enumerate({*row["viewers"], *row["owners"]} - {None})}
    owners = np.array([names.get(o, -1) for o in row["owners"]])
    asker = np.array([-3 if a else names.get(v, -2) for v, a in zip(row["viewers"], row["admins"], strict=True)])[some]
    groups = np.unique(asker).tolist()
    found = []
    if len(groups) <= ASKERS:
        for g in groups:
            q, d = some[asker == g], np.arange(len(docs)) if g == -3 else np.flatnonzero(everyone | (owners == g))
            if len(d):
                at, of, s, so_far[q] = nearest(ask[q], known[d], docs[d], pool, so_far[q])
                found.append((q[at], d[of], s))
    else:
        at, of, s, so_far[some] = nearest(ask[some], known, docs, pool, so_far[some], everyone[None, :] | (asker == -3)[:, None] | (owners[None, :] == asker[:, None]))
        found.append((some[at], of, s))
    q, d, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return ids[q], docs[d], np.where(s == -2.0, np.nan, s)


def nearest(ask: np.ndarray, known: np.ndarray, docs: np.ndarray, pool: int, so_far: np.ndarray, may: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of ask, row of known, product, so_far) of the best `pool` of each row by product rounded to 9 places, then by docs; -2 for rows that are no numbers.

    Products of single precision tell what can be among them, with a margin for their error; those are taken again.
    so_far: the best `pool` products of each row in this task's blocks, LOWEST where there are none. What lies below the
    last of them is left out. So all blocks of a task together give all that can be among a row's best, and `pool` of
    them at least where it has so many.
    """
    lost = np.isnan(ask).any(axis=1), np.isnan(known).any(axis=1)
    margin = SLACK + SINGLE * known.shape[1] * max(1.0, float(np.abs(np.nan_to_num(known)).max(initial=0.0)))
    sims = ask.astype(np.float32) @ known.astype(np.float32).T
    if lost[0].any() or lost[1].any():
        sims[lost[0][:, None] | lost[1][None, :]] = -2.0
    if may is not None:
        sims[~may] = -np.inf
    floor = np.maximum(so_far.min(axis=1) - margin, LOWEST).astype(np.float32)
    hit = sims >= floor[:, None]
    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 2 * pool) if sims.shape[1] > pool else ()
    if len(many):
        least = np.partition(sims[many], sims.shape[1] - pool, axis=1)[:, sims.shape[1] - pool]
        hit[many] = sims[many] >= np.maximum(floor[many], least - np.float32(2 * margin))[:, None]
    q, d = np.nonzero(hit)
    s = np.concatenate([np.round(np.einsum("ij,ij->i", ask[q[k : k + TAKEN]], known[d[k : k + TAKEN]]), 9) for k in range(0, len(q), TAKEN)] or [np.zeros(0)])
    s[lost[0][q] | lost[1][d]] = -2.0
    order = np.lexsort((docs[d], -s, q))
    q, d, s = q[order], d[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    q, d, s, place = (x[place < pool] for x in (q, d, s, place))
    fresh = nothing(len(ask), pool)
    fresh[q, place] = s
    return q, d, s, np.partition(np.concatenate([so_far, fresh], axis=1), pool, axis=1)[:, pool:]


def postings(docs: DataFrame, field: str) -> DataFrame:
    """(doc_id, term, tf, dl) of one field; dl is the field's length in terms."""
    tokens = docs.select("doc_id", terms(F.col(field)).alias("ts"))
    return tokens.select("doc_id", F.size("ts").alias("dl"), F.explode_outer("ts").alias("term")).where("term is not null").groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))


def lexical_arm(asked: DataFrame, docs: DataFrame, pool: int, scope: DataFrame | None = None, index: str | None = None) -> DataFrame:
    """(question_id, doc_id, lexical_score, lexical_rank). Corpus figures cover all docs; scope, permission and deletion filter before anything is summed.

    index: where lexical.write_blocks() has written; without one, postings of the questions' terms are made from docs.
    """
    wanted = asked_terms(asked)
    inside = None if scope is None else scope.select("question_id", F.struct("doc_id").alias("key"))
    if index is None:
        found = lexical.best_of_texts(wanted, docs, ["doc_id"], pool, may_see(), inside)
    else:
        found = lexical.best(wanted, lexical.Blocks(asked.sparkSession, index), pool, may_see(), inside)
    return found.select("question_id", "key.doc_id", F.col("score").alias("lexical_score"), F.col("place").alias("lexical_rank"))


def asked_terms(asked: DataFrame) -> DataFrame:
    """(question_id, term, viewer_id, is_admin), written: what a walk over postings asks for."""
    return stored(lexical.question_terms(asked).join(asked.select("question_id", "viewer_id", "is_admin"), "question_id"), "asked")


def may_see() -> Column:
    """Whether a posting counts for the asker of a term."""
    return F.col("deleted_at").isNull() & visible(F.col("classification"), F.col("owner_id"), F.col("viewer_id"), F.col("is_admin"))


def search_passages(asked: DataFrame, passages: DataFrame, path: str, limit: int, fields: tuple = ("text", "heading", "title")) -> DataFrame:
    """(question_id, doc_id, chunk_index, score, place): the best passages for each question from an index written at path.

    Postings carry the permission columns, so what a viewer may not see leaves before scores are summed; corpus figures
    cover all passages.
    """
    with borrowed(passages, "passages") as rows:
        lexical.write_blocks(rows, path, ["doc_id", "chunk_index"], fields)
    found = lexical.best(asked_terms(asked), lexical.Blocks(asked.sparkSession, path), limit, may_see())
    return found.select("question_id", "key.doc_id", "key.chunk_index", "score", "place")


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1.0 / (RRF_K + rank), F.lit(0.0))


def fuse(semantic: DataFrame | None, lexical: DataFrame | None, fetch: int) -> DataFrame:
    """(question_id, doc_id, score, semantic_rank, lexical_rank, similarity, fusion_rank): the first `fetch` by fused score, doc_id."""
    if semantic is None:
        both = lexical.select("question_id", "doc_id", F.lit(None).cast("int").alias("semantic_rank"), "lexical_rank", F.lit(None).cast("double").alias("similarity"))
    elif lexical is None:
        both = semantic.select("question_id", "doc_id", "semantic_rank", F.lit(None).cast("int").alias("lexical_rank"), "similarity")
    else:
        both = semantic.join(lexical, ["question_id", "doc_id"], "full_outer")
    both = both.withColumn("score", F.round(reciprocal(F.col("semantic_rank")) + reciprocal(F.col("lexical_rank")), 9))
    ranked = top(both, "question_id", [F.col("score").desc(), F.col("doc_id")], fetch, "fusion_rank")
    return ranked.select("question_id", "doc_id", "score", "semantic_rank", "lexical_rank", "similarity", "fusion_rank")


def search(asked: DataFrame, docs: DataFrame, vectors: DataFrame, limit: int = 10, mode: str = "hybrid", rerank: bool = False, scope: DataFrame | None = None, arm=None) -> DataFrame:
    """Ranked passages for each question. scope(question_id, doc_id) narrows both arms before they rank.

    arm(asked, vectors, pool): in place of the exact semantic arm, one through an index (`quantised.arm`); not with a scope.
    """
    fetch = max(limit, RERANK_FETCH) if rerank else limit
    pool = candidate_pool(fetch)
    semantic = lexical = None
    if mode in ("hybrid", "semantic"):
        rows = vectors.join(docs.where(F.col("deleted_at").isNull()).select("doc_id", "classification", "owner_id"), "doc_id")
        semantic = (arm or semantic_arm)(asked, rows, pool) if scope is None else scoped_arm(asked, rows, scope, pool)
    if mode in ("hybrid", "lexical"):
        lexical = lexical_arm(asked, docs, pool, scope)
    found = fuse(semantic, lexical, fetch)
    return rerank_overlap(found, asked, docs, limit) if rerank else found


def overlap_score(question: Column, text: Column) -> Column:
    """Share of the question's informative terms that stand in the first characters of the text: the offline stand-in for a cross-encoder."""
    wanted = F.array_distinct(informative_terms(question))
    head = F.lower(F.substring(text, 1, RERANK_CHARS))
    hits = F.size(F.filter(wanted, lambda t: F.contains(head, t)))
    return F.round(F.when(F.size(wanted) == 0, 0.0).otherwise(hits / F.size(wanted)), 6)


def rerank_overlap(found: DataFrame, asked: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """The first `limit` of the fused candidates by rerank_score, ties by fused place."""
    rows = found.join(asked.select("question_id", "question"), "question_id").join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.withColumn("rerank_score", overlap_score(F.col("question"), F.col("text"))).drop("question", "text")
    return top(rows, "question_id", [F.col("rerank_score").desc(), F.col("fusion_rank")], limit, "position")


def grounding(found: DataFrame, asked: DataFrame, docs: DataFrame, scoped: bool = False) -> DataFrame:
    """(question_id, best_similarity, literal, grounded). A passage found lexically that holds every informative term grounds a question; else similarity does."""
    rows = found.join(docs.select("doc_id", F.lower("text").alias("low")), "doc_id").join(asked.select("question_id", informative_terms(F.col("question")).alias("wanted")), "question_id")
    literal = (F.size("wanted") > 0) & F.col("lexical_rank").isNotNull() & F.forall("wanted", lambda t: F.contains(F.col("low"), t))
    per = rows.groupBy("question_id").agg(F.max("similarity").alias("best_similarity"), F.max(literal).alias("literal"), F.count("*").alias("hits"))
    all_ = asked.select("question_id").join(per, "question_id", "left")
    grounded = F.coalesce("literal", F.lit(False)) | F.coalesce(F.col("best_similarity") >= MIN_SIMILARITY, F.lit(False))
    if scoped:
        grounded = grounded | (F.coalesce("hits", F.lit(0)) > 0)
    return all_.select("question_id", F.round("best_similarity", 6).alias("best_similarity"), F.coalesce("literal", F.lit(False)).alias("literal"), grounded.alias("grounded"))


def withhold(found: DataFrame, gate: DataFrame) -> DataFrame:
    """Results of grounded questions alone."""
    return found.join(gate.where("grounded").select("question_id"), "question_id", "left_semi")


def token_count(text: Column) -> Column:
    """Stand-in for a tokenizer: four characters a token, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def token_usage(found: DataFrame, docs: DataFrame, window: int = 512, tokens: Column | None = None) -> DataFrame:
    """Per question: tokens of its results, results over the window, hits of each arm. tokens: a column of docs, else a stand-in."""
    rows = found.join(docs.select("doc_id", (token_count(F.col("text")) if tokens is None else tokens).alias("tokens")), "doc_id")
    return rows.groupBy("question_id").agg(
        F.sum(F.least("tokens", F.lit(window))).alias("context_tokens"),
        F.count_if(F.col("tokens") > window).alias("truncated_results"),
        F.sum(F.greatest(F.col("tokens") - window, F.lit(0))).alias("truncated_tokens"),
        F.count("semantic_rank").alias("semantic_hits"),
        F.count("lexical_rank").alias("lexical_hits"),
    )


#: Characters of the pieces that a search for less than three words meets on.
GRAM = 12


def search_metadata(docs: DataFrame, asked: DataFrame, fields: tuple = ("title", "owner_id", "text")) -> DataFrame:
    """(question_id, doc_id, created_at): documents that hold a question as a substring of one of the fields, in any case.

    A document that holds three words or more holds the inner ones whole, so questions meet documents on their longest
    inner word; shorter ones on their first GRAM characters (or all; such lengths are a few numbers). Both are
    equal-key joins, and only keys that a question asks for leave the scan. What meets is held against the whole
    question. Blank questions find nothing.
    """
    words = F.split("needle", " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(F.filter(inner, lambda w: w != ""), lambda w: F.struct(F.length(w), w.alias("word"))))["word"]
    needles = asked.select("question_id", F.lower("question").alias("needle")).where(F.trim("needle") != "")
    needles = needles.withColumn("word", longest).withColumn("g", F.when(F.col("word").isNull(), F.least(F.length("needle"), F.lit(GRAM))))
    needles = stored(needles.withColumn("key", F.coalesce("word", F.substring("needle", F.lit(1), F.coalesce("g", F.lit(1))))).drop("word"), "needles")
    hay = docs.select("doc_id", "created_at", F.lower(F.concat_ws("\x01", *(F.col(f) for f in fields))).alias("hay"))
    found = docs.sparkSession.createDataFrame([], "question_id long, doc_id long, needle string")
    for g in [r.g for r in needles.select("g").distinct().collect()]:
        mine = needles.where(F.col("g").eqNullSafe(F.lit(g)))
        keys = F.split("hay", "[ \x01]") if g is None else F.regexp_extract_all("hay", F.lit(rf"(?s)(?=(.{{{g}}}))"), F.lit(1))
        met = hay.select("doc_id", F.explode_outer(F.array_distinct(keys)).alias("key")).join(small_side(mine.select("key").distinct()), "key", "left_semi")
        found = found.unionByName(met.join(mine.select("question_id", "key", "needle"), "key").select("question_id", "doc_id", "needle"))
    return found.join(hay, "doc_id").where(F.contains("hay", F.col("needle"))).select("question_id", "doc_id", "created_at")
