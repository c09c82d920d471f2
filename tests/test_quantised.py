"""The index of product codes: recall, cells read, rights, odd vectors."""

import uuid

import numpy as np
import pytest

from tidewell.operators import ann, quantised, retrieval
from tidewell.sources.shared import shared_folder

VECTORS = "doc_id long, embedding array<double>, classification string, owner_id string"
ASKED = "question_id long, vector array<double>, viewer_id string, is_admin boolean"


def built(spark, rows, cells, parts):
    vectors = spark.createDataFrame(rows, VECTORS)
    q = quantised.fit(vectors, cells, parts)
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    quantised.write_index(vectors, q, path)
    return vectors, q, spark.read.schema(quantised.BLOCKS).parquet(path)


def clusters(n, groups, dim, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim)) * 3
    return [(k, (centre[k % groups] + rng.normal(size=dim)).tolist(), "RESTRICTED" if k % 3 == 0 else "PUBLIC", f"o{k % 5}") for k in range(n)]


def test_clustered_vectors_are_found_in_a_quarter_of_the_cells(spark):
    rows = clusters(1500, 24, 32)
    vectors, q, blocks = built(spark, rows, 32, 8)
    asked = spark.createDataFrame([(k, rows[k][1], "o1", k % 40 == 0) for k in range(0, 1500, 20)], ASKED)
    found = quantised.search(asked, blocks, vectors, q, 10, short=40, first=2).cache()
    got = {r.question_id: r.hit for r in ann.recall(found, retrieval.semantic_arm(asked, vectors, 10)).collect()}
    assert len(got) == 75 and sum(got.values()) >= 0.9 * 750
    cells = len(q.centres)
    assert np.mean([r.cells_read for r in found.collect()]) <= cells / 4
    seen = {r.doc_id: r for r in vectors.collect()}
    admins = {r.question_id for r in asked.collect() if r.is_admin}
    assert all(seen[r.doc_id].classification == "PUBLIC" or seen[r.doc_id].owner_id == "o1" or r.question_id in admins for r in found.collect())


def test_a_question_whose_rights_are_rare_reads_on_until_its_pool_is_full(spark):
    rows = [(k, v, "PUBLIC" if k % 100 == 0 else "RESTRICTED", "o") for k, v, _, _ in clusters(1200, 12, 16)]
    vectors, q, blocks = built(spark, rows, 12, 4)
    asked = spark.createDataFrame([(7, rows[5][1], None, None)], ASKED)
    found = quantised.search(asked, blocks, vectors, q, 10, short=10, first=1, reach=0.0)
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in retrieval.semantic_arm(asked, vectors, 10).collect())


@pytest.mark.parametrize("parts", [1, 5, 99])
def test_with_all_codes_kept_it_is_the_exact_arm(spark, parts):
    rows = clusters(150, 4, 12) + [(900, None, "PUBLIC", "o"), (901, [0.0] * 12, "PUBLIC", "o"), (902, [], "PUBLIC", "o"), (903, [1.0] * 7, "PUBLIC", "o"), (904, [1.0] * 12, None, "o1"), (905, [1.0] * 12, "PUBLIC", None), (906, [1.0] * 12, "PUBLIC", None)]
    vectors, q, blocks = built(spark, rows, 4, parts)
    asked = spark.createDataFrame([(1, [1.0] * 12, "o2", False), (2, rows[8][1], "o1", False), (3, None, "o1", True), (4, [0.0] * 12, "o1", True), (5, [1.0] * 3, "o1", True)], ASKED)
    found = [(r.question_id, r.doc_id, r.similarity) for r in quantised.search(asked, blocks, vectors, q, 10, short=500, reach=1.0).orderBy("question_id", "semantic_rank").collect()]
    plain = retrieval.semantic_arm(asked.where("question_id < 3"), vectors.where("doc_id not in (901, 902, 903)"), 10)
    want = [(r.question_id, r.doc_id, r.similarity) for r in plain.orderBy("question_id", "semantic_rank").collect()]
    assert [f[:2] for f in found] == [w[:2] for w in want] and np.allclose([f[2] for f in found], [w[2] for w in want], atol=2e-9)


def test_empty_tables(spark):
    vectors, q, blocks = built(spark, clusters(20, 2, 4), 2, 2)
    none = spark.createDataFrame([], ASKED)
    assert quantised.search(none, blocks, vectors, q, 5).count() == 0
    asked = spark.createDataFrame([(1, [1.0] * 4, "x", True)], ASKED)
    assert quantised.search(asked, blocks.where("cell < 0"), vectors, q, 5).count() == 0


def test_search_through_the_index(spark, small):
    from __spark_entry__ import queries

    rows = queries()["vector_codes_recall"](spark, small).collect()
    assert rows and sum(r.hit for r in rows) >= 0.9 * sum(r.expected for r in rows)
    got = queries()["hybrid_through_codes"](spark, small).collect()
    want = {(r.question_id, r.doc_id) for r in queries()["hybrid_semantic_only"](spark, small).collect()}
    assert len({(r.question_id, r.doc_id) for r in got} & want) >= 0.9 * len(want)


def test_codes_of_a_cell_stand_together_and_questions_of_a_block_meet_them_at_once(spark, monkeypatch):
    rows = clusters(900, 3, 8)
    vectors = spark.createDataFrame(rows, VECTORS).repartition(30)
    q = quantised.fit(vectors, 3, 2)
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    quantised.write_index(vectors, q, path)
    blocks = spark.read.schema(quantised.BLOCKS).parquet(path)
    assert blocks.count() <= 3 * 4 and sum(len(r.docs) for r in blocks.collect()) == 900
    asked = spark.createDataFrame([(k, rows[k][1], f"o{k % 5}", k == 3) for k in range(50)], ASKED)
    told = lambda df: sorted((r.question_id, r.doc_id, r.similarity, r.semantic_rank, r.cells_read) for r in df.collect())
    whole = told(quantised.search(asked, blocks, vectors, q, 5, short=8, first=1))
    monkeypatch.setattr(quantised, "QUESTION_ROWS", 7)
    assert told(quantised.search(asked, blocks, vectors, q, 5, short=8, first=1)) == whole and len(whole) == 250
