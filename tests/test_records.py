from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import lifecycle, ann, grids, records, retrieval

NOW = datetime(2024, 6, 1)
SCHEMA = "doc_id long, sha256 string, status string, owner_id string, classification string, deleted_at timestamp, purged_at timestamp"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_decisions(spark):
    rows = [
        (1, "a", "LIVE", "A", "PUBLIC", None, None),
        (2, "b", "LIVE", "B", "RESTRICTED", None, None),
        (3, "c", "LIVE", "B", None, None, None),
        (4, None, "LIVE", "A", "PUBLIC", NOW, NOW),
        (5, "d", "LIVE", "A", "RESTRICTED", NOW, None),
        (6, "e", "SUPERSEDED", "A", "PUBLIC", NOW, None),
        (7, "f", "LIVE", None, "PUBLIC", NOW, None),
    ]
    df = docs_of(spark, rows)
    me, no, yes = F.lit("A"), F.lit(False), F.lit(True)
    codes = lambda c: [r[0] for r in df.orderBy("doc_id").select(c).collect()]
    assert codes(records.reclassify_decision(df, me, no, F.lit("RESTRICTED"))) == [200, 404, 403, 410, 409, 200, 403]
    assert codes(records.reclassify_decision(df, me, yes, F.lit("RESTRICTED"))) == [200, 409, 200, 410, 409, 200, 200]
    assert codes(records.delete_decision(df, me, no, F.col("doc_id") == 1)) == [409, 404, 403, 404, 200, 200, 403]
    assert codes(records.restore_decision(df, me, no, F.lit(False))) == [409, 404, 403, 410, 200, 409, 403]


def test_erasure_takes_copies_and_spares_busy_documents(spark):
    df = docs_of(spark, [(1, "h", "LIVE", "A", "PUBLIC", None, None), (2, "h", "DUPLICATE", "B", "PUBLIC", None, None), (3, "h", "LIVE", "B", "PUBLIC", None, None), (4, "k", "LIVE", "A", "PUBLIC", None, None), (5, None, "LIVE", "A", "PUBLIC", NOW, NOW)])
    chunks = spark.createDataFrame([(1, 0), (1, 1), (4, 0)], "doc_id long, chunk_index int")
    jobs = spark.createDataFrame([(10, 1, "PENDING"), (11, 4, "RUNNING"), (12, 4, "PENDING"), (13, 1, "DONE")], "job_id int, doc_id long, status string")
    asked = spark.createDataFrame([(1,), (4,), (5,), (99,)], "doc_id long")
    after, left, failed = records.erase(df, chunks, jobs, asked, F.lit(NOW))
    assert {r.doc_id: (r.sha256, r.purged_at is not None) for r in after.collect()} == {1: (None, True), 2: (None, True), 3: ("h", False), 4: ("k", False), 5: (None, True)}
    assert [(r.doc_id, r.chunk_index) for r in left.collect()] == [(4, 0)]
    assert {r.job_id: r.status for r in failed.collect()} == {10: "FAILED", 11: "RUNNING", 12: "PENDING", 13: "DONE"}


def test_status_replacement_and_flips(spark):
    df = docs_of(spark, [(1, "h", "LIVE", "A", None, None, None), (2, "h", "DUPLICATE", "A", None, None, None), (3, "x", "DUPLICATE", "A", None, None, None)])
    audit = spark.createDataFrame([(1, NOW, 5, "a"), (1, NOW, 6, "b")], "doc_id long, ts timestamp, event_id long, event_type string")
    got = {r.doc_id: (r.last_event, r.duplicate_of) for r in records.document_status(df, audit).collect()}
    assert got == {1: ("b", None), 2: (None, 1), 3: (None, None)}
    stored, fresh = (spark.createDataFrame(r, "doc_id long, chunk_index int") for r in ([(1, 0), (1, 1), (2, 0)], [(1, 0), (3, 0)]))
    assert sorted((r.doc_id, r.chunk_index) for r in records.replace_chunks(stored, fresh).collect()) == [(1, 0), (2, 0), (3, 0)]


def test_document_search_needs_every_term(spark):
    df = spark.createDataFrame([(1, "Emission norms", "report_2024.pdf", "coal"), (2, "Coal norms", "x.pdf", None), (3, None, "emission-norms.docx", "")], "doc_id long, title string, filename string, description string")
    asked = spark.createDataFrame([(1, "norms emission"), (2, "coal"), (3, "?")], "question_id long, question string")
    got = {(r.question_id, r.doc_id): r["rank"] for r in records.search_documents(df, asked).collect()}
    assert got == {(1, 1): 2.0, (1, 3): 0.8, (2, 1): 0.2, (2, 2): 1.0}


def test_cells_headers_and_rendering(spark):
    values = [(9910257052.0, None), (0.5, None), (1234.5678901234567, None), (0.12345, "0.00%"), (None, None), (3.0, "0%")]
    df = spark.createDataFrame([(k, *v) for k, v in enumerate(values)], "k int, v double, f string")
    assert [r[0] for r in df.orderBy("k").select(grids.number_cell(F.col("v"), F.col("f"))).collect()] == ["9910257052", "0.5", "1234.567890123457", "12.35%", "", "300%"]
    rows = [["Title", "", ""], [], ["a", "b", None], ["1\n2", "x", "y"], ["3", "", "z"]]
    out = grids.render_tables(spark.createDataFrame([(1, rows), (2, [["only", "header"]]), (3, [])], "k int, rows array<array<string>>"), "k").collect()
    assert {r.k: r.text for r in out} == {1: "Title\na | b | \n1; 2 | x | y\n3 |  | z", 2: "only | header"}
    heads = spark.createDataFrame([(["SO2", "SO2", "unit"], ["< 500", ">= 500", "unit"])], "a array<string>, b array<string>")
    assert heads.select(grids.merge_headers(F.col("a"), F.col("b"))).first()[0] == ["SO2 < 500", "SO2 >= 500", "unit"]


def test_headers_of_several_rows(spark):
    none, group, tall, title = None, (1, 0, 1, 2), (1, 2, 2, 1), (0, 0, 1, 3)
    two = [["Limits", "Limits", "Limits"], ["SO2", "SO2", "unit"], ["< 500", ">= 500", "unit"], ["1", "2", "mg"]]
    spans = [[title] * 3, [group, group, tall], [none, none, tall], [none] * 3]
    three = [["a", "x"], ["b", "x"], ["", "x"], ["1", "2"]]
    high = [[none, (0, 1, 3, 1)]] * 3 + [[none, none]]
    cases = [
        (two, spans, [two[0], ["SO2 < 500", "SO2 >= 500", "unit"], two[3]]),
        (three, high, [["a b", "x"], ["1", "2"]]),
        (three[:3], high[:3], three[:3]),
        (three, [[none, (0, 1, 4, 1)]] * 4, three),
        (two, [[none] * 3] * 4, two),
        ([["t", "t"]], [[(0, 0, 1, 2)] * 2], [["t", "t"]]),
        ([["one"], ["two"]], [[(0, 0, 1, 1)], [none]], [["one"], ["two"]]),
        ([], [], []),
        (None, None, None),
    ]
    df = spark.createDataFrame([(k, r, s) for k, (r, s, _) in enumerate(cases)], "k int, rows array<array<string>>, spans array<array<struct<row int, col int, height int, width int>>>")
    assert [r[0] for r in df.orderBy("k").select(grids.flat_header(F.col("rows"), F.col("spans"))).collect()] == [want for *_, want in cases]


def test_pictures(spark):
    pics = spark.createDataFrame([(1, k, c) for k, c in enumerate(["logo"] * 3 + ["a", "a", "b"])], "doc int, place int, content string")
    assert [r.content for r in grids.drop_logos(pics, "doc", "content").orderBy("place").collect()] == ["a", "b"]
    heads = spark.createDataFrame([(1, 0, "H"), (1, 1, "X"), (1, 1, "Y")], "doc int, unit int, text string")
    items = spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 1, "Y"), (1, 2, None)], "doc int, unit int, heading string")
    assert sorted(str(r.section) for r in grids.place_in_section(items, heads, "doc", "unit").collect()) == ["H", "None", "None", "Y"]


@pytest.mark.parametrize("probes", [1, 4])
def test_the_index_finds_what_may_be_seen(spark, probes):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 16)) * 4
    rows = [(k, (centre[k % 4] + rng.normal(size=16)).tolist()) for k in range(200)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    docs = spark.createDataFrame([(k, "RESTRICTED" if k % 2 else "PUBLIC", "A", None) for k in range(200)], "doc_id long, classification string, owner_id string, deleted_at timestamp")
    asked = spark.createDataFrame([(k, rows[k][1], "B", k == 4) for k in (0, 1, 4)], "question_id long, vector array<double>, viewer_id string, is_admin boolean")
    centres = ann.fit_centroids(vectors, 4)
    found = ann.search(asked, ann.index(vectors, centres), docs, centres, 5, probes)
    exact = retrieval.semantic_arm(asked, vectors.join(docs, "doc_id"), 5)
    got = {r.question_id: (r.expected, r.hit) for r in ann.recall(found, exact).collect()}
    assert all(v == (5, 5) for v in got.values()) and len(got) == 3
    assert all(r.doc_id % 2 == 0 for r in found.where("question_id <> 4").collect())


def test_a_search_of_the_index_makes_no_row_of_a_pair(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 8) + 0.5]) for k in range(300)] + [(400, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    docs = spark.createDataFrame([(k, "RESTRICTED" if k % 3 == 0 else None, f"o{k % 4}" if k % 5 else None, None) for k, _ in rows], "doc_id long, classification string, owner_id string, deleted_at timestamp").repartition(6)
    asked = spark.createDataFrame([(k, rows[k][1], f"o{k % 4}" if k % 2 else None, k == 9) for k in range(40)] + [(50, None, "o1", True), (51, [1.0], "o1", True)], "question_id long, vector array<double>, viewer_id string, is_admin boolean")
    centres = ann.fit_centroids(vectors, 6)
    found = ann.search(asked, ann.index(vectors, centres), docs, centres, 7, 6)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
    exact = retrieval.semantic_arm(asked.where("question_id < 50"), vectors.join(docs, "doc_id"), 7)
    told = lambda df: sorted((r.question_id, r.doc_id, r.semantic_rank) for r in df.collect())
    assert told(found) == told(exact) and len(told(found)) == 280


@pytest.mark.parametrize("width", [5, 64])
@pytest.mark.parametrize("askers", [0, 32])
def test_the_nearest_of_many_blocks_are_the_nearest_of_all(width, askers, monkeypatch):
    monkeypatch.setattr(retrieval, "ASKERS", askers)
    rng = np.random.default_rng(6)
    ask, known = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.integers(-1, 2, (30, 12)) + 0.3, rng.integers(-1, 2, (640, 12)) + 0.3))
    known[100:160] = known[7] * (1 + 1e-11)
    docs, so_far, got = rng.permutation(640), retrieval.nothing(30, 9), []
    rights = {"viewers": [f"o{k % 3}" if k % 4 else None for k in range(30)], "admins": [k == 5 for k in range(30)], "ids": list(range(30))}
    tiers, owners = (rng.random(640) < 0.7).tolist(), [f"o{k % 9}" if k % 2 else None for k in range(640)]
    for at in range(0, 640, width):
        part = slice(at, at + width)
        q, d, s = retrieval.best_of(rights | {"asked": ask.tobytes(), "known": known[part].tobytes(), "docs": docs[part].tolist(), "open": tiers[part], "owners": owners[part]}, 9, so_far)
        got += zip(q.tolist(), (-s).tolist(), d.tolist(), strict=True)
    for row in range(30):
        may = [k for k in range(640) if tiers[k] or row == 5 or (owners[k] is not None and owners[k] == rights["viewers"][row])]
        want = sorted((-round(float(ask[row] @ known[k]), 9), int(docs[k])) for k in may)[:9]
        assert [d for _, d in sorted((s, d) for q, s, d in got if q == row)[:9]] == [d for _, d in want]


def test_restorable_and_backfill_look_at_the_status(spark):
    rows = [(1, "LIVE", 1, None), (2, "LIVE", None, None), (3, "LIVE", 1, 2), (4, "SUPERSEDED", 1, None), (5, "DUPLICATE", 1, None), (6, "CHUNKED", 1, None)]
    df = spark.createDataFrame([(*r, "me") for r in rows] + [(7, "LIVE", 1, None, "you")], "doc_id long, status string, deleted_at long, purged_at long, owner_id string")
    ids = lambda out: sorted(r.doc_id for r in out.collect())
    assert ids(lifecycle.restorable(df, F.lit("me"), F.lit(False))) == [1, 6]
    assert ids(lifecycle.restorable(df, F.lit("me"), F.lit(True))) == [1, 6, 7]
    jobs = spark.createDataFrame([(9, "PENDING")], "doc_id long, status string")
    assert ids(lifecycle.backfill_candidates(df, jobs, "EMBED")) == [6]


def test_a_null_key_gets_an_event_once(spark):
    import uuid

    from tidewell.operators import sinks
    from tidewell.sources.shared import shared_folder

    folder, schema = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}", "event_id long, user_id long, event_type string, ts timestamp"
    events = spark.createDataFrame([(1, None, "login", NOW), (2, 5, "login", NOW), (3, None, "click", NOW)], schema)
    sinks.append_audit(events.limit(0), events, folder, "user_id", ("click",))
    again = spark.createDataFrame([(4, None, "login", NOW), (5, 5, "login", NOW), (6, None, "click", NOW), (7, 6, "login", NOW)], schema)
    sinks.append_audit(spark.read.parquet(folder), again, folder, "user_id", ("click",))
    assert sorted(r.event_id for r in spark.read.parquet(folder).collect()) == [1, 2, 3, 6, 7]
