"""Early stopping gives the rows of full sums, reads less, and question blocks meet vector blocks."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import lexical, retrieval
from tidewell.sources.shared import shared_folder
from tidewell.sources.tables import governed_documents, questions


def told(df):
    return sorted((r.question_id, tuple(r.key), round(r.score, 6), r.place) for r in df.collect())


@pytest.mark.parametrize("limits, pool", [((64, 4, 128), 10), ((3, 2, 5), 1)])
def test_a_walk_gives_the_rows_of_full_sums(spark, small, monkeypatch, limits, pool):
    for name, value in zip(("HEAD", "LAYERS", "BLOCK"), limits, strict=True):
        monkeypatch.setattr(lexical, name, value)
    docs = governed_documents(spark, small)
    path = f"{shared_folder(spark)}/walk-{uuid.uuid4().hex}"
    lexical.write_blocks(docs, path, ["doc_id"], buckets=5)
    short = questions(spark, small).withColumn("question", F.array_join(F.slice(F.split("question", " "), 1, 1 + (F.col("question_id") % 5).cast("int")), " "))
    for asked in (questions(spark, small), short):
        wanted = retrieval.asked_terms(asked)
        full = lexical.best_of_texts(wanted, docs, ["doc_id"], pool, retrieval.may_see())
        assert told(lexical.best(wanted, lexical.Blocks(spark, path), pool, retrieval.may_see())) == told(full)
    scope = docs.where("doc_id % 3 = 0").select(F.explode(F.array(*map(F.lit, range(0, 40, 7)))).alias("question_id"), F.struct("doc_id").alias("key"))
    inside = lexical.best(wanted, lexical.Blocks(spark, path), pool, retrieval.may_see(), scope)
    assert told(inside) == told(lexical.best_of_texts(wanted, docs, ["doc_id"], pool, retrieval.may_see(), scope)) and inside.count() > 0


def test_rare_words_spare_the_blocks_of_common_ones(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["the", "of"] * rng.randint(1, 5) + [f"w{rng.randint(0, 3000)}" for _ in range(30)] + (["needle"] * 3 if k % 90 == 0 else [])), "", "PUBLIC", "a", None) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, classification string, owner_id string, deleted_at timestamp")
    path = f"{shared_folder(spark)}/spare-{uuid.uuid4().hex}"
    lexical.write_blocks(docs, path, ["doc_id"])
    assert lexical.Blocks(spark, path).read("blocks").agg(F.max(F.size("postings"))).first()[0] < 3 * lexical.BLOCK
    asked = spark.createDataFrame([(1, "the needle of", "a", False)], "question_id long, question string, viewer_id string, is_admin boolean")
    wanted = spark.createDataFrame([(1, t, "a", False) for t in ("the", "needle", "of")], "question_id long, term string, viewer_id string, is_admin boolean")
    seen = lexical.walked(wanted, lexical.Blocks(spark, path), 10, retrieval.may_see()).first()
    assert seen.blocks_held > 40 and seen.blocks_read < seen.blocks_held / 10
    assert told(lexical.best(wanted, lexical.Blocks(spark, path), 10, retrieval.may_see())) == told(lexical.best_of_texts(wanted, docs, ["doc_id"], 10, retrieval.may_see()))
    assert lexical.best(retrieval.asked_terms(asked.limit(0)), lexical.Blocks(spark, path), 10, retrieval.may_see()).count() == 0


def test_question_blocks_meet_vector_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    known = [(k, [float(x) for x in rng.integers(-2, 3, 4)] if k % 29 else None, "RESTRICTED" if k % 3 == 0 else "PUBLIC" if k % 2 else None, f"o{k % 4}" if k % 5 else None) for k in range(400)]
    known += [(1000, [1.0, 2.0], "PUBLIC", "o1"), (1001, [0.0] * 4, "PUBLIC", "o1")]
    asked = [(q, [float(x) for x in rng.integers(-2, 3, 4) + 0.5], f"o{q % 4}" if q % 3 else None, q % 10 == 0) for q in range(60)]
    frame = spark.createDataFrame(known, "doc_id long, embedding array<double>, classification string, owner_id string").repartition(5)
    ask = spark.createDataFrame(asked, "question_id long, vector array<double>, viewer_id string, is_admin boolean")
    want = []
    for q, v, viewer, admin in asked:
        rows = []
        for d, x, tier, owner in known:
            if x is not None and len(x) == 4 and any(x) and (tier != "RESTRICTED" or admin or (owner is not None and owner == viewer)):
                rows.append((-round(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 7), d))
        want += [(q, d, place) for place, (_, d) in enumerate(sorted(rows)[:20], 1)]
    for block, size in ((1000, 2 << 20), (7, 900)):
        monkeypatch.setattr(retrieval, "QUESTION_BLOCK", block)
        monkeypatch.setattr(retrieval, "VECTOR_BYTES", size)
        got = retrieval.semantic_arm(ask, frame, 20).withColumn("similarity", F.round("similarity", 7)).collect()
        assert sorted((r.question_id, r.doc_id, r.semantic_rank) for r in got) == sorted(want)
    nobody = ask.withColumn("viewer_id", F.lit(None).cast("string")).withColumn("is_admin", F.lit(None).cast("boolean"))
    assert retrieval.semantic_arm(nobody, frame, 5).join(frame.where("classification = 'RESTRICTED'"), "doc_id").count() == 0
    assert retrieval.semantic_arm(ask.limit(0), frame, 5).count() == retrieval.semantic_arm(ask, frame.limit(0), 5).count() == 0


@pytest.mark.parametrize("hot, file, segment", [(500_000, 2_000_000, 4_000_000), (40, 300, 500)])
def test_an_index_is_written_by_one_shuffle_of_segments(spark, monkeypatch, hot, file, segment):
    for name, value in zip(("HOT", "FILE_POSTINGS", "SEGMENT_TERMS"), (hot, file, segment), strict=True):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["the", "of", "a\u00e9", "\U0001d400x", f"w{rng.randint(0, 60)}"]) for _ in range(n))
    rows = [(k, words(rng.randint(0, 40)) or None, words(3), rng.choice(["PUBLIC", "RESTRICTED", None]), rng.choice(["a", "b", None]), None) for k in range(250)]
    rows += [rows[5], (5, rows[5][1] + " the w1", *rows[5][2:]), (7, "the w2", "of", "PUBLIC", "z", None), (None, "the w3", "t", None, None, None), (None, "the w3", "t", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, classification string, owner_id string, deleted_at timestamp").repartition(3)
    path = f"{shared_folder(spark)}/once-{uuid.uuid4().hex}"
    lexical.write_blocks(docs, path, ["doc_id"], buckets=3)
    old = lexical.weighed(lexical.counted_terms(docs, ["doc_id"], lexical.FIELDS))
    new = lexical.Blocks(spark, path).above(old.select("term", F.lit(0.0).alias("least")).distinct())
    flat = lambda df: sorted((r.term, str(r.key), str(r.classification), str(r.owner_id), round(r.impact, 9)) for r in df.collect())
    assert flat(new.select(old.columns)) == flat(old)
    wanted = spark.createDataFrame([(q, t, v, q == 2) for q, v in ((1, "a"), (2, None), (3, "b")) for t in ("the", "w1", "w2", "a\u00e9", "none")], "question_id long, term string, viewer_id string, is_admin boolean")
    full = lexical.best_of_texts(wanted, docs, ["doc_id"], 6, retrieval.may_see())
    assert told(lexical.best(wanted, lexical.Blocks(spark, path), 6, retrieval.may_see())) == told(full)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    names = [f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    assert not any(n.startswith(("tidewell-figures", "tidewell-postings", "tidewell-layers")) for n in names)
    empty = f"{shared_folder(spark)}/none-{uuid.uuid4().hex}"
    lexical.write_blocks(docs.limit(0), empty, ["doc_id"])
    assert lexical.best(wanted, lexical.Blocks(spark, empty), 6, retrieval.may_see()).count() == 0
