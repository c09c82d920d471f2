"""Language profiles on held-out documents; versioned tables that replace by key."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidewell.operators import language, versioned
from tidewell.sources.shared import shared_folder
from tidewell.sources.tables import table


def test_held_out_documents_are_told_apart(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "lang", "text")
    fitted = language.profiles(language.gram_counts(docs.where("doc_id % 5 <> 0")))
    assert fitted.groupBy("lang").count().agg(F.max("count")).first()[0] <= language.GRAMS
    out = language.detect_languages(docs.where("doc_id % 5 = 0"), fitted).where("detected is not null")
    row = out.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("detected")).cast("int")).alias("right")).first()
    assert row.n > 1800 and row.right >= 0.95


def test_short_odd_and_repeated_texts(spark):
    known = [("en", "the cat and the dog went there " * 9), ("en", "the cat"), ("es", "el gato y el perro fueron allí " * 9), (None, "zzz" * 99), ("de", None)]
    fitted = language.profiles(language.gram_counts(spark.createDataFrame(known, "lang string, text string")))
    rows = [(1, "the dog and the cat", 1), (2, None, 1), (3, "", 1), (4, "the dog and the cat went to the other one there", 1), (5, "el perro y el gato fueron a la casa del otro perro", 1), (6, "ж" * 80, 1), (4, "the dog and the cat went to the other one there", 2), (7, " " * 60, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, detected int")
    got = sorted((r.doc_id, r.detected) for r in language.detect_languages(docs, fitted).collect())
    assert got == [(1, None), (2, None), (3, None), (4, "en"), (4, "en"), (5, "es"), (6, None), (7, None)]
    none = language.profiles(language.gram_counts(spark.createDataFrame([], "lang string, text string")))
    assert {r.detected for r in language.detect_languages(docs, none).collect()} == {None}


@pytest.fixture
def kept(spark):
    t = versioned.VersionedTable(spark, f"{shared_folder(spark)}/v-{uuid.uuid4().hex}")
    t.create(spark.createDataFrame([(k % 40 if k % 41 else None, k, "old") for k in range(400)], "doc_id long, chunk_index int, text string"), buckets=8)
    return t


def test_replacing_a_document_writes_its_bucket_alone(spark, kept):
    before = kept.manifest()["folders"]
    fresh = spark.createDataFrame([(7, 0, "new"), (7, 1, "new")], "doc_id long, chunk_index int, text string")
    assert kept.replace(fresh) == 2
    after = kept.manifest()["folders"]
    assert len({b for b in after if after[b] != before.get(b)}) == 1 and set(before) == set(after)
    rows = kept.read()
    assert sorted((r.chunk_index, r.text) for r in rows.where("doc_id = 7").collect()) == [(0, "new"), (1, "new")]
    assert rows.where("doc_id <> 7 or doc_id is null").exceptAll(kept.read(1)).count() == 0 and rows.count() == 400 - kept.read(1).where("doc_id = 7").count() + 2


def test_null_keys_removals_and_empty_changes(spark, kept):
    schema = "doc_id long, chunk_index int, text string"
    n = kept.read().where("doc_id is null").count()
    assert n > 1 and kept.replace(spark.createDataFrame([(None, 1, "one")], schema)) == 2
    assert [r.text for r in kept.read().where("doc_id is null").collect()] == ["one"]
    kept.replace(spark.createDataFrame([], schema), kept.read().select("doc_id").distinct())
    assert kept.read().count() == 0 and kept.read(1).count() == 400
    assert kept.replace(spark.createDataFrame([], schema)) == 3


def test_a_failed_write_leaves_the_old_version(spark, kept):
    fails = F.udf(lambda x: 1 // 0, "string")
    fresh = spark.createDataFrame([(7, 0, "new")], "doc_id long, chunk_index int, text string").withColumn("text", fails("text"))
    with pytest.raises(Exception, match="ZeroDivision|division"):
        kept.replace(fresh)
    assert kept.versions() == [1] and kept.read().where("text <> 'old'").count() == 0
    kept.replace(spark.createDataFrame([(7, 0, "new")], "doc_id long, chunk_index int, text string"))
    with pytest.raises(RuntimeError, match="another run"):
        kept._commit(2, kept.manifest())
    assert kept.read().where("text = 'new'").count() == 1
