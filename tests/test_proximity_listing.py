"""Nearness against a search of all windows, its failure path, and listings read in pages and resumed."""

import random
import uuid

from pyspark.sql import functions as F

from tidewell.operators import proximity
from tidewell.sources import listing
from tidewell.sources.shared import shared_folder


def brute(wanted, text):
    words = proximity.WORD.findall((text or "").lower())
    held = set(wanted) & set(words)
    if not held:
        return 0.0
    least = min(j - i for i in range(len(words)) for j in range(i + 1, len(words) + 1) if held <= set(words[i:j]))
    return round(len(held) / len(set(wanted)) * (1 + len(held) / least) / 2, 6)


def test_nearness_equals_a_search_of_all_windows():
    rng = random.Random(4)
    for _ in range(300):
        text = " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 25)))
        wanted = [rng.choice("abcxyz") for _ in range(rng.randint(1, 4))]
        assert proximity.nearness(wanted, text) == brute(wanted, text)
    assert proximity.nearness([], "a b") == proximity.nearness(["a"], None) == 0.0
    assert proximity.nearness(["alpha", "beta"], "Beta, alpha") == 1.0


def test_a_missing_score_leaves_the_fused_order(spark):
    found = spark.createDataFrame([(q, d, d) for q in (1, 2, 3) for d in (1, 2, 3)], "question_id long, doc_id long, fusion_rank int")
    scores = [(1, 1, 0.1), (1, 2, 0.9), (1, 3, 0.9), (2, 1, 0.1), (2, 2, None), (2, 3, 0.9), (3, 1, 0.1), (3, 2, float("nan")), (3, 3, 0.5)]
    got = proximity.reranked(found, spark.createDataFrame(scores, "question_id long, doc_id long, rerank_score double"), 2).collect()
    order = {q: [(r.doc_id, r.rerank_score) for r in sorted(got, key=lambda r: r.position) if r.question_id == q] for q in (1, 2, 3)}
    assert order == {1: [(2, 0.9), (3, 0.9)], 2: [(1, None), (2, None)], 3: [(1, None), (2, None)]}
    partly = proximity.reranked(found, spark.createDataFrame(scores[:2], "question_id long, doc_id long, rerank_score double"), 3)
    assert partly.where("rerank_score is not null").count() == 0 and partly.count() == 9


def test_a_stream_goes_on_from_its_checkpoint_and_sees_whole_pages(spark):
    folder = f"{shared_folder(spark)}/l-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(k if k % 9 else None, f"u{k}") for k in range(50)], "id long, url string")
    assert listing.read_listing(spark, folder, "id long, url string").count() == 0
    page = F.floor(F.col("id") / 10).cast("int")
    listing.write_pages(rows.where("id < 30 or id is null"), folder, page, 3)
    rows.where("id >= 30").withColumn("page", page).write.mode("append").partitionBy("page").parquet(folder)  # no marker yet
    first = rows.where("id < 30 or id is null").count()
    seen = []

    def run():
        def batch(df, number):
            seen.append(df.count())

        source = listing.read_listing(spark, folder, "id long, url string, more string", stream=True)
        source.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start().awaitTermination()
        return sum(seen)

    assert listing.read_listing(spark, folder, "id long, url string").count() == first == run()
    assert run() == first
    listing.write_pages(rows.limit(0), folder, page, 5)
    assert run() == 50 and seen[-1] == 50 - first
    assert listing.read_listing(spark, folder, "id long, more string").where("more is null").count() == 50


def test_stacked_pieces_are_one_block(spark):
    from tidewell.operators import layout

    box = lambda word, x, y, w=20.0, h=8.0: (1, word, x, y, x + w, y + h)
    words = [box("Raw", 0.0, 0.0), box("coal", 0.0, 12.0), box("Boiler", 100.0, 0.0), box("hot", 122.0, 1.0), box("Zeta", 100.0, 13.0), box("alone", 0.0, 60.0), box("left", 60.0, 60.0), box("under", 61.0, 73.0), *(box(f"n{k}", 300.0, 12.0 * k) for k in range(40))]
    frame = spark.createDataFrame(words, "page long, word string, x1 double, y1 double, x2 double, y2 double")
    got = {r.text: r.pieces for r in layout.text_blocks(frame, "page").collect()}
    assert got == {"Raw\ncoal": 2, "Boiler hot\nZeta": 2, "alone": 1, "left\nunder": 2, "\n".join(f"n{k}" for k in range(40)): 40}
    assert layout.text_blocks(frame.limit(0), "page").count() == 0
