"""The pipeline against a plain restatement of each stage, on documents that hold one planted case each."""

import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_simhash import brute_fingerprint, components
from tests.llm.test_text_operators import brute_hits, plain_base_spans, plain_features
from tidewell.llm import bpe, quality, secrets


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choices([f"word{k}" for k in range(400)], k=n)) + "."
    junk = lambda n: " ".join(w.upper() + "!!" for w in rng.choices("buy cheap now".split(), k=n))
    items = [(k, prose(20)) for k in range(3)]
    texts = [prose(120) if k % 3 else junk(60) for k in range(90)]
    texts += [texts[1], texts[1] + " end", f"{prose(30)} {items[0][1]} {prose(30)}", f"{prose(400)} {items[1][1][:-1]}", f"{prose(50)} password=hunter2secret {prose(50)}", "", None]
    docs = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    labels = [(k, int(k % 3 > 0), 0) for k in range(90)]
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {d[0]: d[1] or "" for d in docs}, items


def test_run_equals_the_stages_restated(spark, tables):
    folder, texts, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    weights = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))

    def score(text):
        at = plain_features(text)
        logit = weights[at].sum() * quality.SCALE / max(1, len(at)) + weights[-1]
        return 1 / (1 + np.exp(-logit))

    left = [d for d in sorted(texts) if score(texts[d]) >= quality.THRESHOLD]
    assert not any(d % 3 == 0 for d in left if d < 90 and zlib.crc32(str(d).encode()) % 5 == 0)
    first = components([brute_fingerprint(texts[d]) for d in left])
    left = [d for k, d in enumerate(left) if first[k] == k]
    assert 1 in left and 90 not in left
    hits = dict(zip(left, brute_hits([texts[d] for d in left], items), strict=True))
    left = [d for d in left if not (hits[d][1] and 20 * hits[d][1] >= hits[d][0])]
    assert 92 not in left and 93 in left and 94 in left
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = {}
    for d in left:
        masked, at = "", 0
        for start, _, _, end in plain_base_spans(texts[d]):  # the texts hold no others, and these do not overlap
            masked, at = masked + texts[d][at:start] + "<SECRET>", end
        want[d] = library.encode(masked + texts[d][at:], add_special_tokens=False).ids
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want
    assert "<SECRET>" in secrets.redact(texts[94], secrets.base_spans(texts[94])) and not re.search("hunter2", secrets.redact(texts[94], secrets.base_spans(texts[94])))


def test_stages_keep_columns_and_stand_odd_tables(spark, tables):
    folder, _, _ = tables
    schema = "doc_id long, text string, lang string, source string, n_chars int, doc string, score int, spans string"
    rows = [(1, None, None, None, None, "d", 1, "s"), (1, None, None, None, None, "d", 1, "s"), (None, "a b c", "en", "x", 5, "d", 1, "s"), (3, "word1 token=abcdefgh " * 4000, "en", "x", 84000, "d", 1, "s")]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, folder)
            assert out.count() <= table.count(), name
            if name != "tokens":
                assert out.columns == table.columns, name


def test_one_row_stays_of_each_group_whatever_its_id(spark):
    rng = random.Random(3)
    a, b, c, d, e = (" ".join(rng.choices([f"word{k}" for k in range(400)], k=150)) for _ in range(5))
    rows = [(5, a), (5, b), (6, b), (7, b), (None, c), (None, d), (None, a), (8, e), (8, e), (8, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(5, a), (5, b), (None, c), (None, d), (8, e), (8, None)], key=repr)
