"""Token counts by a lattice against every segmentation and a plain Viterbi; passages under a token budget; masked lists."""

import json

import public_tokenizers
import pytest

from tidewell.functions.lattice import LOST, MARK, TokenCount, best_path, vocabulary, with_tokens
from tidewell.operators import redaction
from tidewell.plans import queries
from tidewell.sources.tables import governed_documents, table

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def every_cut(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        for rest in every_cut(word[k:]):
            yield [word[:k], *rest]


def plain(word, scores):
    """Forward Viterbi over all starts, without a limit on pieces."""
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        ways = []
        for start in range(end):
            piece = word[start:end]
            score = scores.get(piece, LOST * len(piece.encode()) if end - start == 1 else None)
            if score is not None:
                ways.append((best[start][0] + score, end - start, best[start][1] + [piece]))
        top = max(ways, key=lambda x: (x[0], x[1]))
        best.append((top[0], top[2]))
    return best[-1][1]


def test_the_best_of_all_cuts():
    scores = {"a": -3.0, "b": -3.0, "ab": -4.0, "abc": -9.0, "bc": -2.5, "c": -1.0, "ca": -1.5}
    for word in ("abcabc", "xabc", "bca", "cab", "aé", ""):
        score = lambda cut: sum(scores.get(p, LOST * len(p.encode()) if len(p) == 1 else float("-inf")) for p in cut)
        assert score(best_path(word, scores, 3)) == max(map(score, every_cut(word)))


def test_counts_equal_a_plain_viterbi(spark):
    scores, _ = vocabulary(PATH)
    words = {w for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect() for w in (r.text or "").split()}
    some = sorted(words)[::7]
    count = TokenCount(PATH)
    assert len(some) > 1000
    for w in [*some, "\U0001f9ff", "日本語", "x" * 300]:
        assert count.word(w) == sum(1 if p in scores else len(p.encode()) for p in plain(MARK + w, scores))
    docs = spark.createDataFrame([(1, None, 5), (2, " \n", 5), (3, "the cat the cat", 5), (3, "the cat the cat", 5)], "doc_id long, text string, tokens int")
    assert sorted(r.tokens for r in with_tokens(docs, PATH).collect()) == [0, 0, 2 * count("the cat"), 2 * count("the cat")]


def test_no_passage_is_over_the_window_and_nothing_is_lost(spark):
    rows = queries.chunk_documents_by_tokens(spark, SF).collect()
    assert len(rows) > 1000 and max(r.tokens for r in rows) <= queries.TOKEN_WINDOW
    kept = {}
    for r in rows:
        kept[r.doc_id] = kept.get(r.doc_id, 0) + r.tokens
    count = TokenCount(PATH)
    for r in table(spark, SF, "documents").collect():
        if len(r.text or "") < 4000 and max(map(len, (r.text or "x").split() or ["x"])) < 200:
            assert kept.get(r.doc_id, 0) == pytest.approx(count(r.text), rel=0.02, abs=2)


def test_masked_lists_stand_in_the_boundary_record(spark):
    docs = governed_documents(spark, SF).where("deleted_at is null and classification = 'PUBLIC'")
    want = {}
    for r in redaction.redact(docs.select("owner_id", "doc_id", "text"), "owner_id", "doc_id").collect():
        for f in r.findings:
            want.setdefault(r.owner_id, {}).setdefault(f.label, set()).add(f.value)
    rows = {r.owner_id: json.loads(r.masked) if r.masked else [] for r in queries.masked_boundary_record(spark, SF).collect()}
    assert want and {o for o, m in rows.items() if m} == set(want)
    for o, labels in want.items():
        assert {m["label"]: m["count"] for m in rows[o]} == {k: len(v) for k, v in labels.items()}
        assert [-m["count"] for m in rows[o]] == sorted(-m["count"] for m in rows[o])


def test_a_growing_passage_is_not_measured_again_with_each_part():
    import random

    from tidewell.operators import chunking

    rng = random.Random(8)
    count = TokenCount(PATH)
    for _ in range(40):
        text = "".join(rng.choice(["a dog ", "Words. ", "x\u00e9y! ", "\n\n", " \n \n", "q" * 90 + " ", "one two three? "]) for _ in range(rng.randint(0, 300)))
        for measure, target, maximum in ((count, 40, 50), (len, 160, 200)):
            seen = []
            assert chunking.pack(text, lambda t, m=measure: seen.append(t) or m(t), target, maximum) == chunking.pack(text, measure, target, maximum)
    told = []

    class Told(TokenCount):
        def __call__(self, text):
            told.append(len(text))
            return super().__call__(text)

    text = "\n\n".join(f"part {k}" for k in range(2000))
    assert len(chunking.pack(text, Told(PATH), 3000, 4000)) >= 2 and sum(told) < 4 * len(text)
