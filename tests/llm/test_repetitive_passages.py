"""Substring dedup of repetitive texts: the same as brute force, in time in line with their length."""

import time
import tracemalloc

import numpy as np
import pytest
import xxhash
from tests.llm.test_text_operators import brute_passages, docs_of

from tidewell.llm import passages


def test_long_stretches_are_cut_and_windows_stay_whole():
    words = [b"w"] * 10_000
    vals, first, several = passages.anchors(words)
    assert len(set(vals.tolist())) == 1 and np.diff(first).max() == passages.STRETCH and several[:-1].all()
    sizes = np.diff(np.append(first, len(words) - passages.WINDOW + 1))
    assert sizes.max() <= passages.STRETCH and sizes.sum() == len(words) - passages.WINDOW + 1


@pytest.mark.parametrize("fit", [2_000, 0])
def test_repetitive_texts_equal_brute_force(spark, monkeypatch, fit):
    monkeypatch.setattr(passages, "FIT", fit)
    phrase = " ".join(f"p{k}" for k in range(9))
    other = " ".join(f"q{k}" for k in range(33))
    mixed = " ".join(f"{phrase} m{k} n{k}" for k in range(60))
    texts = ["x " * 700, "y " * 35, f"{phrase} " * 40, " ".join((f"{phrase} " * 40).split()[4:]), f"{other} " * 30, mixed, f"z {mixed}", " ".join(mixed.split()[100:400]), f"{phrase} u " * 3]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in passages.dedup_passages(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(brute_passages(texts)))


def test_a_million_repeated_words_take_time_in_line_with_their_number(spark):
    took = []
    for n in (1000, 250_000, 1_000_000):
        began = time.perf_counter()
        [r] = passages.dedup_passages(docs_of(spark, ["w " * n])).collect()
        took.append(time.perf_counter() - began)
        assert (r.n_words, r.n_removed) == (n, n)
    assert took[2] < 8 * took[1] + 2 and took[2] < 90, took


class Blind:
    """An automaton that finds nothing."""

    def __init__(self, *_):
        pass

    def add_word(self, _):
        pass

    def make_automaton(self):
        pass

    def iter(self, _):
        return iter(())


def contents_of(texts: list[str], copies: list[int]) -> list[list]:
    return [[7, bytes([k]), t.encode(), n] for k, (t, n) in enumerate(zip(texts, copies, strict=True))]


def test_the_automaton_finds_what_confirmation_does_not_mark(monkeypatch):
    w = [f"w{k}" for k in range(60)]
    # 0 is the first place of two passages that overlap; 1 and 2 confirm one each; 3 has a window of each of two first places
    texts = [" ".join(w), " ".join(["a", *w[:45]]), " ".join([*w[20:], "b"]), " ".join(["c", *w[1:36], "d"]), " ".join(f"u{k}" for k in range(50))]
    found = sorted(passages.locate(contents_of(texts, [1] * 5)))
    assert found == [(b"\0", 0, 60), (b"\1", 1, 46), (b"\2", 0, 40), (b"\3", 1, 36)]
    monkeypatch.setattr(passages.ahocorasick, "Automaton", Blind)
    assert list(passages.locate(contents_of(texts, [1] * 5))) == []


@pytest.mark.parametrize("compiled", [400_000, 1])
def test_random_contents_equal_a_plain_count(monkeypatch, compiled):
    monkeypatch.setattr(passages, "COMPILED", compiled)
    rng = np.random.default_rng(5)
    for _ in range(60):
        base = [[f"{s}{k}" for k in range(90)] for s in "ab"]
        texts = []
        for _ in range(int(rng.integers(2, 9))):
            parts: list[str] = []
            for _ in range(int(rng.integers(1, 4))):
                s, i, n = int(rng.integers(2)), int(rng.integers(80)), int(rng.integers(20, 60))
                parts += base[s][i : i + n] if rng.random() < 0.8 else ["x"] * n
            texts.append(" ".join(parts))
        copies = [int(n) for n in rng.integers(1, 3, len(texts)) // rng.integers(1, 3, len(texts))]
        copies = [max(1, n) for n in copies]
        count: dict[tuple, int] = {}
        windows = [[tuple(t.split()[p : p + 35]) for p in range(len(t.split()) - 34)] for t in texts]
        for ws, n in zip(windows, copies, strict=True):
            for x in ws:
                count[x] = count.get(x, 0) + n
        want = {(bytes([k]), p + j) for k, ws in enumerate(windows) for p, x in enumerate(ws) if count[x] > 1 for j in range(35)}
        got = {(d, j) for d, a, b in passages.locate(contents_of(texts, copies)) for j in range(a, b)}
        assert got == want


def test_a_worker_keeps_no_table_of_the_words_it_has_hashed():
    texts = [" ".join(f"w{k * 2000 + j}" for j in range(2000)) for k in range(50)]
    passages._anchor_rows(texts[:1])
    tracemalloc.start()
    try:
        before, _ = tracemalloc.get_traced_memory()
        for t in texts:
            passages._anchor_rows([t])
        kept = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert kept < 1_000_000, kept
    words = ["a", "é", "a", "\ud800"]
    words = [w.encode("utf-8", "surrogatepass") for w in words]
    assert passages.word_hashes(words).tolist() == [xxhash.xxh64_intdigest(w) for w in words]


def test_the_result_is_dealt_by_its_own_size_not_by_that_of_the_texts(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(10**9, size=4_000)) for _ in range(40)]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        passages.op2_passages(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    finally:
        for k in sizes:
            spark.conf.unset(k)
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    assert spark.read.parquet(str(tmp_path / "out")).where("n_words = 4000 and n_removed = 0").count() == 40
