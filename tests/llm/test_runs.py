"""Periodic runs: held against a search of every period, whole query and small cases."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tidewell.llm.common import table
from tidewell.llm.runs import EXPONENT, SHORTEST, _numbers, find_runs, op11_runs, runs_among

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def every_run(w: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by trying each period from each place."""
    found: dict = {}
    x = np.array(w, dtype=np.int64)
    for q in range(1, len(x) // EXPONENT + 1):
        same = np.concatenate([[0], x[:-q] == x[q:], [0]])
        for i, j in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist(), strict=True):
            if j + q - i >= max(SHORTEST, EXPONENT * q):
                found.setdefault((i, j + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def as_number(words: list) -> np.ndarray:
    return _numbers([str(w).encode() for w in words])


def test_runs_of_nested_repeats_are_all_found():
    r = random.Random(11)

    def piece(depth: int) -> list:
        if not depth:
            return [r.randrange(3) for _ in range(r.randrange(1, 5))]
        return sum((piece(depth - 1) * r.randrange(1, 7) for _ in range(r.randrange(1, 3))), [])

    for _ in range(60):
        texts = [piece(r.randrange(1, 4))[:300] for _ in range(8)] + [[r.randrange(2) for _ in range(r.randrange(80))] for _ in range(8)]
        got = runs_among([as_number(t) for t in texts])
        for t, found in zip(texts, got, strict=True):
            assert [tuple(x) for x in found.tolist()] == every_run(t)


def test_sums_beyond_one_prime_stay_exact():
    """Numbers so large that a sum of squares exceeds a prime: a multiple of the prime is no zero."""
    n = 400_000
    w = np.arange(1, n + 1, dtype=np.int64)
    w[n // 2 :] = w[n // 2 - 60_000 : n // 2].repeat(4)[: n - n // 2]
    w[n // 2 :] = np.tile(w[1000:51_000], 4)
    [found] = runs_among([w])
    assert (found[:, 2] == 50_000).sum() == 1 and found[-1].tolist() == [n // 2, 200_000, 50_000]


def test_repetitive_text_takes_time_in_line_with_its_length():
    took = []
    for n in (100_000, 400_000):
        began = time.process_time()
        [found] = runs_among([np.ones(n, np.int64)])
        took.append(time.process_time() - began)
        assert found.tolist() == [[0, n, 1]]
    assert took[1] < 8 * took[0]


def test_odd_rows_and_columns(spark):
    rows = [(1, None, "x"), (None, "", "x"), (2, "a b " * 5, "x"), (2, "a b " * 5, "x"), (3, " ".join(map(str, range(50_000))), "x"), (4, "ab ab " * 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((tuple(r) for r in find_runs(docs).collect()), key=str)
    runs = {1: [], None: [], 2: [(0, 10, 2)], 3: [], 4: [(0, 6, 1)]}
    assert len(got) == 6 and all([tuple(x) for x in r[2]] == runs[r[0]] for r in got)
    assert {r[0]: r[3] for r in got if r[0] != 3} == {1: "", None: "", 2: "a b", 4: "ab ab"}
    assert find_runs(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def told(spark):
    return {r.doc_id: r for r in op11_runs(spark, SF).collect()}


def test_query_equals_a_search_of_every_period(spark, told):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(docs) == len(told)
    planted = 0
    for r in docs:
        w = WORDS.findall(r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        number: dict = {}
        runs = every_run([number.setdefault(x, len(number)) for x in w])
        planted += h % 10 == 0 and bool(runs)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4))
        got = told[r.doc_id]
        assert want == (got.n_runs, got.start, got.length, got.period, got.exponent_milli), r.doc_id
        assert got.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert planted > 10
