"""Whitening: held against plain numpy over the whole table, and on small odd tables."""

import math

import numpy as np
import pytest

from tidewell.llm.common import table
from tidewell.llm.whitening import op13_whitening, whiten

SF = "/root/testdata/sf0.01"


def plain(vectors: list, counts: bool = False, most: int = 16):
    """n, sums, falling eigenvalues, axes and x of the rows, with Python's whole numbers for n and the sums."""
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors]
    fit = [list(t) for t in (map(tuple, x) if counts else dict.fromkeys(map(tuple, x)))]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    e, u = np.linalg.eigh(z.T @ z / n)
    return n, sums, e[::-1], u[:, ::-1], x


def held(got: dict, ids: list, vectors: list, counts: bool = False) -> None:
    n, sums, e, u, x = plain(vectors, counts)
    k = min(16, len(sums))
    assert len(got) == k * len(ids)
    for j in range(k):
        want = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x]) @ u[:, j] / math.sqrt(e[j])
        rows = [got[i, j + 1] for i in ids]
        have = np.array([r.whitened for r in rows])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
        assert all(r.n == n and abs(r.explained / (e[j] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9 for r in rows)
    for i, v in zip(ids, x, strict=True):
        assert got[i, 1].deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))


def test_query_equals_plain_numpy(spark):
    rows = [r for r in table(spark, SF, "embeddings").collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    out = op13_whitening(spark, SF)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    held({(r.vec_id, r.component): r for r in out.collect()}, [r.vec_id for r in rows], [r.embedding for r in rows])


@pytest.mark.parametrize("weights", ["one", "count"])
def test_copies_odd_vectors_and_clashing_columns(spark, weights):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(30, 5)).tolist()
    vectors += [vectors[0]] * 40 + [[c + 1e-4 for c in vectors[1]]]
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0]]
    rows = [(k, v, 1, 2.0) for k, v in enumerate(vectors + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, x double").repartition(7)
    got = {(r.vec_id, r.component): r for r in whiten(df, weights=weights).collect()}
    held(got, list(range(len(vectors))), vectors, weights == "count")


def test_flat_lengths_apart_huge_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert whiten(frame([])).count() == 0 and whiten(frame([(1, None), (2, [float("nan")])])).count() == 0
    assert whiten(frame([(1, [1.0, 2.0]), (None, [1.0, 2.0])])).count() == 0  # no variance
    line = whiten(frame([(None, [float(k), 1.0, 2.0 * k]) for k in range(4)])).collect()
    assert [(r.vec_id, r.component) for r in line] == [(None, 1)] * 4 and line[0].explained == pytest.approx(1)
    two = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [2.0, 5.0]), (4, [1.0]), (5, [2.0])]
    got = {(r.vec_id, r.component): r for r in whiten(frame(two)).collect()}
    assert len(got) == 8 and got[1, 1].n == 3 and got[5, 1].n == 2 and abs(got[5, 1].whitened) == pytest.approx(1)
    huge = {(r.vec_id, r.component): r for r in whiten(frame([(1, [1e12, 0.0]), (2, [-1e12, 3.0]), (3, [0.0, 1e30])])).collect()}
    x = [[64 * 10**12, 0], [-64 * 10**12, 192], [0, 2**62]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for i, v in enumerate(x):
        assert int(huge[i + 1, 1].deviation) == sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True))
