"""Embedding whitening by weighted multiplicity covariance.

1. Entries become whole numbers x = floor(STEP * c) + SHIFT, in the JVM; vectors that are null or hold null or
   non-finite entries go.
2. Identical x vectors are one row with a count (combined before the shuffle, so a vector of a third of all rows is one
   row from each task). The fit gives each such row the weight one, or its count.
3. Sums of weights and of weighted x are exact whole numbers. A second pass subtracts the mean exactly (n * x - S, then
   over n) and adds up centred products as matrix products, a matrix for each task, added row by row of the matrix.
   What reaches the driver is one d x d matrix, whatever the number of vectors.
4. Components are unit eigenvectors by falling eigenvalue, their largest entry positive. Every distinct vector is
   projected once; its rows are joined back by x, a join that adaptive execution may split.
5. The whitened vectors' own covariance is measured in the same way and compared with the identity.

Vectors of different lengths are fitted apart (identity_error is the largest of all). Components without variance
(eigenvalue below d * 1e-13 of the largest) cannot be whitened and are left out, so a fit list of one vector gives no
rows. Null and repeated ids stay rows of their own. Empty tables, and vectors without entries, give no rows. STEP * c
beyond 2**62 counts as 2**62; a deviation of more than 38 digits is null. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: Fixed values of the whole-number form.
STEP, SHIFT = 64, 1_000_000
COMPONENTS = 16
FLAT = 1e-13
SAFE = 1 << 62
#: Vectors that are turned into a matrix at a time.
ROWS = 8192


class Fit(NamedTuple):
    """n (sum of weights), exact sums, axes (d x components, each over the root of its eigenvalue), shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float]


def whole_numbers(vector: Column) -> Column:
    """The vector as x, null where it is null or holds null or non-finite entries."""
    wide = vector.cast("array<double>")
    fine = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    edge = float(SAFE)
    return F.when(fine, F.transform(wide, lambda c: F.floor(F.greatest(F.least(c * STEP, F.lit(edge)), F.lit(-edge))) + SHIFT))


def matrices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(length, weights, matrix, its rows) of the vectors of one length in each piece of a batch."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            lists = b.column(b.schema.get_field_index(column))
            weight = b.column(b.schema.get_field_index("weight")).to_numpy()
            sizes = lists.value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                some = b.take(pa.array(rows))
                flat = some.column(some.schema.get_field_index(column)).flatten().to_numpy()
                yield d, weight[rows], flat.reshape(len(rows), d), some


def added(weight: np.ndarray, x: np.ndarray) -> list:
    """Weighted sums of the columns of x, exact for whole numbers."""
    if x.dtype == np.float64:
        return (weight @ x).tolist()
    fits = int(np.abs(x).max(initial=0)) * int(weight.sum()) < SAFE
    return (weight @ x).tolist() if fits else [int(v) for v in weight.astype(object) @ x.astype(object)]


def off_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact."""
    fits = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < SAFE
    kind = np.int64 if fits else object
    return x.astype(kind) * (n if fits else int(n)) - np.array(sums, kind)


def deviations(y: np.ndarray) -> list[int]:
    """Sums of squares of the rows of y, exact."""
    most = int(np.abs(y).max(initial=0))
    y = y if most * most * y.shape[1] < SAFE else y.astype(object)
    return [int(v) for v in (y * y).sum(axis=1)]


def sums_of(vectors: DataFrame, column: str) -> dict[int, tuple]:
    """By length: the sum of weights and the weighted sums of the entries. vectors: column, weight."""
    number = "double" if vectors.schema[column].dataType.elementType.simpleString() == "double" else "decimal(38,0)"
    kind = pa.float64() if number == "double" else pa.decimal128(38)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for d, weight, x, _ in matrices(batches, column):
            old = total.setdefault(d, [0, [0] * d])
            old[0] += int(weight.sum())
            old[1] = [a + b for a, b in zip(old[1], added(weight, x), strict=True)]
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([n]), pa.array([s], pa.list_(kind))], ["d", "n", "s"])

    parts = vectors.select(column, "weight").mapInArrow(run, f"d long, n long, s array<{number}>")
    entries = parts.select("d", "n", F.posexplode("s").alias("place", "s")).groupBy("d", "place").agg(F.sum("n").alias("n"), F.sum("s").cast(number).alias("s"))
    out: dict[int, tuple] = {}
    for r in entries.orderBy("d", "place").collect():  # a row for each entry of a vector
        out.setdefault(r["d"], (r["n"], []))[1].append(r["s"] if number == "double" else int(r["s"]))
    return out


def _row_sum(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"d": pdf["d"].iloc[:1], "place": pdf["place"].iloc[:1], "products": [np.sum(np.stack(pdf["products"].tolist()), axis=0)]})


def covariances(vectors: DataFrame, column: str, centred: Callable[[int, np.ndarray], np.ndarray], n: dict[int, int]) -> dict[int, np.ndarray]:
    """By length: the weighted covariance with divisor n of what `centred` makes of vectors of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for d, weight, x, _ in matrices(batches, column):
            z = centred(d, x)
            total[d] = total.get(d, 0) + (z * weight[:, None]).T @ z
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(m)), pa.array(range(len(m)), pa.int64()), pa.array(m.tolist(), pa.list_(pa.float64()))], ["d", "place", "products"])

    shape = "d long, place long, products array<double>"
    rows = vectors.select(column, "weight").mapInArrow(run, shape).groupBy("d", "place").applyInPandas(_row_sum, shape)
    out = {d: np.zeros((0, 0)) for d in n}
    found: dict[int, list] = {}
    for r in rows.orderBy("d", "place").collect():  # d rows of d numbers
        found.setdefault(r["d"], []).append(r["products"])
    return out | {d: np.array(m) / n[d] for d, m in found.items()}


def components(n: int, sums: list[int], covariance: np.ndarray, most: int) -> Fit:
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > max(values[:1].max(initial=0), 0) * len(values) * FLAT).sum()))
    axes = axes[:, :k] * np.sign(axes[np.abs(axes[:, :k]).argmax(axis=0), np.arange(k)])
    trace = float(np.trace(covariance))
    return Fit(n, sums, axes / np.sqrt(values[:k]), [float(v) / trace for v in values[:k]])


def fitted(vectors: DataFrame, most: int = COMPONENTS) -> dict[int, Fit]:
    """By length, the fit of distinct vectors (x, weight)."""
    totals = sums_of(vectors, "x")
    found = covariances(vectors, "x", lambda d, x: (off_mean(x, *totals[d]) / totals[d][0]).astype(float), {d: t[0] for d, t in totals.items()})
    return {d: components(*totals[d], found[d], most) for d in totals}


def _projected(fits: dict[int, Fit]):
    names = ["x", "weight", "n", "deviation", "scores"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, weight, x, rows in matrices(batches, "x"):
            if d not in fits:
                continue
            fit = fits[d]
            y = off_mean(x, fit.n, fit.sums)
            scores = (y / fit.n).astype(float) @ fit.axes
            square = [v if v < 10**38 else None for v in deviations(y)]
            made = [pa.array([fit.n] * len(x), pa.int64()), pa.array(square, pa.decimal128(38)), pa.array(scores.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("x")), pa.array(weight), *made], names)

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", weights: str = "one", most: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for each row with a usable vector and component.

    weights: "one" fits each distinct x vector once, "count" as often as rows have it.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights are one or count")
    usable = rows.select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col)).alias("x")).where("size(x) > 0")
    vectors = cut(usable.groupBy("x").agg((F.count("*") if weights == "count" else F.lit(1).cast("long")).alias("weight")), "whitening-vectors")
    fits = fitted(vectors, most)
    projected = cut(vectors.mapInArrow(_projected(fits), "x array<long>, weight long, n long, deviation decimal(38,0), scores array<double>"), "whitening-scores")
    error = identity_error(projected)
    shares = F.create_map(*(c for d, f in fits.items() for c in (F.lit(d), F.array(*map(F.lit, f.explained)).cast("array<double>")))) if fits else F.lit(None).cast("map<int,array<double>>")
    each = usable.join(projected, "x").select("id", F.element_at(shares, F.size("x")).alias("shares"), "n", "deviation", F.posexplode("scores").alias("place", "whitened"))
    return each.select(F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.get("shares", F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def identity_error(projected: DataFrame) -> float | None:
    """The largest absolute entry of the covariance of scores minus the identity, over all lengths of x; None without scores."""
    worst = None
    for d in [r[0] for r in projected.select(F.size("x")).distinct().collect()]:
        of = projected.where(F.size("x") == d).select("scores", "weight")
        for k, (n, s) in sums_of(of, "scores").items():
            mean = np.array(s) / n
            found = covariances(of, "scores", lambda _, z, mean=mean: z - mean, {k: n})[k]
            worst = max(worst or 0.0, float(np.abs(found - np.eye(k)).max(initial=0)))
    return worst


def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
