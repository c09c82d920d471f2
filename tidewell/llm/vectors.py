"""Embedding near-duplicates by PCA-ordered, tiled comparison.

Vectors are scaled to length one and turned into the basis of their principal axes, strongest first. Sorted along
the first axis they are cut at quantiles into tiles of at most TILE vectors. A task compares the tiles of two blocks of
neighbouring tiles, so a tile is shuffled once for each block rather than for each tile it meets; blocks and tiles
whose bounding boxes are further apart than the threshold allows are not compared. Within a pair of tiles, products of the leading coordinates are summed
first; what the remaining ones can add is at most the product of the suffix norms, and a pair of vectors is dropped
as soon as the threshold is out of reach. What is left is verified by its cosine in double precision from the
stored components, so the basis (fitted on SAMPLE vectors) only changes how fast a result is found, never the result.

Equal vectors are one entry with a count. A pair of tiles reports, for each vector, how many vectors it links to, and
links that span the same components as all of its links; pairs of vectors are never written.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
lengths do not link with each other. Rows with one vec_id and different vectors are one node, whose links are pooled.
Null ids link with nothing; an empty table gives an empty table; further columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, slices, table

THRESHOLD = 0.95
#: Vectors of a tile at most, and at least where there are enough for LEAST_TILES tiles.
TILE, SMALL_TILE, LEAST_TILES = 4096, 256, 8
#: Vectors that the basis is fitted on at most.
SAMPLE = 4096
#: Coordinates after which the bound is taken.
STEPS = (12, 20, 32)
#: Rows of a tile compared at a time, and pairs refined at a time.
ROWS, PAIRS = 256, 1 << 16
#: Coordinates that a tile's bounding box has.
BOX = 8
#: Parts whose tiles make a block at most (of a part with very many tiles, so many tiles), and blocks at least where
#: there are as many parts.
BLOCK, LEAST_BLOCKS = 8, 4


def usable(v):
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def fit_basis(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (columns, strongest first) for each vector length found in a sample of SAMPLE vectors."""
    rows = vectors.select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE).toLocalIterator()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.embedding), []).append(r.embedding)
    out = {}
    for d, vs in by.items():
        x = unit(np.array(vs, float))
        out[d] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def turned(x: np.ndarray, bases: dict[int, np.ndarray]) -> np.ndarray:
    x = unit(x)
    return x @ bases[x.shape[1]] if x.shape[1] in bases else x


def _lead(bases, bounds=()):
    """Adds d (length), c (first coordinate) and part (its place among the bounds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = b.column("embedding").to_pylist()
            d = np.array([len(v) for v in vs], np.int64)
            c = np.zeros(len(vs))
            for k in np.unique(d):
                at = np.flatnonzero(d == k)
                c[at] = turned(np.array([vs[i] for i in at], float), bases)[:, 0]
            part = np.searchsorted(np.array(bounds, float), c).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), b.column("embedding"), pa.array(d), pa.array(c), pa.array(part)], ["node", "copies", "embedding", "d", "c", "part"])

    return run


TILES = "tile long, d long, block long, low array<double>, high array<double>, nodes binary, copies binary, vectors binary"


def _tiles(bases, size: int):
    """Rows sorted by (d, part, c) -> TILES; boxes have BOX coordinates (0 beyond the vectors' length), lists are bytes."""

    def tile(k: int, block: int, rows: list) -> pa.RecordBatch:
        nodes, copies, vs = zip(*rows, strict=True)
        raw = np.array(vs, np.float64)
        head = turned(raw, bases)[:, :BOX]
        low, high = (np.zeros(BOX) for _ in range(2))
        low[: head.shape[1]], high[: head.shape[1]] = head.min(axis=0), head.max(axis=0)
        name = (TaskContext.get().partitionId() << 32) + k
        small = raw.astype(np.float32)
        values = [[name], [raw.shape[1]], [block], [low.tolist()], [high.tolist()], [np.array(nodes, np.int64).tobytes()], [np.array(copies, np.int64).tobytes()], [small.tobytes() if (small == raw).all() else raw.tobytes()]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["tile", "d", "block", "low", "high", "nodes", "copies", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, k, inside = [], None, 0, 0
        # `size` parts in their order, and as many tiles of one part
        block = lambda: of[1] // size + (inside // size << 32)
        for b in slices(batches):
            for node, copies, v, *now in zip(*(b.column(c).to_pylist() for c in ("node", "copies", "embedding", "d", "part")), strict=True):
                if held and (len(held) >= TILE or now != of):
                    yield tile(k, block(), held)
                    held, k, inside = [], k + 1, inside + 1
                if now != of:
                    of, inside = now, 0
                held.append((node, copies, v))
        if held:
            yield tile(k, block(), held)

    return run


def near_pairs(a: np.ndarray, b: np.ndarray, turn_a: np.ndarray, turn_b: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b with cosine >= threshold, a block of rows at a time (same: only i < j)."""
    d = a.shape[1]
    steps = sorted({min(s, d) for s in STEPS})
    left = lambda x: [np.sqrt(np.maximum(0, np.einsum("ij,ij->i", x[:, s:], x[:, s:]))) for s in steps]
    rest_a, rest_b = left(turn_a), left(turn_b)
    slack = threshold - 1e-9
    head, head_b = steps[0], np.ascontiguousarray(turn_b[:, : steps[0]].T)
    norm = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x))
    norm_a, norm_b = norm(a), norm(b)
    for at in range(0, len(a), ROWS):
        first = at + 1 if same else 0
        dots = turn_a[at : at + ROWS, :head] @ head_b[:, first:]
        i, j = np.nonzero(dots + rest_a[0][at : at + ROWS, None] * rest_b[0][None, first:] >= slack)
        found = []
        for cut_at in range(0, len(i), PAIRS):
            x, y = i[cut_at : cut_at + PAIRS], j[cut_at : cut_at + PAIRS]
            part = dots[x, y]
            x, y = x + at, y + first
            if same:
                keep = x < y
                x, y, part = x[keep], y[keep], part[keep]
            for k, (s, e) in enumerate(zip(steps, steps[1:], strict=False), 1):
                part = part + np.einsum("ij,ij->i", turn_a[x, s:e], turn_b[y, s:e])
                keep = part + rest_a[k][x] * rest_b[k][y] >= slack
                x, y, part = x[keep], y[keep], part[keep]
            cosine = np.einsum("ij,ij->i", a[x], b[y]) / (norm_a[x] * norm_b[y])
            keep = cosine >= threshold
            found.append((x[keep], y[keep]))
        if found:
            yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def spanning(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) for the graph with links x-y."""
    nodes, flat = np.unique(np.concatenate([x, y]), return_inverse=True)
    u, v = flat[: len(x)], flat[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


class _Tile:
    def __init__(self, row: dict, bases):
        self.low, self.high = np.array(row["low"]), np.array(row["high"])
        self.nodes, self.copies = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["copies"], np.int64)
        n, d, raw = len(self.nodes), row["d"], row["vectors"]
        self.x = np.frombuffer(raw, np.float32 if len(raw) == 4 * n * d else np.float64).reshape(n, d).astype(float)
        self.turned = turned(self.x, bases)


def compare_tiles(a: _Tile, b: _Tile, threshold: float) -> pa.RecordBatch | None:
    """(node, links, other): for each node its links to the other tile, and links that span the same components; None without any."""
    gap = np.maximum(0, np.maximum(b.low - a.high, a.low - b.high))
    if gap @ gap > reach(threshold) ** 2:
        return None
    nodes, counts, link_a, link_b = [], [], [], []
    for i, j in near_pairs(a.x, b.x, a.turned, b.turned, a is b, threshold):
        if len(i):
            for own, w, at, other in ((a.nodes, b.copies, i, j), (b.nodes, a.copies, j, i)):
                sums = np.bincount(at, weights=w[other], minlength=len(own))
                nodes.append(own[sums > 0])
                counts.append(sums[sums > 0].astype(np.int64))
            p, q = spanning(a.nodes[i], b.nodes[j])
            link_a.append(p)
            link_b.append(q)
    if not nodes:
        return None
    n, c, p, q = (np.concatenate(v) for v in (nodes, counts, link_a, link_b))
    none = np.zeros(len(p), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([n, p])), pa.array(np.concatenate([c, none])), pa.array([None] * len(n) + q.tolist(), pa.int64())], ["node", "links", "other"])


def reach(threshold: float) -> float:
    """The largest distance of two vectors of length one whose cosine reaches the threshold."""
    return (2 - 2 * threshold) ** 0.5 + 1e-6


def _compare(bases, threshold):
    """Tiles sorted by pair of blocks, side and tile -> their links. The first block of a pair is held; of a block with itself, what came before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1).to_pylist()[0]
                if (row["d"], row["a"], row["b"]) != pair:
                    pair, held = (row["d"], row["a"], row["b"]), []
                new = _Tile(row, bases)
                if row["side"] == 0:
                    held.append(new)
                for old in held if row["side"] or row["a"] == row["b"] else ():
                    if (links := compare_tiles(old, new, threshold)) is not None:
                        yield links

    return run


def block_pairs(tiles: DataFrame, width: float) -> DataFrame:
    """(d, a, b), a <= b: the pairs of blocks whose boxes are within `width`, met by cells of the first coordinate."""
    ends = [F.array(*(f(F.get(c, F.lit(k))) for k in range(BOX))).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
    boxes = tiles.groupBy("d", "block").agg(*ends)
    cell = lambda c: F.floor(F.get(c, F.lit(0)) / width).cast("int")
    a = boxes.select("d", F.col("block").alias("a"), "low", "high", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    b = boxes.select("d", F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(cell("low") - 1, cell("high") + 1)).alias("cell"))
    gap = F.expr("aggregate(sequence(0, size(low) - 1), 0D, (s, k) -> s + power(greatest(0D, low_b[k] - high[k], low[k] - high_b[k]), 2))")
    return a.join(b, ["d", "cell"]).where("a <= b").where(gap <= width * width).select("d", "a", "b").distinct()


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component) for every row."""
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    good = base.where(usable(F.col("embedding")) & F.col("id").isNotNull())
    vectors = cut(good.groupBy("embedding").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "vectors")
    bases = fit_basis(vectors)
    plain = vectors.select("node", "copies", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "node long, copies long, embedding array<double>, d long, c double, part long"
    n = vectors.count()
    parts = max(1, -(-n // TILE), min(LEAST_TILES, n // SMALL_TILE))
    lead = plain.mapInArrow(_lead(bases), schema)
    bounds = lead.approxQuantile("c", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    ordered = plain.mapInArrow(_lead(bases, bounds), schema).repartition(parts, "d", "part").sortWithinPartitions("d", "part", "c")
    tiles = cut(ordered.mapInArrow(_tiles(bases, max(1, min(BLOCK, parts // LEAST_BLOCKS))), TILES), "vectors-tiles")
    pairs = cut(block_pairs(tiles, reach(threshold)), "vectors-pairs")
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")), F.struct(F.lit(1).alias("side"), F.col("b").alias("block"))))
    met = pairs.select("d", "a", "b", F.explode(sides).alias("s")).select("d", "a", "b", "s.*").join(tiles, ["d", "block"])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(tasks, "d", "a", "b").sortWithinPartitions("d", "a", "b", "side", "tile")
    found = cut(met.mapInArrow(_compare(bases, threshold), "node long, links long, other long"), "vectors-links")
    roots = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "vectors-roots")
    linked = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    named = vectors.join(linked, "node", "left").join(roots, "node", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "node").alias("root"))
    out = base.withColumn("key", F.when(usable(F.col("embedding")) & F.col("id").isNotNull(), F.col("embedding"))).join(named.withColumnRenamed("embedding", "key"), "key", "left")
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component"))


def op8_vectors(spark, sf_dir):
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


#: All pairs, and reachability by recursion.
OP8_SQL = """
with recursive e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings),
ok as (select * from e where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from ok a join ok b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
      where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95),
reach(id, other) as (select vec_id, vec_id from e union select reach.id, l.b from reach join l on l.a = reach.other)
select vec_id, (select count(*) from l where a = vec_id) n_links, c.component_id, vec_id = c.component_id kept
from e join (select id, min(other) component_id from reach group by id) c on c.id = e.vec_id
"""
