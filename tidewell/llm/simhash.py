"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through multi-index hashing.

Two fingerprints within 4 bits have, in one of their two 32-bit halves, at most 2 differing bits. Each
fingerprint therefore enumerates the Hamming ball of radius 1 around each half (33 keys); halves within 2 bits
share a key of their balls, so equal keys fetch every candidate, and complete distances are verified. Equal
fingerprints are one table entry, so groups of copies cost one row.

Within a key, links are found by a search that only compares with what has not been reached yet, and only a
spanning set of links leaves the task: components are the same as with all pairs, without emitting them. A key of
more than FIT fingerprints is cut into parts of that size, and each two parts meet in a task of their own, so no task
gets a whole hot key and no link is lost.

Components are those of a graph of fingerprints, each named by (its smallest id, itself), so that the smallest name
of a component holds its smallest id and no component is ever gathered.

Null text counts as empty; texts without words have fingerprint zero and link like any other; repeated rows stay;
very long texts are hashed in blocks; null ids are the smallest id only of components without another. An empty table
gives an empty table; further columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.joins import small_side

from .common import connected_components, cut, map_texts, table

SEED = 42
SHINGLE = 4
MAX_BITS = 4
HALF_BITS = 32
#: Fingerprints of a key that one task compares, from each of two parts.
FIT = 2_000
#: Shingle hashes that are spread into bits at a time.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text: a bit is 1 if it is set in over half of its shingle hashes, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        spans = [(0, len(joined))]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
        spans = zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        bits = np.unpackbits(h[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.sum(np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))[counts * 2 > len(h)], dtype=np.uint64))


def fingerprints(texts: list) -> list:
    return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]


def spanning_links(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that span the components of distinct fingerprints; each step compares one fingerprint with those not yet reached."""
    out, rest = [], fp
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                reached, rest = rest[near], rest[~near]
                out += [(int(x), int(y)) for y in reached]
                front += list(reached)
    return out


def link_balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (k, fp) sorted by k, any number of rows a batch -> links within each key. Only the fingerprints of one key are held."""
    key, held = None, []

    def links(parts):
        fp = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        return spanning_links(fp.view(np.uint64), MAX_BITS) if len(fp) > 1 else []

    for pdf in batches:
        k, fp, out = pdf["k"].to_numpy(), pdf["fp"].to_numpy(), []
        edge = np.flatnonzero(np.diff(k)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(k)]])
        if not len(k):
            continue
        if key is not None and k[0] != key:
            out += links(held)
            held = []
        for i in np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == 0) | (ends == len(k))):
            part = fp[starts[i] : ends[i]]
            if i == 0 and held:
                part_list = [*held, part]
            else:
                part_list = [part]
            if ends[i] == len(k):
                key, held = k[starts[i]], part_list
            else:
                out += links(part_list)
                held = [] if i == 0 else held
        if out:
            a = np.array(out, np.uint64).view(np.int64)
            yield pd.DataFrame({"a": a[:, 0], "b": a[:, 1]})
    if held and (out := links(held)):
        a = np.array(out, np.uint64).view(np.int64)
        yield pd.DataFrame({"a": a[:, 0], "b": a[:, 1]})


def _balls(fp: Column, tag: int) -> Column:
    """The keys of the ball of radius 1 around a half (0: low, 1: high) of fp."""
    half = F.shiftrightunsigned(fp, HALF_BITS) if tag else fp.bitwiseAND(F.lit(0xFFFFFFFF))
    masks = [0, *(1 << i for i in range(HALF_BITS))]
    return F.array(*(half.bitwiseXOR(F.lit(m)).bitwiseOR(F.lit(tag << HALF_BITS)) for m in masks))


def hot_keys(fps: DataFrame) -> DataFrame:
    """(k, parts) of the keys that more than FIT fingerprints have.

    A ball so large holds a half that more than FIT / 33 fingerprints share, so only keys around such halves are counted.
    """
    both = [fps.select("fp", F.get(_balls(F.col("fp"), tag), F.lit(0)).alias("half"), F.lit(tag).alias("tag")) for tag in (0, 1)]
    halves = both[0].unionByName(both[1]).groupBy("half", "tag").agg(F.count("*").alias("n"))
    dense = halves.where(F.col("n") * (HALF_BITS + 1) > FIT)
    suspects = dense.select(F.explode(F.when(F.col("tag") == 0, _balls(F.col("half"), 0)).otherwise(_balls(F.shiftleft("half", HALF_BITS), 1))).alias("k")).distinct()
    around = halves.select("n", F.explode(F.when(F.col("tag") == 0, _balls(F.col("half"), 0)).otherwise(_balls(F.shiftleft("half", HALF_BITS), 1))).alias("k"))
    sizes = around.join(small_side(cut(suspects, "simhash-suspects")), "k", "left_semi").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > FIT)
    return sizes.select("k", F.ceil(F.col("n") / FIT).cast("int").alias("parts"))


def near_links(fps: DataFrame) -> DataFrame:
    """fps(fp), distinct -> links (a, b) that span every component of the relation 'at most MAX_BITS differing bits'."""
    balls = fps.select("fp", F.explode(F.concat(_balls(F.col("fp"), 0), _balls(F.col("fp"), 1))).alias("k"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = cut(hot_keys(fps), "simhash-hot")
    found = lambda rows: rows.repartition(n, "k").sortWithinPartitions("k").mapInPandas(link_balls, "a long, b long")
    if hot.isEmpty():
        return found(balls).distinct()
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = balls.join(hot, "k").select("fp", "k", own.alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    met = met.select("fp", F.xxhash64("k", F.least("p", "q"), F.greatest("p", "q")).alias("k"))
    return found(balls.join(hot, "k", "left_anti").select("fp", "k")).unionByName(found(met)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component): component is the smallest id that links reach, the row's own included."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = cut(map_texts(rows, fingerprints, "fp long"), "simhash")
    least = prints.groupBy("fp").agg(F.min("id").alias("id"))
    named = cut(least.select("fp", F.struct(F.col("id").isNull().alias("none"), "id", "fp").alias("name")), "simhash-distinct")
    links = near_links(named.select("fp")).join(named.select(F.col("fp").alias("a"), F.col("name").alias("name_a")), "a").join(named.select(F.col("fp").alias("b"), F.col("name").alias("name_b")), "b")
    roots = connected_components(links.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")), "simhash-links")
    known = named.join(roots.withColumnRenamed("node", "name"), "name", "left").select("fp", F.coalesce("root", "name")["id"].alias("component"))
    return prints.join(known, "fp").select("id", "fp", "component")


def op9_simhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
