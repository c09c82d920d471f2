"""Periodic run detection by block convolution: every run of words with exponent EXPONENT or more, of any period.

A run is a stretch with smallest period q that no neighbour extends, at least max(SHORTEST, EXPONENT * q) words long.

Words become numbers (by text, from 1). For each dyadic scale L, texts are cut into blocks of L words. A run whose
period is in L..2L-1 is so long that one of its blocks stands in it with the copy q words on, so:

1. A block is compared with the window that follows it at the distances L..2L-1, all at once: the sum of squared
   differences at a distance is (block squared) + (window squared) - 2 (block x window), and the last term is a number
   theoretic transform. Primes are taken until their product exceeds every possible sum, so zero means no mismatch.
   Before that, a block is left out if one of its words does not come again within L..2L-1 words of itself, since it
   cannot have a zero then.
2. Each zero is a seed: block and distance. Three zeros or more of one block lie in one stretch of a smaller period;
   the only distance that can be a run's smallest period is the one between the ends of that stretch and of the
   block's own (any other would carry the small period over), so a block gives two seeds at most.
3. Adjacent seeds of a distance are one; each is extended to both sides while words at that distance are equal.
4. Of stretches with the same ends the smallest distance is the period.

Work is n log(n)^2 word operations for n words, repetitive or not. One scan, no shuffle; a task holds BATCH words of
several texts, or one text. Null and empty texts have no runs; ties are all reported, by start, then period; repeated
rows are searched each; an empty table gives an empty table; further columns pass through, those with the names of new
ones are replaced. Very long texts are one row each, of at most 2**26 words (the primes' transforms end there; more
raise an error).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table

SHORTEST = 6
EXPONENT = 4
#: Words that are searched together, and numbers of one transform's batch.
BATCH = 1 << 18
CELLS = 1 << 17
LONGEST = 1 << 26
#: Primes below 2**31 with roots of unity of order 2**25 or more, and a generator of each.
PRIMES = ((2013265921, 31), (1811939329, 13), (2113929217, 5))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


@functools.lru_cache(maxsize=64)
def _roots(p: int, g: int, half: int, inverse: bool) -> np.ndarray:
    """Powers 0..half-1 of a root of unity of order 2 * half (or of its inverse), as a column."""
    w = pow(g, (p - 1) // (2 * half), p)
    w = pow(w, p - 2, p) if inverse else w
    out, have, step = np.ones(half, np.uint64), 1, w
    while have < half:
        out[have : 2 * have] = out[:have] * np.uint64(step) % np.uint64(p)
        have, step = 2 * have, step * step % p
    return out[:, None]


def _forward(a: np.ndarray, p: int, g: int) -> np.ndarray:
    """Transform of each column of a, in place; frequencies come in bit-reversed order."""
    size, m = a.shape
    mod, half = np.uint64(p), size // 2
    while half:
        v = a.reshape(-1, 2, half, m)
        x, y = v[:, 0], v[:, 1]
        low = x + y
        v[:, 1] = (x + (mod - y)) * _roots(p, g, half, False) % mod
        v[:, 0] = np.minimum(low, low - mod)
        half //= 2
    return a


def _backward(a: np.ndarray, p: int, g: int) -> np.ndarray:
    """Inverse of _forward, times the size."""
    size, m = a.shape
    mod, half = np.uint64(p), 1
    while half < size:
        v = a.reshape(-1, 2, half, m)
        x, y = v[:, 0].copy(), v[:, 1] * _roots(p, g, half, True) % mod
        low, high = x + y, x + (mod - y)
        v[:, 0] = np.minimum(low, low - mod)
        v[:, 1] = np.minimum(high, high - mod)
        half *= 2
    return a


def zero_mismatches(x: np.ndarray, starts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) for blocks of `scale` numbers at `starts` and distances scale..2*scale-1 without a mismatch.

    x has at least 3 * scale numbers from each start. Pairs come by block, then by distance.
    """
    size, top = 2 * scale, int(x.max(initial=0))
    bound, primes, product = scale * top * top, [], 1
    for p in PRIMES:
        if product <= bound:
            primes.append(p)
            product *= p[0]
    if product <= bound or size > 1 << 25:
        raise ValueError(f"texts of more than {LONGEST} words are not searched")
    lanes, blocks, distances = max(1, CELLS // size), [], []
    for k in range(0, len(starts), lanes):
        at = starts[k : k + lanes]
        window = x[at + np.arange(scale, 3 * scale)[:, None]].astype(np.uint64)
        block = np.zeros_like(window)
        rows = -np.arange(scale) % size
        block[rows] = x[at + np.arange(scale)[:, None]]
        zero = np.ones((scale, len(at)), bool)
        for p, g in primes:
            mod, n = np.uint64(p), np.uint64(pow(size, p - 2, p))
            product_ = _backward(_forward(block % mod, p, g) * _forward(window % mod, p, g) % mod, p, g)[:scale] * n % mod
            own = (block * block % mod).sum(0) % mod
            squares = np.concatenate([np.zeros((1, len(at)), np.uint64), np.cumsum(window * window % mod, axis=0)])
            other = (squares[scale : 2 * scale] - squares[:scale]) % mod
            zero &= (own + other) % mod == product_ * np.uint64(2) % mod
        lane, t = np.nonzero(zero.T)
        blocks.append(at[lane])
        distances.append(t + scale)
    return np.concatenate(blocks), np.concatenate(distances)


def _extent(x: np.ndarray, at: np.ndarray, lag: np.ndarray, step: int, first: int, most: int | None = None) -> np.ndarray:
    """How many of the words at at, at + step, ... equal the word `lag` further on (0 is no word), most at the most.

    Chunks of `first` words, then twice as many, and so on, for those that have not ended.
    """
    out, live, width = np.zeros(len(at), np.int64), np.arange(len(at)), first
    while len(live):
        rows = max(1, (1 << 20) // width)
        going = []
        for k in range(0, len(live), rows):
            some = live[k : k + rows]
            places = at[some, None] + step * (out[some, None] + np.arange(width))
            inside = (places >= 0) & (places + lag[some, None] < len(x))
            a = np.where(inside, places, 0)
            same = inside & (x[a] != 0) & (x[a] == x[np.where(inside, places + lag[some, None], 0)])
            same = np.concatenate([same, np.zeros((len(some), 1), bool)], axis=1)
            n = same.argmin(axis=1)
            out[some] += n
            going.append(some[(n == width) & (True if most is None else out[some] < most)])
        live, width = np.concatenate(going), min(2 * width, 1 << 20)
    return out


def _seeds(x: np.ndarray, blocks: np.ndarray, distances: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The zeros that can be seeds: all of a block with one or two, and at most one of a block with more."""
    if not len(blocks):
        return blocks, distances
    first = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
    many = np.diff(np.append(first, len(blocks)))
    few = np.repeat(many <= 2, many)
    at = first[many > 2]
    small, b, d = distances[at + 1] - distances[at], blocks[at], distances[at]
    end = b + small + _extent(x, b, small, 1, scale, 3 * scale)
    other = b + d + small + _extent(x, b + d, small, 1, scale, 5 * scale)
    apart = other - end
    last = distances[at + many[many > 2] - 1]
    fits = (apart >= d) & (apart <= last) & ((apart - d) % small == 0)
    return np.concatenate([blocks[few], b[fits]]), np.concatenate([distances[few], apart[fits]])


def runs_among(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, as word numbers from 1, its runs (start, length, period) by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    place = np.cumsum(sizes + 1) - sizes  # a 0 stands before each text
    longest, total = int(sizes.max(initial=0)), int((sizes + 1).sum()) + 1
    room = 1 << max(3, longest.bit_length())
    x = np.zeros(total + room, np.int64)
    for at, t in zip(place, texts, strict=True):
        x[at : at + len(t)] = t
    owner = np.repeat(np.arange(len(texts)), sizes)
    where = np.flatnonzero(x)
    code = owner * (int(x.max(initial=0)) + 1) + x[where]
    order = np.argsort(code, kind="stable")
    code, where, owner = code[order], where[order], owner[order]
    rank = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])) if len(code) else code
    keys, length = rank * (4 * len(x)) + where, sizes[owner]
    found, scale = [], 1
    while EXPONENT * scale <= longest:
        long = length >= EXPONENT * scale
        keys, where, length = keys[long], where[long], length[long]
        again = np.searchsorted(keys, keys + scale)
        again = np.append(keys, np.iinfo(np.int64).max)[again] < keys + 2 * scale
        lone = np.ones(-(-total // scale) * scale, bool)
        lone[where[again]] = False
        starts = np.flatnonzero(~lone.reshape(-1, scale).any(axis=1)) * scale
        if len(starts):
            b, d = _seeds(x, *zero_mismatches(x, starts, scale), scale)
            by = np.lexsort((b, d))
            b, d = b[by], d[by]
            head = np.concatenate([[True], (d[1:] != d[:-1]) | (b[1:] != b[:-1] + scale)]) if len(b) else np.zeros(0, bool)
            tail = np.append(head[1:], True) if len(b) else head
            low, high, d = b[head], b[tail] + scale, d[head]
            low = low - _extent(x, low - 1, d, -1, scale)
            high = high + _extent(x, high, d, 1, scale) + d
            whole = high - low >= np.maximum(SHORTEST, EXPONENT * d)
            found.append(np.stack([low, high - low, d])[:, whole])
        scale *= 2
    every = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    every = every[:, np.lexsort((every[2], every[1], every[0]))]
    new = np.ones(every.shape[1], bool)
    new[1:] = (np.diff(every[:2], axis=1) != 0).any(axis=0)
    every = every[:, new]
    every = every[:, np.lexsort((every[2], every[0]))]
    ends = np.searchsorted(every[0], place + sizes)
    out, at = [], 0
    for start, end in zip(place, ends, strict=True):
        rows = every[:, at:end].T.copy()
        rows[:, 0] -= start
        out.append(rows)
        at = end
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """words without those that a run contains after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def word_batches(texts: list) -> Iterator[list[list[bytes]]]:
    """Words of some texts at a time, BATCH words or one text."""
    some, n = [], 0
    for t in texts:
        words = words_of(t)
        if some and n + len(words) > BATCH:
            yield some
            some, n = [], 0
        some.append(words)
        n += len(words)
    if some:
        yield some


def _numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known) + 1) for w in words], np.int64)


def _told(texts: list) -> list:
    n, runs, kept = [], [], []
    for some in word_batches(texts):
        for words, found in zip(some, runs_among([_numbers(w) for w in some]), strict=True):
            n.append(len(words))
            runs.append([{"start": s, "length": k, "period": q} for s, k, q in found.tolist()])
            kept.append(b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass"))
    return [n, runs, kept]


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with, in place of the text: n_words, runs (start, length, period, in words) and collapsed (each run cut to one period)."""
    return map_texts(docs, _told, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", text)


def repeated(doc_id: Column, text: Column) -> Column:
    """The text with a periodic end put in where crc32 of the id ends in 0, else as it is (also where the id is null)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def put(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # transform over one element names the words, so that they are split once
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, put(w)).otherwise("")), F.lit(0))
    return F.when(h % 10 == 0, made).otherwise(text)


def op11_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    milli = F.floor(1000 * length / period).cast("long")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
