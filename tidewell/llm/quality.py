"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates.

Features are unigrams and bigrams of words and of runs of marks, hashed to 2**BITS places; a feature's value is its
count over the number of tokens, times SCALE. Training reads labels of at most TRAIN_ROWS rows (the lowest by a hash
of their id, none of them held out): a fixed bound, so what reaches the driver is bounded too, and it streams there
row by row. The weights (2**BITS doubles) are sent to the executors, and every document is scored whole as one
sparse dot product in one scan.

Null text counts as empty and gets the score of the bias alone; rows without a label are scored like all others;
where an id has several labels, the largest counts; repeated documents are scored each. Without labels, scores are
0.5. Very long texts are features where they are read; an empty table gives an empty table; further columns pass
through, one named score is replaced.
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table

BITS = 18
SCALE = 20.0
#: The place of every bigram of a word with itself, whatever the word.
SAME = 1
#: Labelled rows that training reads at most.
TRAIN_ROWS = 3000
EPOCHS = 4
#: Fixed values of the update: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")
REMEMBERED = 400_000

_KNOWN: dict[str, int] = {}


def places(text: str | None) -> np.ndarray:
    """Places of all unigrams and bigrams, repeats included."""
    words = TOKEN.findall(text or "")
    if len(_KNOWN) > REMEMBERED:
        _KNOWN.clear()
    known, digest, h = _KNOWN, xxhash.xxh32_intdigest, []
    for w in words:
        x = known.get(w)
        if x is None:
            x = known[w] = digest(w.encode("utf-8", "surrogatepass"))
        h.append(x)
    one = np.array(h, np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)
    two[one[:-1] == one[1:]] = SAME
    return np.concatenate([one & np.uint64((1 << BITS) - 1), two]).astype(np.int64)


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    at = places(text)
    where, counts = np.unique(at, return_counts=True)
    return where, counts * (SCALE / max(1, len(at)))


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; place 2**BITS is the bias, which has no penalties."""

    def __init__(self):
        n = (1 << BITS) + 1
        self.z, self.n = np.zeros(n), np.zeros(n)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, where: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(where, 1 << BITS), np.append(x, 1.0)
        w = self.weights(at)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5 (a null id: as empty text)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from at most `rows` labelled rows that are not held out; the last is the bias."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")

    def run(batch: list) -> list:
        pairs = [sparse(t) for t in batch]
        return [[p[0].tolist() for p in pairs], [p[1].tolist() for p in pairs]]

    # texts become features where they are read; what is ordered and sent on are the features of `rows` texts
    features = map_texts(texts, run, "at array<int>, x array<float>").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "at", "x").limit(rows)
    model, samples = Ftrl(), []
    for r in features.toLocalIterator():
        samples.append((np.array(r["at"], np.int64), np.array(r["x"], float), int(r["quality"])))
    for _ in range(EPOCHS):
        for s in samples:
            model.learn(*s)
    return model.weights()


def score_texts(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs with, in place of the text, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(texts: list) -> list:
        w = shared.value
        out = []
        for t in texts:
            at = places(t)
            logit = float(w[at].sum()) * SCALE / max(1, len(at)) + float(w[-1])
            out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, logit)))))
        return [out]

    return map_texts(docs, run, "score double", text)


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, weights).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
