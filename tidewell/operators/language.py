"""Language detection by character n-gram profiles.

A profile holds the GRAMS commonest runs of GRAM characters of a language, counted over texts whose language is known.
A text's score for a language is the logarithm of the likelihood of its runs (runs that no profile has say nothing,
runs that only other profiles have count as seen once less than once: add-one smoothing). The language with the
highest score is told; of equal ones the first by name.

Texts under MIN_DETECT_CHARS characters, without a known run, and null texts get null; so does every text without
profiles. Repeated rows count in profiles as often as they occur. Counting combines before it shuffles; profiles are
languages x GRAMS rows, whatever the corpus, and texts are scored whole in one scan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import MIN_DETECT_CHARS
from tidewell.operators.lexical import top

GRAM, GRAMS = 3, 2000
BLANKS = " \t\n\r"
#: Runs that a task counts before it passes them on.
HELD = 500_000


def gram_counts(texts: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) of texts with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            rows = list(held.items())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["lang", "gram", "n"])

        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.update((name, t[i : i + GRAM]) for i in range(len(t) - GRAM + 1))
                if len(held) > HELD:
                    yield told()
        yield told()

    known = texts.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return known.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(counts: DataFrame, grams: int = GRAMS) -> DataFrame:
    """The `grams` commonest runs of each language, ties by the run."""
    return top(counts, "lang", [F.col("n").desc(), F.col("gram")], grams, "place").select("lang", "gram", "n")


class Profiles:
    """Profiles as arrays: sorted runs as numbers, and the logarithm of each for each language."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([coded(g)[0] for _, g, _ in rows], np.uint64))
        counts = np.zeros((len(self.langs), len(self.grams)))
        for lang, gram, n in rows:
            counts[self.langs.index(lang), np.searchsorted(self.grams, coded(gram)[0])] = n
        self.logs = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + len(self.grams))) if rows else counts

    def language(self, text: str | None) -> str | None:
        if text is None or not self.langs or len(text.strip(BLANKS)) < MIN_DETECT_CHARS:
            return None
        own = coded(text)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        counts = np.bincount(at[self.grams[at] == own], minlength=len(self.grams))
        return self.langs[int((self.logs @ counts).argmax())] if counts.any() else None


def coded(text: str) -> np.ndarray:
    """Each run of GRAM characters as a number (code points have 21 bits)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(points) - GRAM + 1)
    return points[:n] << np.uint64(42) | points[1 : n + 1] << np.uint64(21) | points[2 : n + 2]


def detect_languages(docs: DataFrame, fitted: DataFrame, text: str = "text", out: str = "detected") -> DataFrame:
    """docs with, in place of the text, its language by the profiles fitted(lang, gram, n): a bounded number of rows."""
    own = Profiles([tuple(r) for r in fitted.collect()])
    kept = [f for f in docs.schema.fields if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [own.language(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), pa.array(found, pa.string())], [*(f.name for f in kept), out])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))
