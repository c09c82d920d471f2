"""Token counts by a lattice of pieces: the best path of each word through a vocabulary with scores.

A word is taken with a mark for the blank before it. Every piece that stands somewhere in it is an edge of a lattice,
and the path with the largest sum of scores gives its tokens (ties: the path whose last piece is longer). A character that no piece
covers is as many tokens as it has bytes. Words of a text are independent, so a text's count is a sum over words, and
what has been counted is remembered, up to KNOWN words in a task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
KNOWN = 300_000
#: The score of a byte, below that of any piece.
LOST = -1e6


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, float], int]:
    """Score of each piece of a model file, and the length of the longest; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda t: model.is_control(t) or model.is_unknown(t) or model.is_byte(t) or model.is_unused(t)
    scores = {model.id_to_piece(t): model.get_score(t) for t in range(model.get_piece_size()) if not special(t)}
    return scores, max(map(len, scores))


@functools.lru_cache(maxsize=2)
def counted(path: str) -> dict[str, int]:
    """Words that this process has counted by a model file, KNOWN at most."""
    return {}


@functools.lru_cache(maxsize=2)
def beginnings(path: str) -> frozenset[str]:
    """Everything that a piece of a model file begins with."""
    return frozenset(p[:k] for p in vocabulary(path)[0] for k in range(1, len(p) + 1))


def best_path(word: str, scores: dict[str, float], longest: int, begun: frozenset[str] | None = None) -> list[str]:
    """The pieces of the best path through a word, characters that no piece covers among them as they are.

    begun: what pieces begin with; from a place where no piece goes on, no longer one is looked for.
    """
    n = len(word)
    best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
    for start in range(n):
        here, lone = best[start], word[start]
        # a later start has a shorter last piece, so it must be better, not equal
        if (score := here + scores.get(lone, LOST * len(lone.encode("utf-8", "surrogatepass")))) > best[start + 1]:
            best[start + 1], back[start + 1] = score, start
        for end in range(start + 1, min(n, start + longest) + 1):
            piece = word[start:end]
            if begun is not None and piece not in begun:
                break
            if end > start + 1 and (score := scores.get(piece)) is not None and here + score > best[end]:
                best[end], back[end] = here + score, start
    out, end = [], n
    while end:
        out.append(word[back[end] : end])
        end = back[end]
    return out[::-1]


class TokenCount:
    """Tokens of a text, as a function that tasks can be sent: the vocabulary is read where it is used.

    What has been counted stays in the worker for its next tasks. Words are independent, so a blank line adds nothing.
    """

    blank_line = 0

    def __init__(self, path: str):
        self.path, self.known = path, counted(path)

    def __reduce__(self):
        return TokenCount, (self.path,)

    def word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            scores, longest = vocabulary(self.path)
            n = sum(1 if p in scores else len(p.encode("utf-8", "surrogatepass")) for p in best_path(MARK + word, scores, longest, beginnings(self.path)))
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[word] = n
        return n

    def __call__(self, text: str | None) -> int:
        return sum(map(self.word, (text or "").split()))


def with_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """docs with the token count of a text beside it; null and blank texts have none. One scan, no shuffle."""
    fields = [f for f in docs.schema.fields if f.name != out]
    count = TokenCount(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [count(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in fields), pa.array(made, pa.int64())], [*(f.name for f in fields), out])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.LongType())]))
