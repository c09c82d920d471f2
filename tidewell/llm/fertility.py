"""Quality rules with tokeniser fertility: how public vocabularies take a text to pieces, judged by bands.

Base rules come from words alone: too few of them, or too many in WINDOW-word windows that the text has twice.
The method's verdict comes from each vocabulary in turn. A text's words are taken to pieces one by one, each with a
blank before it, and three measures are made:

* letters: letters and digits for each token (marks are not counted, so words that carry marks have few),
* fallback: the share of tokens that are single bytes or parts of a character,
* entropy: of the tokens of each stretch of SPAN tokens (a last one of LEAST or more counts too), over the logarithm
  of its length; the mean of all stretches. Repetition and a small alphabet make it low.

Bands are by language where the table tells it and the vocabulary has a band for it, else by the script that most of
the text's letters belong to. Texts of fewer than LEAST tokens are not measured, and nothing is held against them.
Reasons are told by name.

Null and empty texts have no words and fail the base rules; repeated rows are judged each; ties of scripts go to the
first listed; an empty table gives an empty table; further columns pass through, those with the names of new ones are
replaced. One scan, no shuffle; a task holds the words of BATCH words of texts, or of one text, and what it remembers
of KNOWN words.
"""

from __future__ import annotations

import base64
import functools
import itertools
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, packed, table, unpacked
from .runs import word_batches

#: Fixed values of the base rules.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
#: Tokens of a stretch whose entropy is taken, and of the shortest one that counts.
SPAN, LEAST = 256, 64
KNOWN = 400_000

#: Scripts by ranges of code points, and what stands for the rest.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "kana": ((0x3040, 0x30FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF)),
}


class Band(NamedTuple):
    """What is let pass: letters for each token, most fallback, entropy."""

    letters: tuple[float, float]
    fallback: float
    entropy: tuple[float, float]


#: Entropy that prose keeps within, whatever the vocabulary.
PROSE = (0.70, 0.985)


def bands_for(languages: dict[str, float], latin: float, alphabets: float, dense: float) -> dict[str, Band]:
    """Bands of a vocabulary: least letters for each token by language, for Latin, for other alphabets and for scripts of syllables."""
    out = {name: Band((least, 12.0), 0.25, PROSE) for name, least in languages.items()}
    out |= {"latin": Band((latin, 12.0), 0.35, PROSE), "other": Band((0.1, 16.0), 1.0, (0.5, 1.0))}
    out |= {s: Band((alphabets, 12.0), 1.0, (0.5, 1.0)) for s in ("greek", "cyrillic", "hebrew", "arabic", "devanagari", "thai")}
    return out | {s: Band((dense, 12.0), 1.0, (0.5, 1.0)) for s in ("kana", "hangul", "han")}


#: By vocabulary file: its bands. The languages' least values are 0.85 of the least that labelled clean texts have.
BANDS = {
    "piece_bpe_32k.model": bands_for({"en": 1.36, "fr": 1.35, "de": 1.67, "es": 1.43}, 1.0, 0.2, 0.2),
    "byte_bpe_multi_50k.tiktoken": bands_for({"en": 1.54, "fr": 1.47, "de": 1.71, "es": 1.56}, 1.0, 0.2, 0.2),
}


class Pieces:
    """One public vocabulary: encode(words) gives the token numbers of each word, fallback[t] tells tokens without a whole character."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda words: model.encode(words, num_threads=1)
            self.fallback = np.array([model.is_byte(t) for t in range(model.get_piece_size())])
        else:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda words: [model.encode_ordinary(" " + w) for w in words]
            self.fallback = np.zeros(max(ranks.values()) + 1, bool)
            for raw, t in ranks.items():
                self.fallback[t] = not _whole(raw)


def _whole(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def default_paths() -> tuple[str, ...]:
    import public_tokenizers

    return tuple(str(public_tokenizers.path(f)) for f in BANDS)


@functools.lru_cache(maxsize=1)
def _ranges() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the ranges of all scripts in order, and the script of each."""
    every = sorted((a, b, k) for k, ranges in enumerate(SCRIPTS.values()) for a, b in ranges)
    return tuple(np.array(c) for c in zip(*every, strict=True))


def word_facts(words: list[str]) -> np.ndarray:
    """A row for each word: code points, letters and digits, letters of each of SCRIPTS, other letters."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points, back = np.unique(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    starts, ends, script = _ranges()
    at = np.maximum(np.searchsorted(starts, points, "right") - 1, 0)
    inside = (points >= starts[at]) & (points <= ends[at])
    kind = np.where(inside, script[at], [len(SCRIPTS) + (not chr(c).isalpha()) for c in points.tolist()])
    alnum = np.array([chr(c).isalnum() for c in points.tolist()], bool)
    of = np.repeat(np.arange(len(words)), sizes)
    counts = np.bincount(of * (len(SCRIPTS) + 2) + kind[back], minlength=len(words) * (len(SCRIPTS) + 2)).reshape(len(words), -1)
    return np.column_stack([sizes, np.bincount(of, alnum[back], len(words)).astype(np.int64), counts[:, :-1]]).astype(np.int32)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[k], ..., start[k] + size[k] - 1 for each k in turn."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)


class Words:
    """What is known of each different word: sizes, letters, scripts, and its tokens in each vocabulary (flat, by start and size)."""

    def __init__(self, paths: tuple[str, ...]):
        none = np.zeros(0, np.int64)
        self.paths, self.place, self.facts = paths, {}, np.zeros((0, 3 + len(SCRIPTS)), np.int32)
        self.tokens = [(none.astype(np.int32), none, none) for _ in paths]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word; new ones are looked at first."""
        if len(self.place) > KNOWN:
            self.__init__(self.paths)
        place = self.place
        new = [w for w in set(words) if w not in place]
        if new:
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            texts = [w.decode("utf-8", "replace") for w in new]
            self.facts = np.concatenate([self.facts, word_facts(texts)])
            for k, path in enumerate(self.paths):
                flat, start, size = self.tokens[k]
                made = pieces(path).encode(texts)
                sizes = np.fromiter(map(len, made), np.int64, len(made))
                more = np.fromiter(itertools.chain.from_iterable(made), np.int32, int(sizes.sum()))
                self.tokens[k] = (np.concatenate([flat, more]), np.concatenate([start, len(flat) + np.cumsum(sizes) - sizes]), np.concatenate([size, sizes]))
        return np.array([place[w] for w in words], np.int64)


def repeats(number: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which words stand in a WINDOW-word window that their text has twice or more; ranks of pairs, of pairs of pairs, and so on."""
    n = len(number) - WINDOW + 1
    gone = np.zeros(len(number), bool)
    if n < 1:
        return gone
    rank, width = np.unique(number, return_inverse=True)[1], 1
    while width < WINDOW:
        rank = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank, width = np.unique(rank, return_inverse=True)[1], 2 * width
    whole = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    _, which, count = np.unique(owner[whole] * (int(rank.max()) + 1) + rank[whole], return_inverse=True, return_counts=True)
    change = np.zeros(len(number) + 1, np.int64)
    again = whole[count[which] > 1]
    np.add.at(change, again, 1)
    np.add.at(change, again + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def measures(tokens: np.ndarray, owner: np.ndarray, letters: np.ndarray, fallback: np.ndarray) -> tuple[np.ndarray, ...]:
    """(letters for each token, share of fallback, entropy) of each text, nan where it has too few tokens. Tokens come text by text."""
    n = np.bincount(owner, minlength=len(letters))
    with np.errstate(divide="ignore", invalid="ignore"):
        n_long = np.where(n >= LEAST, n, 0)
        dense, share = np.where(n_long > 0, letters / n_long, np.nan), np.where(n_long > 0, np.bincount(owner, fallback[tokens], len(letters)) / n_long, np.nan)
        spans = -(-n // SPAN)
        first = np.cumsum(spans) - spans
        start = np.cumsum(n) - n
        span = first[owner] + (np.arange(len(tokens)) - start[owner]) // SPAN
        key, count = np.unique(span * len(fallback) + tokens, return_counts=True)
        of = key // len(fallback)
        size = np.bincount(span, minlength=int(spans.sum()))
        share_ = count / size[of]
        bits = np.bincount(of, -share_ * np.log2(share_), len(size)) / np.log2(size)
        counts = size >= LEAST
        text = np.repeat(np.arange(len(letters)), spans)
        entropy = np.bincount(text[counts], bits[counts], len(letters)) / np.bincount(text[counts], minlength=len(letters))
    return dense, share, entropy


def outside(name: str, band: Band, dense: float, share: float, entropy: float) -> list[str]:
    """Which measures are outside the band; nan is outside of nothing."""
    said = []
    if dense < band.letters[0] or dense > band.letters[1]:
        said.append(f"{name}:letters")
    if share > band.fallback:
        said.append(f"{name}:fallback")
    if entropy < band.entropy[0] or entropy > band.entropy[1]:
        said.append(f"{name}:entropy")
    return said


def _base_of(raw: bytes) -> tuple[int, int]:
    """(symbols, lines with a word that are equal to an earlier line)."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines))


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, reasons array<string>, letters array<double>, fallback array<double>, entropy array<double>"


def judge(paths: tuple[str, ...], bands: dict[str, dict[str, Band]]):
    names = [p.rpartition("/")[2] for p in paths]
    known: list[Words] = []

    def run(rows: list) -> list:
        if not known:
            known.append(Words(paths))
        store, out, at = known[0], [[] for _ in SCHEMA.split(",")], 0
        for some in word_batches([r["text"] for r in rows]):
            sizes = np.array([len(w) for w in some])
            owner = np.repeat(np.arange(len(some)), sizes)
            number = store.numbers([w for words in some for w in words])
            sums = [np.bincount(owner, column, len(some)).astype(np.int64) for column in store.facts[number].T]
            again = np.bincount(owner, repeats(number, owner), len(some)).astype(np.int64)
            told = []
            for path, (flat, start, size) in zip(paths, store.tokens, strict=True):
                stream = flat[ragged(start[number], size[number])].astype(np.int64)
                told.append(measures(stream, np.repeat(owner, size[number]), sums[1], pieces(path).fallback))
            script = np.array(sums[2:]).argmax(axis=0)
            scripts = [*SCRIPTS, "other"]
            for k in range(len(some)):
                row = rows[at + k]
                symbols, copies = _base_of((row["text"] or "").encode("utf-8", "surrogatepass"))
                n, twice = int(sizes[k]), int(again[k])
                failed = n < LEAST_WORDS or 100 * twice > MOST_REPEATED * n
                said = []
                for name, m in zip(names, told, strict=True):
                    by = bands[name]
                    said += outside(name, by.get(row["lang"]) or by[scripts[script[k]]], *(float(v[k]) for v in m))
                each = [[None if np.isnan(m[j][k]) else float(m[j][k]) for m in told] for j in range(3)]
                for column, v in zip(out, (n, int(sums[0][k]), symbols, copies, twice, failed, not failed and not said, said, *each), strict=True):
                    column.append(v)
            at += len(some)
        return out

    return run


def judge_quality(docs: DataFrame, text: str = "text", lang: str | None = None, paths: tuple[str, ...] | None = None, bands: dict | None = None) -> DataFrame:
    """docs with, in place of the text: the base counts, base_failed, kept, reasons, and the measures by vocabulary.

    lang names the column of language codes, if there is one. paths are vocabulary files, bands their bands by file name.
    """
    new = [c.split()[0] for c in SCHEMA.split(", ")]
    apart = packed(docs, text).select("doc", F.struct(F.col(f"`{text}`").alias("text"), (F.col(f"doc.`{lang}`") if lang else F.lit(None)).cast("string").alias("lang")).alias("row"))
    return unpacked(map_texts(apart, judge(paths or default_paths(), bands or BANDS), SCHEMA, "row"), *new)


def op12_fertility(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judge_quality(docs, lang="lang").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")
