"""Substring dedup: recurring passages of at least WINDOW words, located by sharded Aho-Corasick automata.

1. Anchors. Every window of WINDOW words has an anchor, the phrase of ANCHOR words in it whose hash is smallest
   (the leftmost of equal ones). Equal windows have equal anchors, so only windows whose anchor occurs at least
   twice can recur. Consecutive windows of equal anchors, STRETCH at most, are one row: about one row for 14 words,
   without text. Stretches overlap in words, not in windows, so repetitive text is cut into short contents, most equal.
2. Candidates. Counting anchors (combined before the shuffle; a text that several rows have counts for each of
   them) and joining the counts back leaves the stretches whose anchor recurs. Their words are cut out of the texts;
   a task keeps equal ones once, with a count, so what is shuffled by anchor is different contents.
3. Shards. An anchor's contents are one shard. A shard of more than FIT different contents is divided by further
   context, in rounds: its contents are taken apart into windows, and windows are dealt out by their first and last
   CONTEXT words. Equal windows have equal context, so they stay together; in the last round the context is the
   whole window, and a shard holds equal windows alone, which are one content. So every shard fits, without a cap.
4. Automata. A task goes through its shards in order, BATCH contents at a time: it confirms the passages of a content
   that an earlier one has too (words compared, not hashes; a content of several copies is one whole), compiles the
   different ones into an Aho-Corasick automaton over word numbers, and streams every content of these shards through
   it. Confirmation names a text, not its places: the first occurrence of a passage is found by the automaton alone.
   Each stretch is read by the one automaton that can match it: work grows with the text, not with text x automata.
5. Removal. What is located in a content is joined to its places, and the spans of a text to its rows by the text's
   digest. Equal texts are searched once and count as often as they occur; texts are shuffled compressed.

Words are runs of characters other than space and tab to carriage return, unchanged. Null texts have no words;
texts shorter than a window keep all words; repeated rows are copies of each other. Ids are never compared. Very
long texts are one row each (their stretches are short and dealt out, in repetitive texts too); an empty table gives an empty table; further columns
pass through, those with the names of new ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, packed, slices, table, unpacked

WINDOW = 35
ANCHOR = 8
#: Windows of a stretch at most; one occurrence of an anchor is in fewer, so only its repeats are parted.
STRETCH = 128
#: Different contents of a shard at most, and words at each end of a window that the rounds deal out by.
FIT = 2_000
CONTEXT = (4, 9, (WINDOW + 1) // 2)
#: Contents that a task takes at a time, and words of passages in one automaton (of either, one shard's more), and
#: contents that a task combines at a time.
BATCH = 20_000
COMPILED = 400_000
HELD = 20_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Nothing is remembered: workers live on through later stages, and a table of words would stay with them."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first window, whether it holds several occurrences) of each stretch of windows with equal anchors.

    Repetitive text makes long stretches; a stretch ends after STRETCH windows, and the next begins."""
    if len(words) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    h = word_hashes(words)
    n = len(h) - ANCHOR + 1
    phrase = np.zeros(n, np.uint64)
    for j in range(ANCHOR):
        phrase = phrase * _ODD + h[j : j + n]
    phrase ^= phrase >> np.uint64(29)
    phrase *= np.uint64(0xBF58476D1CE4E5B9)
    phrase ^= phrase >> np.uint64(32)
    # the leftmost smallest phrase of each window, by windows of 1, 2, 4, ... phrases
    width, at, span = WINDOW - ANCHOR + 1, np.arange(n), 1
    while span < width:
        shift = min(span, width - span)
        a, b = at[:-shift], at[shift:]
        at = np.where(phrase[b] < phrase[a], b, a)
        span += shift
    own, place = phrase[at], np.arange(len(at))
    begun = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), place, 0))
    first = np.flatnonzero((place - begun) % STRETCH == 0)
    last = np.append(first[1:], len(at)) - 1
    return own[first].view(np.int64), first, at[first] != at[last]


def key_of(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest()


def _zipped_rows(texts: list) -> list:
    """Digest and compressed bytes of each text: what is shuffled in its place."""
    zip_ = zstandard.ZstdCompressor(level=1).compress
    return [[key_of(t) for t in texts], [zip_((t or "").encode("utf-8", "surrogatepass")) for t in texts]]


def unzipped(raw: bytes) -> list[bytes]:
    """The words of a compressed text."""
    return zstandard.ZstdDecompressor().decompress(raw).split()


def _anchor_rows(texts: list) -> list:
    keys, n, vals, starts, several = [], [], [], [], []
    for t in texts:
        words = words_of(t)
        v, s, m = anchors(words)
        keys.append(key_of(t))
        n.append(len(words))
        vals.append(v)
        starts.append(s)
        several.append(m)
    return [keys, n, vals, starts, several]


#: A place: content `digest` stands in `of` (a text's key, or the digest of a larger content) from word `at`.
#: A content: of and at are null; it has its shard, its words, and how often it occurs.
PIECES = "of binary, at long, digest binary, shard long, words binary, n long"
_PLACES = pa.schema([("of", pa.binary()), ("at", pa.int64()), ("digest", pa.binary()), ("shard", pa.int64()), ("words", pa.binary()), ("n", pa.int64())])


class _Pieces:
    """Collects places and contents of a task; equal contents are one row with a count."""

    def __init__(self):
        self.places: tuple[list, list, list] = ([], [], [])
        self.contents: dict[bytes, list] = {}

    def add(self, of: bytes, at: int, shard: int, words: bytes, n: int) -> None:
        digest = hashlib.md5(words).digest()
        for column, x in zip(self.places, (of, at, digest), strict=True):
            column.append(x)
        known = self.contents.setdefault(digest, [shard, words, 0])
        known[2] += n

    def taken(self, last: bool) -> pa.RecordBatch:
        of, at, digest = self.places
        self.places = ([], [], [])
        shard, words, n = [None] * len(of), [None] * len(of), [None] * len(of)
        if last or len(self.contents) >= HELD:
            k = len(self.contents)
            of, at, digest = of + [None] * k, at + [None] * k, digest + list(self.contents)
            shard, words, n = (old + [c[j] for c in self.contents.values()] for j, old in enumerate((shard, words, n)))
            self.contents = {}
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((of, at, digest, shard, words, n), _PLACES, strict=True)], schema=_PLACES)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, copies, zipped, found: array of (start, end, val)) -> PIECES, stretches in their texts; an anchor is a shard."""
    pieces = _Pieces()
    for b in slices(batches):
        for key, copies, raw, found in zip(*(b.column(c).to_pylist() for c in ("key", "copies", "zipped", "found")), strict=True):
            words = unzipped(raw)
            for f in found:
                pieces.add(key, f["start"], f["val"], b" ".join(words[f["start"] : f["end"] + WINDOW]), copies)
        yield pieces.taken(False)
    yield pieces.taken(True)


def _windows(ends: int):
    """(digest, words, n) -> PIECES, windows in their contents; a shard is what has the same `ends` words at both ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces()
        for b in slices(batches):
            for digest, raw, n in zip(*(b.column(c).to_pylist() for c in ("digest", "words", "n")), strict=True):
                words = raw.split()
                for p in range(len(words) - WINDOW + 1):
                    w = words[p : p + WINDOW]
                    shard = xxhash.xxh64_intdigest(b" ".join(w[:ends] + w[-ends:]))
                    pieces.add(digest, p, shard - (1 << 64) if shard >> 63 else shard, b" ".join(w), n)
            yield pieces.taken(False)
        yield pieces.taken(True)

    return run


def locate(rows: list[list]) -> Iterator[tuple]:
    """rows [shard, digest, words, n] of whole shards -> (digest, start, end) of every recurring passage in them."""
    number: dict[bytes, int] = {}
    coded = [np.array([number.setdefault(w, len(number)) for w in words.split()], np.uint32).tobytes() for _, _, words, _ in rows]
    passages: set[bytes] = set()
    size = done = 0
    for i, j in _shards(rows):
        places: dict[bytes, int] = {}
        for k in range(i, j):
            for p in _confirmed(coded, k, rows[k][3], places):
                if p not in passages:
                    passages.add(p)
                    size += len(p) // 4
        if size >= COMPILED or j == len(rows):
            yield from _streamed(passages, coded[done:j], rows[done:j])
            passages, size, done = set(), 0, j


def _confirmed(coded: list[bytes], k: int, copies: int, places: dict[bytes, int]) -> Iterator[bytes]:
    """The passages of content k that stand at an earlier place too; places has the first place of each window so far.

    A passage starts with a window seen before and goes on as long as the text at that window's first place does, so
    all of it stands there. That place is not marked here: where passages stand is for the automaton to find. The
    second occurrence of any window can only be compared with the first, so each first one is in some passage."""
    raw, step, start = coded[k], 4 * WINDOW, None
    for p in range(0, len(raw) - step + 1, 4):
        here = k << 32 | p
        first = places.setdefault(raw[p : p + step], here)
        if start is not None:
            q += 4
            if other[q + step - 4 : q + step] == raw[p + step - 4 : p + step]:
                continue
            yield raw[start : p - 4 + step]
            start = None
        if first != here:
            start, other, q = p, coded[first >> 32], first & 0xFFFFFFFF
    if start is not None:
        yield raw[start:]
    if copies > 1 and len(raw) >= step:
        yield raw


def _streamed(passages: set[bytes], coded: list[bytes], rows: list[list]) -> Iterator[tuple]:
    """(digest, start, end) of what an automaton of the passages finds in contents, overlapping and touching spans joined."""
    if not passages:
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for p in passages:
        automaton.add_word(tuple(np.frombuffer(p, np.uint32).tolist()))
    automaton.make_automaton()
    for raw, (_, digest, _, _) in zip(coded, rows, strict=True):
        spans: list[list[int]] = []
        for end, size in automaton.iter(tuple(np.frombuffer(raw, np.uint32).tolist())):
            start = end + 1 - size
            while spans and start <= spans[-1][1]:
                start = min(start, spans.pop()[0])
            spans.append([start, end + 1])
        for start, end in spans:
            yield digest, start, end


def _shards(rows: list[list]) -> Iterator[tuple[int, int]]:
    i = 0
    for j in range(1, len(rows) + 1):
        if j == len(rows) or rows[j][0] != rows[i][0]:
            yield i, j
            i = j


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contents (shard, digest, words, n) sorted by (shard, digest) -> spans (digest, start, end), some whole shards at a time."""
    held: list[list] = []

    def told(rows):
        return pd.DataFrame(locate(rows), columns=["digest", "start", "end"])

    for pdf in batches:
        for row in zip(pdf["shard"], pdf["digest"], pdf["words"], pdf["n"], strict=True):
            if held and held[-1][0] == row[0] and held[-1][1] == row[1]:
                held[-1][3] += row[3]
                continue
            if len(held) >= BATCH and held[-1][0] != row[0]:
                yield told(held)
                held = []
            held.append(list(row))
    if held:
        yield told(held)


def located(pieces: DataFrame, level: int = 0) -> DataFrame:
    """(digest, start, end): the recurring passages in each content of pieces (PIECES, written)."""
    spark = pieces.sparkSession
    contents = pieces.where("of is null").select("shard", "digest", "words", "n")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def searched(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "shard").sortWithinPartitions("shard", "digest").mapInPandas(_search, "digest binary, start long, end long")

    if level == len(CONTEXT):
        return searched(contents)
    sizes = contents.select("shard", "digest").distinct().groupBy("shard").agg(F.count("*").alias("size"))
    large = cut(sizes.where(F.col("size") > FIT).select("shard"), "passages-large")
    if large.isEmpty():
        return searched(contents)
    whole = contents.join(large, "shard", "left_semi").groupBy("digest").agg(F.any_value("words").alias("words"), F.sum("n").alias("n"))
    deeper = cut(whole.mapInArrow(_windows(CONTEXT[level]), PIECES), "passages-windows")
    inside = deeper.where("of is not null").join(located(deeper, level + 1), "digest")
    inside = inside.select(F.col("of").alias("digest"), (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))
    return searched(contents.join(large, "shard", "left_anti")).unionByName(inside)


def recurring_spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(keyed docs, marks): docs with key and zipped in place of the text; marks(key, spans) for texts with recurring passages."""
    keyed = map_texts(docs, _zipped_rows, "key binary, zipped binary", text)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    found = cut(map_texts(rows, _anchor_rows, "key binary, n long, vals array<long>, starts array<int>, several array<boolean>").where("n >= " + str(WINDOW)), "passages-anchors")
    copies = found.groupBy("key").agg(F.count("*").alias("copies"), F.min("row").alias("row"))
    one = found.join(copies, ["key", "row"])
    ends = F.transform("starts", lambda s, i: F.struct(s.alias("start"), (F.coalesce(F.get("starts", i + 1), F.col("n") - WINDOW + 1) - 1).alias("end"), F.get("vals", i).alias("val"), F.get("several", i).alias("several")))
    stretches = one.select("key", "copies", F.explode(ends).alias("s")).select("key", "copies", "s.*")
    times = F.col("copies") * F.when(F.col("several"), 2).otherwise(1)
    often = cut(stretches.groupBy("val").agg(F.sum(times).alias("c")).where("c > 1").select("val"), "passages-often")
    candidates = stretches.join(often, "val").groupBy("key", "copies").agg(F.collect_list(F.struct("start", "end", "val")).alias("found"))
    texts = keyed.select("key", "zipped").dropDuplicates(["key"]).join(candidates, "key").select("key", "copies", "zipped", "found")
    pieces = cut(texts.mapInArrow(_stretches, PIECES), "passages-pieces")
    spans = pieces.where("of is not null").join(located(pieces), "digest").select(F.col("of").alias("key"), (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))
    marks = cut(spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "passages-marks")
    return keyed, marks


def mask(n: int, spans: list | None) -> np.ndarray:
    """Which of n words go."""
    gone = np.zeros(n, bool)
    for s in spans or ():
        gone[s["start"] : s["end"]] = True
    return gone


def dedup_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with, in place of the text: n_words, n_removed, kept (the words kept, joined by one space)."""
    keyed, marks = recurring_spans(packed(docs, text), text)
    joined = keyed.join(marks, "key", "left").select("doc", F.struct("zipped", "spans").alias("row"))
    return unpacked(map_texts(joined, _kept, "n_words long, n_removed long, kept string", "row"), "n_words", "n_removed", "kept")


def _kept(rows: list) -> list:
    n, removed, kept = [], [], []
    for r in rows:
        words = unzipped(r["zipped"])
        gone = mask(len(words), r["spans"])
        n.append(len(words))
        removed.append(int(gone.sum()))
        kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8", "surrogatepass") if removed[-1] else b" ".join(words).decode("utf-8", "surrogatepass"))
    return [n, removed, kept]


def op2_passages(spark, sf_dir):
    out = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    # digests are small beside the texts they were joined with: a few files, not one for each partition of texts
    return digests.hint("rebalance")


#: Windows as word lists, counted by grouping.
OP2_SQL = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, i, array_to_string(list_slice(w, i, i + 34), ' ') as s from d, lateral (select unnest(range(1, len(w) - 33)) as i)),
often as (select s from win group by s having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) as j from win where s in (select s from often)),
words as (select r, j, w[j] as word from d, lateral (select unnest(range(1, len(w) + 1)) as j)),
kept as (select r, string_agg(word, ' ' order by j) as k from words anti join gone using (r, j) group by r),
lost as (select r, count(*) as c from gone group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(c, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join kept using (r) left join lost using (r)
"""
