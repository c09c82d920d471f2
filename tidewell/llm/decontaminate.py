"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The automaton holds every substring (in words) of every item. Training texts stream through it word by word; the
state gives the longest item passage that ends at the word. A passage of `window` words or more means that an item
window ends there and its words are hit; an item shorter than the window is one window of its own length.

The reference side is cut by a hash into shards of about SHARD_CHARS characters of items. Each shard's automaton is
built by one task and written into the shared folder (which workers open by pyarrow: file, s3, gs, hdfs). A task
that reads documents takes GROUP_BYTES of them at a time and streams them through one automaton after the other,
loaded from there. So a worker holds one group and one automaton whatever the number of items, nothing passes through
the driver, and documents are read once, neither shuffled nor cut.

Normalisation: A-Z in lower case; words are runs of characters other than ASCII non-alphanumerics. Null text has no
words; null items and items without words match nothing; repeated items and rows are kept; a null item id counts
as the empty string; an item is never cut, so one that is longer than a shard is a shard of its size. Empty tables of
documents or items give no hits. Further columns of documents pass through; those with the names of new ones are
replaced.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.shared import shared_folder

from .common import packed, slices, table, unpacked

WINDOW = 13
#: One part in COVERAGE of the words hit makes a document contaminated.
COVERAGE = 20
#: Characters of items in one automaton (about 100 bytes of memory for each character).
SHARD_CHARS = 1_000_000
#: Bytes of documents that stream through one automaton before the next is loaded.
GROUP_BYTES = 32_000_000

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes((c | 0x20) if 0x41 <= c <= 0x5A else (0x20 if c in _SEPARATORS else c) for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class ItemAutomaton:
    """Generalised suffix automaton over the words of items, with the items of each window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(item, words_of(text)) for item, text in items]
        for _, words in texts:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.step)
        self.owners: list[set[str]] = [set() for _ in range(n)]
        short: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for item, words in texts:
            state, matched = 0, 0
            size = min(window, len(words))
            for w in words:
                state, matched = self.step[state][w], matched + 1
                if matched >= size > 0:
                    at = self._holder(state, size)
                    if size == window:
                        self.owners[at].add(item)
                    else:
                        short[at].append((size, item))
        #: For each state the state that holds its last `window` words (-1: it has no passage as long), and the
        #: short items that end in it or in any of its suffixes, longest first.
        self.full = [-1] * n
        self.short: list[tuple] = [()] * n
        for s in sorted(range(n), key=self.length.__getitem__):
            up = self.link[s]
            if s and self.length[s] >= window:
                self.full[s] = s if self.length[up] < window else self.full[up]
            own = tuple(sorted(set(short[s]), reverse=True))
            self.short[s] = own + (self.short[up] if s else ())
        self.marked = [self.full[s] >= 0 or bool(self.short[s]) for s in range(n)]

    def _new(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, parent: int, child: int, w: bytes) -> int:
        """The state for the passage that reaches child through parent alone; a copy of child where child is longer."""
        if self.length[child] == self.length[parent] + 1:
            return child
        twin = self._new(self.length[parent] + 1, dict(self.step[child]), self.link[child])
        self.link[child] = twin
        while parent >= 0 and self.step[parent].get(w) == child:
            self.step[parent][w] = twin
            parent = self.link[parent]
        return twin

    def _extend(self, last: int, w: bytes) -> int:
        known = self.step[last].get(w)
        if known is not None:
            return self._split(last, known, w)
        new = self._new(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and w not in self.step[at]:
            self.step[at][w] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, self.step[at][w], w)
        return new

    def _holder(self, state: int, size: int) -> int:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Maximal spans [start, end) of hit words, and the items with windows in them."""
        step, link, length, marked = self.step, self.link, self.length, self.marked
        spans: list[list[int]] = []
        found: set[str] = set()
        state = matched = 0
        for i, w in enumerate(words):
            to = step[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = step[state].get(w)
                if to is None:
                    matched = 0
                    continue
                matched = length[state] + 1
            else:
                matched += 1
            state = to
            if marked[state]:
                reach = 0
                if matched >= self.window:
                    reach = self.window
                    found |= self.owners[self.full[state]]
                for size, item in self.short[state]:
                    if size <= matched:
                        found.add(item)
                        reach = max(reach, size)
                if reach:
                    start = i + 1 - reach
                    if spans and start <= spans[-1][1]:
                        while len(spans) > 1 and start <= spans[-2][1]:
                            spans.pop()
                        spans[-1][0] = min(spans[-1][0], start)
                        spans[-1][1] = i + 1
                    else:
                        spans.append([start, i + 1])
        return spans, found


def merge(a: list, b: list) -> list:
    out: list[list[int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def strip_spans(text: str, spans: list) -> str:
    """text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)] if spans else []
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join(out) + text[at:]


def write_automata(items: DataFrame, window: int, item_id: str = "item_id", item_text: str = "text") -> tuple[str, int]:
    """Writes an automaton for each shard of items; returns the folder and the number of shards."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("text") + F.length("item")), F.lit(0))).first()[0]
    n = max(1, -(-total // SHARD_CHARS))
    folder = f"{shared_folder(items.sparkSession)}/tidewell-automata-{uuid.uuid4().hex}"

    def build(key: tuple, shard: pa.Table) -> pa.Table:
        auto = ItemAutomaton(list(zip(shard.column("item").to_pylist(), shard.column("text").to_pylist(), strict=True)), window)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "automaton": pa.array([pickle.dumps(auto)], pa.binary())})

    shards = rows.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(n))).groupBy("shard").applyInArrow(build, "shard long, automaton binary")
    shards.write.partitionBy("shard").parquet(folder)
    return folder, n


_LOADED: dict[tuple[str, int], ItemAutomaton | None] = {}


def load_automaton(folder: str, k: int) -> ItemAutomaton | None:
    """The automaton of a shard, None where it has no items; the one before is let go."""
    if (folder, k) not in _LOADED:
        _LOADED.clear()
        files, at = pa.fs.FileSystem.from_uri(folder)
        _LOADED[folder, k] = None
        part = f"{at}/shard={k}"
        if files.get_file_info(part).type != pa.fs.FileType.NotFound:
            blobs = pa.dataset.dataset(part, filesystem=files, format="parquet").to_table(columns=["automaton"]).column("automaton")
            _LOADED[folder, k] = pickle.loads(blobs[0].as_py()) if len(blobs) else None
    return _LOADED[folder, k]


FOUND = "n_words long, spans array<array<long>>, items array<string>, cleaned string"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches, in lists of GROUP_BYTES or somewhat more."""
    held, size = [], 0
    for b in slices(batches):
        held.append(b)
        size += b.nbytes
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def match_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds to docs, in place of its text: n_words, spans (array of [start, end) in words), items (array of ids) and
    cleaned (the text without the spans)."""
    folder, n = write_automata(items, window, item_id, item_text)
    kind = T.StructType.fromDDL(FOUND)
    arrow = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            texts = [t for b in group for t in b.column("text").to_pylist()]
            spans: list[list] = [[] for _ in texts]
            found: list[set] = [set() for _ in texts]
            n_words = [0] * len(texts)
            for k in range(n):
                auto = load_automaton(folder, k)
                for at, t in enumerate(texts):
                    words = words_of(t)
                    n_words[at] = len(words)
                    if auto:
                        new, seen = auto.scan(words)
                        spans[at] = merge(spans[at], new) if spans[at] else new
                        found[at] |= seen
            cleaned = [strip_spans(t, s) if t is not None else None for t, s in zip(texts, spans, strict=True)]
            at = 0
            for b in group:
                to = at + b.num_rows
                made = [n_words[at:to], spans[at:to], [sorted(f) for f in found[at:to]], cleaned[at:to]]
                yield pa.RecordBatch.from_arrays([b.column("doc"), *(pa.array(v, t) for v, t in zip(made, arrow, strict=True))], ["doc", *kind.names])
                at = to

    rows = packed(docs, text).select("doc", F.col(f"`{text}`").alias("text"))
    out = rows.mapInArrow(run, T.StructType([rows.schema["doc"], *kind.fields]))
    return unpacked(out, *kind.names)


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (n_hit * COVERAGE >= n_words)


def hits() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])


def op6_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match_items(docs, table(spark, sf_dir, "benchmark")).drop("cleaned").withColumn("n_hit", hits())
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


#: Windows as word strings, counted by joins; the same law without an automaton.
OP6_SQL = r"""
with dw as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
iw as (select cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, least(13, len(w)) k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') s from iw, lateral (select unnest(range(1, len(w) - least(13, len(w)) + 2)) i) where len(w) > 0),
ks as (select distinct k from win),
occ as (select r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') s from dw, ks, lateral (select unnest(range(1, len(w) - k + 2)) i)),
m as (select occ.r, occ.i, occ.k, win.item_id from occ join win on occ.s = win.s and occ.k = win.k),
hit as (select r, count(distinct j) n_hit from (select distinct r, unnest(range(i, i + k)) j from m) group by r),
its as (select r, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) ids from m group by r)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from dw left join hit using (r) left join its using (r)
"""
