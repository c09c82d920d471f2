"""BPE encoding as a bounded-lookahead transducer, and decoding as a byte-to-text state machine.

A merge (x, y) can only be taken away by an earlier merge of a symbol that ends y with something that follows. How
far such chains of earlier merges reach is computed from the merge list once (`lookahead`): within that many
characters of the right end of what has been read a token boundary may still move, further left it is final. The
transducer therefore holds one window of a word, emits the tokens whose boundaries are final and goes on from the
last of them, so memory is constant however long a word is. Tokens do not cross a final boundary, so the tokens on
its two sides are those of the whole word. Every token comes from this one transducer; a bounded memo in front of it
keeps what it emitted for short words. Ids go into the digests and through the decoder as they come.

Vocabulary files are read by each worker from a path that is a parameter. Null and empty texts have no tokens (the
digests are those of the empty string); very long texts and words stream; repeated rows are kept; an empty table
gives an empty table; further columns pass through, those with the names of new ones are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame

from .common import map_texts, table

#: Words whose ids a worker remembers at a time, and their longest.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64
#: Characters normalised at a time (more where a longer stretch has no white space).
BLOCK = 1 << 16
#: Ids that go into the digests and through the decoder at a time.
FEED = 4096
BLANK = regex.compile(r"[ \t-\r]")
#: Fixed values of this vocabulary's pre-tokenizer.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable in Latin-1, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encoder of a vocabulary file with ranked merges, word-end suffix and byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.letters = byte_letters()
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        self.told = {i: str(i) for i in self.names}
        self.longest = max(map(len, self.ids))
        self.lookahead = self._lookahead(merges) + self.longest
        self.known: dict[str, list[int]] = {}

    @staticmethod
    def _lookahead(merges: list[tuple[str, str]]) -> int:
        """Characters to the right of a merge that can decide whether it takes place.

        reach[s]: over the merges so far whose left side is s, the characters of their right side and what those
        need in turn. A merge (x, y) is decided by the symbols that end y while y is built (the right spine).
        """
        spine: dict[str, tuple[str, ...]] = {}
        reach: dict[str, int] = {}
        most = 0
        for x, y in merges:
            ends = (y, *spine.get(y, ()))
            need = max(reach.get(s, 0) for s in ends)
            reach[x] = max(reach.get(x, 0), len(y) + need)
            spine[x + y] = ends
            most = max(most, need + len(y))
        return most

    def merged(self, symbols: list[str]) -> list[str]:
        """The tokens of a list of symbols: the lowest-ranked pair first, the leftmost among equals."""
        n = len(symbols)
        rank = self.rank
        if n < 48:
            out, none = list(symbols), len(rank)
            get = rank.get
            ranks = [get(pair, none) for pair in zip(out, out[1:], strict=False)]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                out[i : i + 2] = [out[i] + out[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((out[i - 1], out[i]), none)
                if i < len(ranks):
                    ranks[i] = get((out[i], out[i + 1]), none)
            return out
        part: list[str | None] = list(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if part[i] == a else n
            if j >= n or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get((part[i], part[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[after[i]]))
            if before[i] >= 0 and (r := rank.get((part[before[i]], part[i]))) is not None:
                heapq.heappush(heap, (r, before[i], part[before[i]], part[i]))
        return [p for p in part if p is not None]

    def transduce(self, word: str) -> Iterator[list[int]]:
        """The ids of one word, as soon as they are stable; holds one window and what is not stable yet of the one before.

        With `lookahead` characters still to the right of it a boundary is stable; at the word's end all are, so a
        word within one window is stable there.
        """
        raw = word.encode("utf-8", "surrogatepass")
        letters, ids, window = self.letters, self.ids, 2 * self.lookahead
        held: list[str] = []
        for at in range(0, len(raw), window):
            held += [letters[b] for b in raw[at : at + window]]
            if at + window >= len(raw):
                held[-1] += self.suffix
                yield [ids[t] for t in self.merged(held)]
                return
            stable, done, out = len(held) - self.lookahead, 0, []
            for token in self.merged(held):
                if done + len(token) > stable:
                    break
                out.append(ids[token])
                done += len(token)
            held = held[done:]
            yield out

    def emitted(self, word: str) -> list[int]:
        """What the transducer emits for a short word; remembered."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = ids = [i for part in self.transduce(word) for i in part]
        return ids

    def plain(self, text: str) -> Iterator[list[int]]:
        """The ids of text without special tokens, some FEED at a time.

        Texts are normalised in blocks that end before white space, where neither composition nor words reach across.
        """
        at, out, known = 0, [], self.known
        while at < len(text):
            gap = BLANK.search(text, at + BLOCK)
            block = text[at : gap.start()] if gap else text[at:]
            at += len(block)
            if not block.isascii():
                block = unicodedata.normalize("NFC", block).replace("Σ", "σ")
            for w in WORDS.findall(block.lower()):
                ids = known.get(w)
                if ids is not None:
                    out += ids
                elif len(w) <= REMEMBERED_CHARS:
                    out += self.emitted(w)
                else:
                    for ids in self.transduce(w):
                        out += ids
                        if len(out) >= FEED:
                            yield out
                            out = []
                if len(out) >= FEED:
                    yield out
                    out = []
        if out:
            yield out

    def stream(self, text: str | None) -> Iterator[list[int]]:
        """The ids of text in pieces; the vocabulary's special strings in it are their own tokens."""
        text, at = text or "", 0
        if self.at_special and "<|" in text:
            for m in self.at_special.finditer(text):
                yield from self.plain(text[at : m.start()])
                yield [self.special[m[0]]]
                at = m.end()
        yield from self.plain(text[at:] if at else text)

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.stream(text) for i in ids]


class Decoder:
    """Incremental decoder: feed ids, get text as soon as it is certain.

    The machine's state is (bytes of a code point that is not complete yet, whether a gap is due before the next
    token). It reads a token's bytes one by one; a byte that cannot continue the code point gives U+FFFD. A step for
    a whole token from a state is made once and kept, so that feeding ids looks steps up.

    With surface=True a token's bytes are those of its name and a gap follows each token, which is what a vocabulary
    file without a decoder asks for; else they are the bytes it stands for and gaps follow word ends.
    """

    START, GAP = (b"", False), (b"", True)

    def __init__(self, bpe: Bpe, surface: bool = False):
        self.bpe, self.surface = bpe, surface
        self.byte = {c: b for b, c in enumerate(bpe.letters)}
        self.steps: dict[tuple[bytes, bool], dict[int, tuple[str, tuple[bytes, bool]]]] = {}
        #: Of the steps, the texts of those that lead back to their state.
        self.loops: dict[tuple[bytes, bool], dict[int, str]] = {}
        self.state = self.START

    def _bytes(self, i: int) -> tuple[bytes, bool]:
        """The bytes of a token, and whether a gap follows it."""
        name, special = self.bpe.names[i], self.bpe.names[i] in self.bpe.special
        if self.surface or special:
            return name.encode("utf-8"), True
        ended = bool(self.bpe.suffix) and name.endswith(self.bpe.suffix)
        return bytes(self.byte[c] for c in (name[: -len(self.bpe.suffix)] if ended else name)), ended

    def _step(self, state: tuple[bytes, bool], i: int) -> tuple[str, tuple[bytes, bool]]:
        held, gap = state
        raw, gap_after = self._bytes(i)
        out = [" "] if gap else []
        for b in (raw[k : k + 1] for k in range(len(raw))):
            held += b
            try:
                out.append(held.decode("utf-8"))
                held = b""
            except UnicodeDecodeError as e:
                if e.reason != "unexpected end of data":
                    bad = held[: e.end]
                    out.append("\ufffd")
                    held = held[len(bad) :]
                    if held and held[0] < 0x80:
                        out.append(held.decode("ascii"))
                        held = b""
        if gap_after and held:
            out.append("\ufffd")
            held = b""
        return "".join(out), (held, gap_after)

    def feed(self, ids: list[int]) -> str:
        out, at = [], 0
        while at < len(ids):
            loops = self.loops.setdefault(self.state, {})
            try:
                out += [loops[i] for i in (ids[at:] if at else ids)]
                break
            except KeyError:
                at = self._walk(ids, at, out)
        return "".join(out)

    def _walk(self, ids: list[int], at: int, out: list[str]) -> int:
        """Steps from place `at` until the state changes or the ids end; returns the place."""
        state = self.state
        table, loops = self.steps.setdefault(state, {}), self.loops.setdefault(state, {})
        for at in range(at, len(ids)):
            i = ids[at]
            if i not in table:
                table[i] = self._step(state, i)
            text, self.state = table[i]
            out.append(text)
            if self.state != state:
                return at + 1
            loops[i] = text
        return len(ids)

    def end(self) -> str:
        """What is left at the end of the ids; the machine is at its start again."""
        left = "\ufffd" if self.state[0] else ""
        self.state = self.START
        return left


_LOADED: dict[str, tuple[Bpe, Decoder]] = {}


def bpe_of(path: str) -> tuple[Bpe, Decoder]:
    """The encoder of a vocabulary file and its decoder of surfaces, loaded once in each worker."""
    if path not in _LOADED:
        bpe = Bpe(path)
        _LOADED[path] = bpe, Decoder(bpe, surface=True)
    return _LOADED[path]


def _digests(bpe: Bpe, decoder: Decoder, text: str | None, kept: list | None) -> tuple[int, str, str]:
    """(number of ids, digest of the ids, digest of the decoded text), a piece at a time; kept, if given, gets the ids."""
    told, n = bpe.told, 0
    of_ids, of_text = hashlib.sha256(), hashlib.sha256()
    for ids in bpe.stream(text):
        of_ids.update(((" " if n else "") + " ".join([told[i] for i in ids])).encode())
        of_text.update(decoder.feed(ids).encode("utf-8"))
        n += len(ids)
        if kept is not None:
            kept += ids
    of_text.update(decoder.end().encode("utf-8"))
    return n, of_ids.hexdigest(), of_text.hexdigest()


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: bool = True) -> DataFrame:
    """docs with, in place of the text: n_tokens, ids_sha256, decoded_sha256 (decoded as the ids come) and ids (array of int).

    Without ids, a worker holds a text and about FEED ids at a time, whatever the text's length.
    """

    def run(texts: list) -> list:
        bpe, decoder = bpe_of(path)
        kept = [[] if ids else None for _ in texts]
        rows = [_digests(bpe, decoder, t, k) for t, k in zip(texts, kept, strict=True)]
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]
        return columns + ([kept] if ids else [])

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else ""), text)


def op5_bpe(spark, sf_dir):
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), default_vocabulary(), ids=False)
