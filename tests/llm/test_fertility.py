"""Tokeniser fertility: base rules and measures held against plain Python over the whole table, verdicts against labels."""

import math
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from tidewell.llm import fertility
from tidewell.llm.common import table
from tidewell.llm.fertility import BANDS, Pieces, judge_quality, op12_fertility

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORDS.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    twice = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice), failed


def plain_measures(tokens, words, fallback):
    """letters, fallback, entropy of one text in one vocabulary."""
    n = len(tokens)
    if n < fertility.LEAST:
        return None, None, None
    spans = [tokens[i : i + fertility.SPAN] for i in range(0, n, fertility.SPAN)]
    bits = [-sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) / math.log2(len(s)) for s in spans if len(s) >= fertility.LEAST]
    return sum(c.isalnum() for w in words for c in w) / n, sum(fallback(t) for t in tokens) / n, sum(bits) / len(bits)


@pytest.fixture(scope="module")
def libraries():
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    import base64

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tt = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def part(t):
        try:
            tt.decode_single_token_bytes(t).decode()
        except UnicodeDecodeError:
            return True
        return False

    return [(lambda w: sp.encode(w), sp.is_byte), (lambda w: tt.encode_ordinary(" " + w), part)]


def test_query_equals_plain_python(spark, libraries):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    out = judge_quality(table(spark, SF, "documents").select("doc_id", "lang", "text"), lang="lang").collect()
    assert len(out) == len(docs)
    for r in out:
        text = docs[r.doc_id].text
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text)
        assert r.kept == (not r.base_failed and not r.reasons)
        if r.n_words > 1500:
            continue
        words = WORDS.findall(text or "")
        for k, (encode, fallback) in enumerate(libraries):
            want = plain_measures([t for w in words for t in encode(w)], words, fallback)
            assert (r.letters[k], r.fallback[k], r.entropy[k]) == tuple(None if v is None else pytest.approx(v) for v in want)
    told = {r.doc_id: r.kept for r in op12_fertility(spark, SF).collect()}
    assert told == {r.doc_id: r.kept for r in out}


def test_clean_documents_stay_and_junk_goes(spark):
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    rows = [r for r in op12_fertility(spark, "/root/testdata/sf0.1").collect() if r.doc_id in labels and not r.base_failed]
    clean = [r.kept for r in rows if labels[r.doc_id]]
    junk = [r.kept for r in rows if not labels[r.doc_id]]
    assert len(clean) > 3000 and all(clean)
    assert junk.count(False) > 0.7 * len(junk)


def test_scripts_odd_rows_and_clashing_columns(spark):
    prose = {"ru": "мы шли домой по старой дороге и говорили о погоде и о том что будет завтра утром когда придёт поезд ", "zh": "我们 走 在 回家 的 路上 谈论 天气 和 明天 早上 火车 到来 时 会 发生 什么 事情 你 觉得 怎么样 呢 "}
    rows = [(1, None, 1), (2, "", 1), (None, " \t\n", 1), (3, "a\x00b ퟿ é" + " x" * 20, 2), (4, prose["ru"] * 3, 3), (5, prose["zh"] * 3, 4), (6, "word " * 50_000, 5), (6, "word " * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = judge_quality(docs).collect()
    assert len(got) == 8 and sorted(r.n_words for r in got)[:3] == [0, 0, 0]
    assert all(r.base_failed and not r.kept and r.letters == [None, None] for r in got if not r.n_words)
    assert [r.n_repeat_words for r in got if r.doc_id == 6] == [50_000] * 2
    script = judge_quality(spark.createDataFrame([(k, " ".join(dict.fromkeys(t.split()))) for k, t in prose.items()], "doc_id string, text string")).collect()
    assert all(not r.reasons for r in script)
    assert judge_quality(docs.limit(0)).count() == 0


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(fertility, "KNOWN", 50)
    run = fertility.judge(fertility.default_paths(), BANDS)
    texts = [{"text": " ".join(f"w{k}x{j}" for j in range(80)), "lang": "en"} for k in range(5)]
    apart = [run([t]) for t in texts]
    together = fertility.judge(fertility.default_paths(), BANDS)(texts)
    assert [[c[0] for c in a] for a in apart] == [[c[k] for c in together] for k in range(5)]


def test_fallback_tells_parts_of_characters():
    p = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    [tokens] = p.encode(["\U0001f9ffᚠ"])
    assert sum(p.fallback[t] for t in tokens) >= 4
