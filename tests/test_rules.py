import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.functions import identifiers
from tidewell.functions import text as tx
from tidewell.operators import access, answers, chunking


def column(spark, values, kind="string"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, c {kind}")


def apply(spark, values, f):
    return [r[1] for r in column(spark, values).select("k", f(F.col("c"))).orderBy("k").collect()]


def test_visibility_truth_table(spark):
    rows = [(t, o, v, a) for t in ("PUBLIC", "RESTRICTED", None) for o, v in (("A", "A"), ("A", "B"), (None, "B"), (None, None)) for a in (False, True)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, o string, v string, a boolean")
    got = [r[1] for r in df.select("k", access.visible(F.col("t"), F.col("o"), F.col("v"), F.col("a"))).orderBy("k").collect()]
    assert got == [bool(a or t != "RESTRICTED" or (o is not None and o == v)) for t, o, v, a in rows]


def test_tiers_and_boundary(spark):
    pairs = [(a, b) for a in ("PUBLIC", "RESTRICTED", None) for b in ("PUBLIC", "RESTRICTED", None)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, new string, old string")
    rank = {"PUBLIC": 0, "RESTRICTED": 1, None: -1}
    got = [r[1] for r in df.select("k", access.stricter(F.col("new"), F.col("old"))).orderBy("k").collect()]
    assert got == [a if rank[a] > rank[b] else b for a, b in pairs]
    assert apply(spark, ["PUBLIC", "RESTRICTED", None, "other"], access.sendable) == [True, False, False, False]


@pytest.mark.parametrize(
    "value, label",
    [
        ("ABCDE1234F", "PAN"), ("27ABCDE1234F1Z5", "GSTIN"), ("SBIN0001234", "IFSC"), ("+91 98765 43210", "PHONE"), ("9876543210", "PHONE"), ("011-23063746", "PHONE"), ("rajesh@cpcb.nic.in", "EMAIL"), ("4111 1111 1111 1111", "CREDIT_CARD"),
    ],
)
def test_identifiers_are_found(value, label):
    assert [(f[2], f[3]) for f in identifiers.find_identifiers(f"see {value} here")] == [(label, value)]


@pytest.mark.parametrize("text", ["123456789012", "4567 8901 2345", "1234 5678 9012 3456", "210 MW commissioned in 1995", "0.20 per unit, 0-180 days, 05.09.2022", "", None])
def test_other_numbers_are_left_alone(text):
    assert identifiers.find_identifiers(text) == []


def test_check_digits(spark):
    numbers = [f"{random.Random(k).randint(2 * 10**11, 10**12 - 1)}" for k in range(200)] + ["123456789012", "12", "", "2345 6789 0124"]
    assert apply(spark, numbers, identifiers.verhoeff) == [identifiers.verhoeff_ok(n) for n in numbers]
    assert sum(identifiers.verhoeff_ok(f"23456789012{d}") for d in range(10)) == 1
    assert identifiers.luhn_ok("4111111111111111") and not identifiers.luhn_ok("4111111111111112") and not identifiers.luhn_ok("0")


def test_previews(spark):
    values = ["rajesh@cpcb.nic.in", "abcd@x.org", "a@b", "01123063746", "1234567", "12345678", ""]
    assert apply(spark, values, identifiers.preview) == ["rajxxx@cpcb.nic.in", "xxxx@x.org", "xxx@b", "011xxxxx746", "xxxxxxx", "123xx678", ""]


def test_cleaning(spark):
    cases = {
        "manage-\nment": "management", "Delhi-\nNCR": "Delhi-\nNCR", "a​b﻿": "ab", "soft­hyphen": "softhyphen", "lines\x0bfor": "lines\nfor", "bell\x07\x00": "bell",
        "x\r\ny\rz": "x\ny\nz", "top\nPage 3 of 10\nend": "top\nend", "a\n-2-\nb": "a\nb", "a\nContd...2/-\nb": "a\nb", "a   b\t\tc  \nd": "a b c\nd", "a\n\n\n\nb": "a\n\nb", "  x ": "x", "": "", "on page 3 of it": "on page 3 of it",
    }
    assert apply(spark, list(cases), tx.clean) == list(cases.values())
    folded = tx.nfkc(column(spark, ["ﬁn ＡＢ", "plain", None, ""]), "c").orderBy("k").collect()
    assert [r.c for r in folded] == ["fin AB", "plain", None, ""]


def test_prose_ratio_and_language(spark):
    texts = ["", None, "ab", "abc def", "X2000 X2001", "abc 12 x9y hello", "भारत सरकार"]
    want = [sum(len(t) for t in (x or "").split() if len(t) >= 3 and not any(c.isdigit() for c in t)) / len(x) if x else 0.0 for x in texts]
    assert apply(spark, texts, tx.prose_ratio) == pytest.approx(want)
    assert apply(spark, ["0.1", "0.15"], lambda c: tx.effective_language(c.cast("double"), F.lit("hi"))) == ["en", "hi"]


def test_detected_language_needs_forty_characters(spark):
    assert apply(spark, ["x" * 39, "x" * 40, None, " " * 60], lambda c: tx.detected_language(c, F.lit("en"))) == [None, "en", None, None]
    assert column(spark, [["a-\nb", " \x07 ", "c"]], "array<string>").select(tx.clean_all(F.col("c"))).first()[0] == ["ab", "c"]


def test_lexical_questions(spark):
    cases = {
        "What is the deadline for Category A plants?": "deadline Category A plants", "S.O. 3305 (E) of 2015": "S.O. 3305 (E) 2015", "the plan": "the plan", "": "", "Please list thermal stations.": "thermal stations",
        "Which notification covers the Station.": "notification covers Station",
    }
    assert apply(spark, list(cases), tx.lexical_question) == list(cases.values())
    assert apply(spark, ["What is the best chocolate-cake of 21?"], tx.informative_terms) == [["chocolate-cake"]]


def test_citations(spark):
    text = "A [1] claim [7], with [2] and [1] . None [0]."
    df = column(spark, [text])
    r = df.select(*(c.alias(n) for c, n in zip(answers.verify_citations(F.col("c"), F.lit(3)), ("cleaned", "valid", "invalid"), strict=True))).first()
    assert (r.cleaned, r.valid, r.invalid) == ("A [1] claim, with [2] and [1]. None.", [1, 2], [0, 7])


def test_numeric_and_quote_fidelity(spark):
    answer = 'By 31st December 2024, 1,02,040 units at 0.20 were 5 of 12 [3]. "Bid Awarded" and "the same project with a long status" v2.5'
    numbers = apply(spark, [answer], answers.checkable_numbers)[0]
    assert numbers == ["31", "2024", "102040", "0.20", "12"]
    hay = answers.normalised(F.lit("31 december 2024; 102040 for 0.20 and 512"))
    assert column(spark, [answer]).select(answers.supported(answers.checkable_numbers(F.col("c")), hay)).first()[0] == numbers
    assert apply(spark, [answer], answers.quotations) == [["the same project with a long status"]]
    assert apply(spark, ["Short one. This sentence is long enough to be a claim [2]. This other one is as long but without."], lambda c: F.size(answers.cited(answers.claims(c)))) == [1]


def test_followups(spark):
    yes = ["what about it?", "and the other plants in the northern grid", "Does it apply to Category C?", "why", "But which of the two is right then"]
    no = ["", None, "What is the deadline for thermal power plants in Delhi?", "Which notification covers sulphur limits nationally today?"]
    assert apply(spark, yes + no, answers.is_followup) == [True] * len(yes) + [False] * len(no)
    turns = spark.createDataFrame([(1, 0, "user", "Deadline for Category A plants in Delhi?"), (1, 1, "assistant", "x"), (1, 2, "user", "what about B?"), (2, 0, "user", "why")], "conv_id long, turn long, role string, text string")
    got = [(r.searched, r.expanded) for r in answers.expand_followups(turns).orderBy("conv_id", "turn").collect()]
    assert got == [("Deadline for Category A plants in Delhi?", False), ("Deadline for Category A plants in Delhi? what about B?", True), ("why", False)]


@pytest.mark.parametrize("per_token", [1.5, 2, 4, 6])
def test_every_passage_fits(per_token):
    rng = random.Random(int(per_token * 10))
    measure = lambda t: -(-len(t) // per_token)
    for n in (1, 5, 50, 200):
        text = " ".join("word " * rng.randint(3, 20) + "end." for _ in range(n))
        pieces = chunking.pack(text, measure, target=200, maximum=250)
        assert all(measure(p) <= 250 for p in pieces)
        assert re.sub(r"\s+", "", "".join(pieces)) == re.sub(r"\s+", "", text)
    assert chunking.pack("x" * 5000, len, 1600, 2000) == ["x" * 1800, "x" * 1800, "x" * 1400]
    assert chunking.pack("") == [] and chunking.pack(" a ") == ["a"]
