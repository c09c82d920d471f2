"""Registered queries that SQL cannot say, each held over its whole tables against plain Python."""

import hashlib
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewell.functions.identifiers import KINDS, luhn_ok, verhoeff_ok
from tidewell.operators import listings


@pytest.fixture(scope="module")
def frames(small):
    return {n: pd.read_parquet(f"{small}/{n}.parquet") for n in ("documents", "conversations", "lineitem", "orders")}


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def run(spark, small, name):
    return [r.asDict() for r in entry.queries()[name](spark, small).collect()]


def split_to_fit(text, target=1600, most=2000):
    """The rule as told: what fits is one; else paragraphs, else sentences, else slices; neighbours join up to the target."""
    text = text.strip()
    if len(text) <= most:
        return [text] if text else []
    for boundary in (r"\n\s*\n", r"(?<=[.!?])\s+"):
        parts = [p.strip() for p in re.split(boundary, text) if p.strip()]
        if len(parts) > 1:
            out, mergeable = [], False
            for p in parts:
                if len(p) > most:
                    out += split_to_fit(p, target, most)
                    mergeable = False
                elif mergeable and len(out[-1]) + 2 + len(p) <= target:
                    out[-1] += "\n\n" + p
                else:
                    out.append(p)
                    mergeable = True
            return out
    return [s.strip() for s in (text[i : i + 1800] for i in range(0, len(text), 1800)) if s.strip()]


def chunks_of(text):
    """The title (first six words) is the one heading; it opens a section where it stands."""
    text = (text or "").strip()
    title = " ".join(text.split()[:6])
    at = text.find(title) if title else -1
    bodies = [text] if at < 0 else [text[:at].strip(), text[at:].strip()]
    return [p for b in bodies if b for p in split_to_fit(b)]


def test_chunks(spark, small, frames):
    want = {(d.doc_id, k): (len(p), md5(p)) for d in frames["documents"].itertuples() for k, p in enumerate(chunks_of(d.text))}
    assert {(r["doc_id"], r["chunk_index"]): (r["char_count"], r["digest"]) for r in run(spark, small, "chunk_documents")} == want
    per = {}
    for (doc, _), (n, _) in want.items():
        per.setdefault(doc, []).append(n)
    assert {r["doc_id"]: (r["chunks"], r["chars"], r["largest"], r["contiguous"]) for r in run(spark, small, "chunk_stats")} == {d: (len(v), sum(v), max(v), True) for d, v in per.items()}
    docs = frames["documents"].set_index("doc_id")
    again = {d: (len(v), sum(v)) if docs.lang[d] == "de" else (1, len(docs.text[d])) for d, v in per.items()}
    assert {r["doc_id"]: (r["chunks"], r["chars"]) for r in run(spark, small, "replaced_chunks") if r["doc_id"] in again} == again


def found_in(text):
    """Findings by marking characters as taken, kind by kind."""
    taken, out = set(), []
    for label, pattern, check in KINDS:
        for m in re.finditer(pattern, text or ""):
            digits = "".join(c for c in m[0] if c.isdecimal())
            ok = {
                None: lambda: True, "verhoeff": lambda: verhoeff_ok(m[0]), "luhn": lambda: luhn_ok(m[0]),  # noqa: B023
                "landline": lambda: (len(digits) == 11 and digits[0] == "0" and digits[1] != "0") or (len(digits) == 12 and digits[:2] == "91" and digits[2] != "0"),  # noqa: B023
                "mobile": lambda: (digits[2:] if len(digits) == 12 and digits[:2] == "91" else digits[1:] if len(digits) == 11 and digits[0] == "0" else digits if len(digits) == 10 else "0")[0] in "6789",  # noqa: B023
            }[check]()
            if ok and taken.isdisjoint(range(m.start(), m.end())):
                taken |= set(range(m.start(), m.end()))
                out.append((m.start(), m.end(), label, m[0]))
    return sorted(out)


@pytest.mark.parametrize("name, table, request_, place", [("redact_documents", "documents", "source", "doc_id"), ("redact_conversations", "conversations", "conv_id", "turn")])
def test_redaction(spark, small, frames, name, table, request_, place):
    want = {}
    for of, rows in frames[table].groupby(request_):
        numbers = {}
        for r in rows.sort_values(place).to_dict("records"):
            found, text = found_in(r["text"]), r["text"]
            for start, end, label, value in reversed(found):
                own = numbers.setdefault(label, {})
                text = text[:start] + f"<{label}_{own.setdefault(value, len(own) + 1)}>" + text[end:]
            if found or name == "redact_conversations":
                want[of, r[place]] = (len(found), md5(text))
    assert {(r[request_], r[place]): (r["findings"], r["digest"]) for r in run(spark, small, name)} == want and want


def test_identifier_counts(spark, small, frames):
    found = [(f[2], d.doc_id) for d in frames["documents"].itertuples() for f in found_in(d.text)]
    want = {k: (sum(x == k for x, _ in found), len({d for x, d in found if x == k})) for k in {x for x, _ in found}}
    assert {r["label"]: (r["n"], r["documents"]) for r in run(spark, small, "find_pii_counts")} == want


def grouped(header, lines):
    out, size = [], 0
    for line in lines:
        if not out or size + len(line) > max(len(header) + 1, 1800):
            out.append([])
            size = len(header)
        out[-1].append(line)
        size += len(line)
    return out


def test_tables(spark, small, frames):
    want = {}
    for key, rows in frames["lineitem"].groupby("l_suppkey"):
        lines = [f"{r.l_orderkey} | {r.l_linenumber} | {int(r.l_quantity)} | {r.l_returnflag}" for r in rows.sort_values(["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]).itertuples()]
        for k, g in enumerate(grouped("order | line | quantity | flag", sorted(lines, key=lambda x: (int(x.split(" | ")[0]), int(x.split(" | ")[1]), x)))):
            text = "\n".join(["order | line | quantity | flag", *g])
            want[key, k] = (len(g), len(text), md5(text))
    assert {(r["l_suppkey"], r["group"]): (r["rows"], r["chars"], r["digest"]) for r in run(spark, small, "table_row_groups")} == want
    want = {}
    for key, rows in frames["orders"].groupby("o_custkey"):
        header = f"Customer {key}\norder | date | price | status"
        lines = [f"{r.o_orderkey} | {r.o_orderdate:%Y-%m-%d} | {int(r.o_totalprice // 1)} | {r.o_orderstatus}" for r in rows.sort_values("o_orderkey").itertuples()]
        for k, g in enumerate(grouped(header, lines)):
            text = "\n".join([header, *g])
            want[key, k] = (len(g), len(text), md5(text))
    assert {(r["o_custkey"], r["group"]): (r["rows"], r["chars"], r["digest"]) for r in run(spark, small, "rendered_tables")} == want


def test_the_index_keeps_its_recall(spark, small):
    rows = run(spark, small, "vector_index_recall")
    assert rows and sum(r["hit"] for r in rows) >= 0.9 * sum(r["expected"] for r in rows)


def test_small_rules_of_listings(spark):
    mimes = spark.createDataFrame([("application/vnd.google-apps.document",), ("application/vnd.google-apps.form",), ("application/vnd.google-apps.map",), ("text/html",), (None,)], "m string")
    assert [tuple(r) for r in mimes.select(*listings.export_format(F.col("m"))).collect()] == [("docx", None), (None, "a form"), (None, "no export"), (None, None), (None, None)]
    errors = spark.createDataFrame([("TimeoutError",), ("ValueError",), (None,)], "e string")
    assert [r[0] for r in errors.select(listings.is_transient(F.col("e"))).collect()] == [True, False, False]
    assert (listings.page_size(0, "chunks"), listings.page_size(5000, "chunks"), listings.page_size(7, "deleted")) == (1, 1000, 7)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tidewell.sources.shared import shared_folder

    conf = SimpleNamespace(get=lambda key, default: default, set=lambda key, value: None)
    told = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="a"))
    with pytest.raises(ValueError):
        shared_folder(told("spark://host:7077"))
    assert shared_folder(told("local[4]")).startswith("file:///")
