import io
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from tidewell.operators import chunking, evals, layout, lifecycle, redaction, retrieval, sync
from tidewell.sources import files

GOVERNED = "doc_id long, text string, title string, owner_id string, classification string, deleted_at timestamp"


def corpus(spark, extra=()):
    rows = [
        (1, "thermal power plants must meet emission norms", "norms", "A", "PUBLIC", None),
        (2, "coal supply to thermal stations", "coal", "A", "RESTRICTED", None),
        (3, "chocolate cake recipe", "cake", "B", None, None),
        (4, "emission norms for thermal plants", "old norms", "B", "PUBLIC", datetime(2024, 1, 1)),
        *extra,
    ]
    return spark.createDataFrame(rows, GOVERNED)


def ask(spark, viewer="B", admin=False):
    return spark.createDataFrame([(1, "emission norms for thermal plants", [1.0, 0.0], viewer, admin)], "question_id long, question string, vector array<double>, viewer_id string, is_admin boolean")


def vectors(spark, more=()):
    return spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), *more], "doc_id long, embedding array<double>")


def ids(df, place="fusion_rank"):
    return [r.doc_id for r in df.orderBy("question_id", place).collect()]


def test_search_respects_viewers(spark):
    docs, v = corpus(spark), vectors(spark)
    assert 2 not in ids(retrieval.search(ask(spark), docs, v)) and 4 not in ids(retrieval.search(ask(spark), docs, v))
    assert 2 in ids(retrieval.search(ask(spark, "A"), docs, v)) and 2 in ids(retrieval.search(ask(spark, None, True), docs, v))
    assert ids(retrieval.search(ask(spark), docs, v, mode="semantic")) == [1, 3]
    assert ids(retrieval.search(ask(spark), docs, v, mode="lexical")) == [1]


def test_invisible_rows_do_not_crowd_out_visible_ones(spark):
    hidden = [(100 + k, "thermal plants emission norms", "t", "Z", "RESTRICTED", None) for k in range(80)]
    docs = corpus(spark, hidden)
    found = retrieval.search(ask(spark), docs, vectors(spark, [(100 + k, [1.0, 0.0]) for k in range(80)]), limit=3)
    assert ids(found) == [1, 3]


def test_fusion_modes_scope_and_rerank(spark):
    docs, v = corpus(spark), vectors(spark)
    row = {r.doc_id: r for r in retrieval.search(ask(spark), docs, v).collect()}
    assert row[1].score == round(2 / 61, 9) and row[3].lexical_rank is None and row[3].score == round(1 / 62, 9)
    scope = spark.createDataFrame([(1, 3)], "question_id long, doc_id long")
    assert ids(retrieval.search(ask(spark), docs, v, scope=scope)) == [3]
    best = retrieval.search(ask(spark), docs, v, rerank=True, limit=1).collect()
    assert [(r.doc_id, r.rerank_score, r.position) for r in best] == [(1, 1.0, 1)]
    assert retrieval.candidate_pool(10) == 50 and retrieval.candidate_pool(50) == 200 and retrieval.candidate_pool(300) == 200


def test_grounding(spark):
    docs = corpus(spark)
    found = retrieval.search(ask(spark), docs, vectors(spark))
    gate = retrieval.grounding(found, ask(spark), docs)
    assert gate.first().literal and gate.first().grounded
    other = spark.createDataFrame([(1, "unrelated zebra question", [0.6, -1.0], "B", False)], ask(spark).schema)
    found = retrieval.search(other, docs, vectors(spark))
    gate = retrieval.grounding(found, other, docs)
    assert not gate.first().grounded and retrieval.withhold(found, gate).count() == 0
    assert retrieval.grounding(found, other, docs, scoped=True).first().grounded


def test_redaction_numbers_from_the_end_of_the_first_passage(spark):
    rows = [(1, 0, "call 9876543210 or 9876543211, pan ABCDE1234F"), (1, 1, "again 9876543211 and a@b.org"), (2, 0, "nothing"), (2, 1, None)]
    out = {(r.r, r.p): r.redacted for r in redaction.redact(spark.createDataFrame(rows, "r int, p int, text string"), "r", "p").collect()}
    assert out[1, 0] == "call <PHONE_2> or <PHONE_1>, pan <PAN_1>" and out[1, 1] == "again <PHONE_1> and <EMAIL_1>"
    assert out[2, 0] == "nothing" and out[2, 1] is None
    masked = redaction.masked_values(redaction.find_all(spark.createDataFrame(rows, "r int, p int, text string")), "r").where("label = 'PHONE'").first()
    assert masked["values"] == 2 and masked.previews == ["987xxxx210", "987xxxx211"]


def test_boundary(spark):
    rows = [(1, "PUBLIC"), (1, "RESTRICTED"), (1, None), (2, "RESTRICTED"), (2, "odd")]
    got = {r.r: (r.considered, r.sent, r.withheld, r.tier, r.refused) for r in redaction.boundary_record(spark.createDataFrame(rows, "r int, classification string"), "r").collect()}
    assert got == {1: (3, 1, 2, "PUBLIC", False), 2: (2, 0, 2, "PUBLIC", True)}
    df = spark.createDataFrame([(*r, 3) for r in rows], "r int, classification string, n int")
    got = {r.r: (r.sent, r.tier, r.refused) for r in redaction.boundary_record(df, "r", allow_restricted=True, expected="n").collect()}
    assert got == {1: (3, "RESTRICTED", False), 2: (2, "RESTRICTED", True)}


def test_findings_replace_a_column_of_that_name(spark):
    df = spark.createDataFrame([(1, 0, "a@b.org and a@b.org, c@d.org", "old", "old")], "r int, p int, text string, findings string, redacted string")
    out = redaction.redact(df, "r", "p").first()
    assert out.redacted == "<EMAIL_2> and <EMAIL_2>, <EMAIL_1>" and len(out.findings) == 3
    record = redaction.masked_record(redaction.redact(df, "r", "p"), "r").first().masked
    assert [(m.label, m["count"], m.previews) for m in record] == [("EMAIL", 2, ["xxx@b.org", "xxx@d.org"])]


def test_sections_and_headings(spark):
    units = spark.createDataFrame([(1, 0, "lead One body one Two body two", ["One", "absent", "Two"]), (1, 1, "runs on", []), (1, 2, "", None), (2, 0, "Title here", ["Title"])], "doc int, unit int, text string, headings array<string>")
    parts = chunking.split_sections(units, ["doc", "unit"])
    assert [(r.heading, r.body) for r in parts.where("doc = 1").orderBy("unit", "section").collect()] == [(None, "lead"), ("One", "One body one"), ("Two", "Two body two"), (None, "runs on")]
    chunks = chunking.chunk_sections(parts, "doc", "unit").where("doc = 1").orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.heading) for r in chunks] == [(0, None), (1, "One"), (2, "Two"), (3, "Two")]
    alone = chunking.chunk_sections(parts, "doc", "unit", stand_alone=True).where("doc = 1").orderBy("chunk_index").collect()
    assert alone[-1].heading is None


def test_groups_are_halved_and_bare_headings_go(spark):
    lines = ["x" * 10] * 40
    groups = chunking.group_lines("head", lines, lambda t: len(t) * (2 if len(t) > 100 else 1), 200)
    assert [x for g in groups for x in g] == lines and all(len("\n".join(["head", *g])) * 2 <= 200 or len(g) == 1 or len("\n".join(["head", *g])) <= 100 for g in groups)
    assert chunking.group_lines("h", []) == [] and chunking.group_lines("h", ["y" * 5000, "z"]) == [["y" * 5000], ["z"]]
    sections = spark.createDataFrame([(1, 0, "A", " A "), (1, 1, "B", "B"), (1, 2, "A", "A text"), (1, 3, None, "")], "doc int, section int, heading string, body string")
    items = spark.createDataFrame([(1, "A"), (1, None)], "doc int, heading string")
    assert sorted(r.section for r in chunking.without_bare_headings(sections, items, ["doc"]).collect()) == [1, 2, 3]
    units = spark.createDataFrame([(1, True), (2, False), (3, None)], "u int, text_is_table boolean")
    assert sorted(r.u for r in chunking.prose_units(units).collect()) == [2, 3]


def test_row_groups_repeat_the_header(spark):
    lines = [f"row {k} | {'x' * (k % 40)}" for k in range(500)] + ["y" * 3000]
    out = chunking.row_groups(spark.createDataFrame([(1, "a | b", lines)], "k int, header string, lines array<string>"), "k", "header", "lines").orderBy("group").collect()
    assert all(r.text.startswith("a | b\n") for r in out) and [x for r in out for x in r.text.split("\n")[1:]] == lines
    assert all(len(r.text) <= 2000 for r in out[:-1]) and out[-1].rows == 1
    assert [r[0] for r in spark.createDataFrame([("1 : a\n\n 2 : b ",), (None,)], "c string").select(chunking.cell_text(F.col("c"))).collect()] == ["1 : a; 2 : b", ""]


def test_top_of_each_and_stage_guards(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2], k) for k in range(10)], "k int, g string, v int")
    got = {(r.g, r.place): r.k for r in lifecycle.top_of_each(rows, "g", [F.col("v").desc()], 2).collect()}
    assert got == {("a", 1): 8, ("a", 2): 6, ("b", 1): 9, ("b", 2): 7}
    docs = spark.createDataFrame([(1, "VALIDATED"), (2, "CHUNKED"), (3, "EMBEDDING_FAILED"), (4, "EMBEDDING_FAILED"), (5, None)], "doc_id long, status string")
    assert [r[0] for r in docs.orderBy("doc_id").select(lifecycle.stage_guard(F.col("status"))).collect()] == ["EXTRACT", "EMBED", None, None, None]
    jobs = spark.createDataFrame([(4, "PENDING"), (3, "DONE")], "doc_id long, status string")
    assert [tuple(r) for r in lifecycle.backfill_reset(docs, jobs, "EMBED").collect()] == [(3, "CHUNKED", "EMBED")]


def test_validation_ladder(spark):
    rows = [("", 0, True), ("x", 200 * 1024 * 1024, True), ("x", 1, False), ("a /JavaScript b", 20, True), ("fine /OpenAction", 20, True)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, s long, ok boolean").select(lifecycle.rejection(F.col("c"), F.col("s"), F.col("ok"))).collect()]
    assert got == ["EMPTY_FILE", "FILE_TOO_LARGE", "INVALID_MIME_TYPE", "MALICIOUS_THREAT_DETECTED", None]


def test_validation_ladder_looks_into_containers(spark):
    def office(*names):
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w") as z:
            for n in names:
                z.writestr(n, "x")
        return made.getvalue()

    types, word, sheet = "[Content_Types].xml", "word/document.xml", "xl/workbook.xml"
    cases = [
        ("PDF", b"%PDF-1.7 x %%EOF", None),
        ("PDF", b"PK\x03\x04 %%EOF", "CORRUPTED_PDF_STRUCTURE"),
        ("PDF", b"%PDF-1.7 %%EOF" + b" " * 1024, "CORRUPTED_PDF_STRUCTURE"),
        ("PDF", b"%PDF-1.7" + b" " * 2000 + b"%%EOF", None),
        ("PDF", b"%PDF- /Launch %%EOF", "MALICIOUS_THREAT_DETECTED"),
        ("DOCX", office(types, word), None),
        ("DOCX", office(types.upper(), word.upper()), None),
        ("DOCX", office(word), "CORRUPTED_OOXML_STRUCTURE"),
        ("DOCX", b"PK\x03\x04 broken /Launch", "CORRUPTED_OOXML_STRUCTURE"),
        ("DOCX", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1 old", "ENCRYPTED_OOXML"),
        ("DOCX", office(types, sheet), "CORRUPTED_OOXML_STRUCTURE"),
        ("XLSX", office(types, sheet, "xl/vbaProject.bin"), "MACRO_ENABLED_DOCUMENT"),
        ("XLSX", office(types, sheet, "a/../../b"), "UNSAFE_ARCHIVE_ENTRY"),
        ("XLSX", office(types, sheet, "C:x"), "UNSAFE_ARCHIVE_ENTRY"),
        ("XLSX", office(types, sheet, "powershell.exe", "/x"), "MALICIOUS_THREAT_DETECTED"),
        ("XLSX", office(types, sheet, *map(str, range(10_000))), "TOO_MANY_ARCHIVE_ENTRIES"),
        ("XLSX", b"", "EMPTY_FILE"),
        ("XLSX", None, "CORRUPTED_OOXML_STRUCTURE"),
    ]
    given = spark.createDataFrame([(k, f, bytearray(c) if c is not None else None) for k, (f, c, _) in enumerate(cases)], "path int, format string, content binary")
    rows = given.join(files.archive_facts(given), "path")
    c, fmt = F.col("content"), F.col("format")
    rule = lifecycle.rejection(c, F.length(c), fmt.isNotNull(), lifecycle.container_fault(c, fmt, F.col("parts")), lifecycle.structure_fault(fmt, F.col("parts"), F.col("unpacked")))
    assert [r[0] for r in rows.orderBy("path").select(rule).collect()] == [want for *_, want in cases]
    large = spark.createDataFrame([("DOCX", [types, word], 600 * 1024 * 1024)], "f string, p array<string>, u long")
    assert large.select(lifecycle.structure_fault(F.col("f"), F.col("p"), F.col("u"))).first()[0] == "ARCHIVE_TOO_LARGE"
    assert files.archive_facts(given.limit(0)).collect() == []


def test_dedup_and_escalation(spark):
    rows = [(1, "h", 1, "PUBLIC"), (2, "h", 2, "RESTRICTED"), (3, "g", 1, "RESTRICTED"), (4, "g", 2, "PUBLIC"), (5, "k", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id int, sha256 string, created_at int, classification string")
    assert {r.doc_id: r.canonical_id for r in lifecycle.dedup_canonical(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert {r.canonical_id: (r.tier, r.escalated) for r in lifecycle.escalate_tiers(docs).collect()} == {1: ("RESTRICTED", True), 3: ("RESTRICTED", False), 5: (None, False)}


def test_missing_digests_and_inactive_documents(spark):
    rows = [(1, None, 1, "PUBLIC"), (2, None, 2, "RESTRICTED"), (3, "g", 1, "PUBLIC"), (4, "g", 2, "RESTRICTED")]
    docs = spark.createDataFrame(rows, "doc_id int, sha256 string, created_at int, classification string")
    assert {r.doc_id: (r.canonical_id, r.is_duplicate) for r in lifecycle.dedup_canonical(docs).collect()} == {1: (1, False), 2: (2, False), 3: (3, False), 4: (3, True)}
    assert {r.canonical_id: (r.copies, r.tier, r.escalated) for r in lifecycle.escalate_tiers(docs).collect()} == {1: (1, "PUBLIC", False), 2: (1, "RESTRICTED", False), 3: (2, "RESTRICTED", True)}
    status = docs.withColumn("status", F.when(F.col("doc_id") == 3, "SUPERSEDED").otherwise("LIVE"))
    assert {r.doc_id: (r.canonical_id, r.is_duplicate) for r in lifecycle.dedup_canonical(status).collect()} == {1: (1, False), 2: (2, False), 3: (4, False), 4: (4, False)}
    assert {r.canonical_id: (r.tier, r.escalated) for r in lifecycle.escalate_tiers(status).where("sha256 = 'g'").collect()} == {4: ("RESTRICTED", False)}
    none = status.where("doc_id = 3")
    assert [(r.canonical_id, r.is_duplicate) for r in lifecycle.dedup_canonical(none).collect()] == [(None, False)] and lifecycle.escalate_tiers(none).count() == 0


def test_eval_candidates_are_live_prose(spark):
    text = "plain words of prose " * 20
    rows = [(1, text, "LIVE", None, False), (2, text, "DUPLICATE", None, False), (3, text, "LIVE", 1, False), (4, text, "LIVE", None, True), (5, "short", "LIVE", None, False), (6, "1 2 3 " * 80, "LIVE", None, False), (7, text, "LIVE", None, None)]
    docs = spark.createDataFrame([(*r, "g") for r in rows], "doc_id long, text string, status string, deleted_at int, is_table boolean, g string")
    assert sorted(r.doc_id for r in evals.candidates(docs, 9, "g").collect()) == [1, 7]


def test_tiers_go_round_cycles_once(spark):
    folders = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), (None, "a"), ("e", None)], "folder string, parent string")
    roots = spark.createDataFrame([("a", "PUBLIC"), ("c", "RESTRICTED"), (None, "RESTRICTED")], "folder string, tier string")
    assert {r.folder: r.tier for r in sync.folder_tiers(folders, roots).collect()} == dict.fromkeys("abcd", "RESTRICTED")
    roots = spark.createDataFrame([("a", "PUBLIC")], "folder string, tier string")
    assert {r.folder: r.tier for r in sync.folder_tiers(folders, roots, 2).collect()} == dict.fromkeys("abc", "PUBLIC")


def test_substring_search(spark):
    rows = [(1, "Coal Plants", "A", "the emission norms for thermal plants apply"), (2, None, "Bx", "norms"), (3, "x", "C", None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, title string, owner_id string, text string, created_at int")
    asked = spark.createDataFrame([(1, "EMISSION norms for"), (2, "n"), (3, "coal pl"), (4, "sion norms for ther"), (5, " "), (6, "norms of for"), (7, "bX"), (8, None)], "question_id long, question string")
    assert sorted((r.question_id, r.doc_id) for r in retrieval.search_metadata(docs, asked).collect()) == [(1, 1), (2, 1), (2, 2), (3, 1), (4, 1), (7, 2)]


def test_passages_are_searched_under_permissions(spark):
    import uuid

    rows = [(k, f"Norms {k} " + f"emission limits of plant number{k} stand here. " * 60, f"Norms {k}", "AB"[k % 2], "RESTRICTED" if k % 2 else "PUBLIC", None) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, owner_id string, classification string, deleted_at timestamp")
    passages = chunking.passages_of(docs)
    assert passages.groupBy("doc_id").count().where("count > 1").count() == 6
    asked = spark.createDataFrame([(1, "limits number3 plant", "A", False), (2, "limits number3 plant", "B", False)], "question_id long, question string, viewer_id string, is_admin boolean")
    from tidewell.sources.shared import shared_folder

    found = retrieval.search_passages(asked, passages, f"{shared_folder(spark)}/p-{uuid.uuid4().hex}", 3).collect()
    assert {r.doc_id for r in found if r.question_id == 1} <= {0, 2, 4} and [r.doc_id for r in found if (r.question_id, r.place) == (2, 1)] == [3]


def test_sync_decisions(spark):
    known = spark.createDataFrame([("same", "m", "t", "IMPORTED", "PUBLIC"), ("edit", "m", "t", "IMPORTED", "RESTRICTED"), ("gone", "m", "t", "IMPORTED", "PUBLIC"), ("back", "m", "t", "REMOVED", "PUBLIC"), ("moved", "m", "t", "IMPORTED", "PUBLIC"), ("time", None, "t", "IMPORTED", "PUBLIC")], "file_id string, md5 string, modified string, state string, tier string")
    now = spark.createDataFrame([("same", "m", "t2", "PUBLIC", 1, None), ("edit", "n", "t", "RESTRICTED", 1, None), ("back", "m", "t", "PUBLIC", 1, None), ("moved", "m", "t", "RESTRICTED", 1, None), ("time", None, "t2", "PUBLIC", 1, None), ("new", "m", "t", "PUBLIC", 1, None), ("form", "m", "t", "PUBLIC", 1, "a form"), ("big", "m", "t", "PUBLIC", 2 * 10**8, None)], "file_id string, md5 string, modified string, tier string, size long, reason string")
    got = {r.file_id: r.action for r in sync.diff(known, now).collect()}
    assert got == {"same": "UNCHANGED", "edit": "EDIT", "gone": "REMOVE", "back": "RESTORE", "moved": "RECLASSIFY", "time": "EDIT", "new": "IMPORT", "form": "SKIP", "big": "SKIP"}
    assert {r.file_id: r.action for r in sync.diff(known, now, partial=True).collect()}["gone"] == "KEEP"


def test_versions_settle(spark):
    rows = [("a", 1, 1, "CURRENT", "LIVE"), ("a", 2, 2, "PENDING", "LIVE"), ("b", 3, 1, "CURRENT", "LIVE"), ("b", 4, 2, "PENDING", "CHUNKED"), ("c", 5, 1, "CURRENT", "LIVE"), ("c", 6, 2, "PENDING", "DUPLICATE"), ("d", 7, 1, "PENDING", "EMBEDDING_FAILED")]
    got = {r.document_id: r.new_state for r in sync.reconcile(spark.createDataFrame(rows, "file_id string, document_id int, imported_at int, state string, status string")).collect()}
    assert got == {1: "SUPERSEDED", 2: "CURRENT", 3: "CURRENT", 4: "PENDING", 5: "CURRENT", 6: "DUPLICATE", 7: "FAILED"}


def test_schedule_keeps_to_the_wall_clock(spark):
    rows = [(datetime(2024, 3, 30, 23, 30), datetime(2024, 3, 30, 23, 30), False), (None, None, False), (datetime(2024, 3, 1), datetime(2024, 3, 2), True)]
    df = spark.createDataFrame(rows, "s timestamp, a timestamp, f boolean")
    now = F.lit(datetime(2024, 4, 1))
    got = [r[0] for r in df.select(sync.next_run(now, F.col("s"), F.col("a"), F.col("f"), 0, 0, "Europe/Berlin")).collect()]
    assert got == [datetime(2024, 3, 31, 22), datetime(2024, 4, 1), datetime(2024, 3, 2, 1)]


def test_headings_by_size_and_subject(spark):
    lines = spark.createDataFrame([(1, "Big Title", 20.0), (1, "body text " + "long " * 60, 10.0), (1, "Sub", 12.04), (1, "x" * 130, 20.0), (1, "near body", 11.0)], "doc int, text string, size double")
    got = {r.text[:9]: r.level for r in layout.infer_headings(lines, "doc").collect()}
    assert got == {"Big Title": 1, "body text": None, "Sub": 2, "x" * 9: None, "near body": None}
    units = spark.createDataFrame([(1, "To all\nSubject: Flue Gas De-\nsulphurisation"), (2, "Sub.: Norms"), (3, "subject matter")], "k int, text string")
    assert [(r.k, r.heading) for r in layout.subject_lines(units, "k").orderBy("k").collect()] == [(1, "Subject: Flue Gas"), (2, "Sub.: Norms")]


def test_words_fall_into_cells_and_rows(spark):
    words = spark.createDataFrame([(1, "a", 2.0, 2.0, 8.0, 8.0), (1, "b", 12.0, 2.0, 18.0, 8.0), (1, "out", 18.0, 2.0, 28.0, 8.0), (1, "low", 2.0, 40.0, 8.0, 46.0)], "page int, word string, x1 double, y1 double, x2 double, y2 double")
    cells = spark.createDataFrame([(1, 0, 0.0, 0.0, 20.0, 10.0)], "page int, cell int, cx1 double, cy1 double, cx2 double, cy2 double")
    assert [r.text for r in layout.words_in_cells(words, cells, "page", 10.0).collect()] == ["a b"]
    assert {r.word: r.row for r in layout.rows_of_words(words, "page").collect()} == {"a": 1, "b": 1, "out": 1, "low": 2}


def test_rank_measures(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None), (4, 10)], "question_id int, rank int")
    r = evals.summary(ranks).first()
    assert (r.n, r.hit_at_1, r.hit_at_5, r.hit_at_k, r.mrr) == (4, 0.25, 0.5, 0.75, round((1 + 0.25 + 0.1) / 4, 6))


def test_question_templates(spark):
    docs = spark.createDataFrame([(1, "Category A plants comply by 31st December 2024 under Section 5A at Rs. 0.20 per unit", "A heading here"), (2, "category b", "1 number"), (3, "Category A again", "A HEADING HERE")], "doc_id long, text string, title string")
    got = {r.question: r.doc_id for r in evals.derive_questions(docs).collect()}
    assert got["What applies to Category A thermal power plants?"] == 1 and got["What does Section 5A provide for?"] == 1
    assert got["What is the deadline of 31st December 2024 for?"] == 1 and got["What does the corpus say about A heading here?"] == 1
    assert not any(v in (2, 3) for v in got.values())
