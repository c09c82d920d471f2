import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell.sources import files
from tidewell.sources.tables import TABLES
from tidewell.streaming import ingest

CHECKED = ["visible_documents_user", "hybrid_rrf", "grounding_gate", "bm25_topk", "drive_diff", "orders_by_priority", "dedup_canonical", "eval_hit_at_k", "document_metadata_search", "audit_appended", "boundary_record_open", "landed_documents", "chunk_listing", "tier_escalation", "heading_levels", "followup_expand", "folder_tiers", "stream_ingest_counts"]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    told = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(told(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_queries_give_what_their_sql_gives(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = entry.queries()[name](spark, small)
    sql = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, sql.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("tidewell/llm", "tests/llm"), ("tidewell/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_training_data_operators(tmp_path, gone):
    home = Path(entry.__file__).parent
    copy = tmp_path / "copy"
    shutil.copytree(home, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *gone))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        else:
            (copy / name).unlink(missing_ok=True)
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(set(e.oracle_sql()) - set(e.queries())))"], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert told.returncode == 0, told.stderr
    names, extra = map(eval, told.stdout.strip().splitlines())
    assert extra == [] and "hybrid_rrf" in names and "pipeline" not in names
    assert any(n.startswith("op") for n in names) == (gone == ("corpus_pipeline.py",))
    if "tests/llm" in gone:
        found = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=copy, capture_output=True, text=True)
        assert found.returncode == 0, found.stdout


def test_formats_by_content(spark, tmp_path):
    import zipfile

    (tmp_path / "deep").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "~$lock.docx").write_bytes(b"x")
    (tmp_path / "deep/b.txt").write_bytes(b"x")
    (tmp_path / "deep/bad.xlsx").write_bytes(b"PK\x03\x04 broken")
    with zipfile.ZipFile(tmp_path / "deep/c.docx", "w") as z:
        z.writestr("XL/workbook.xml", "x")
    found = {r.path.rsplit("/", 1)[1]: r.format for r in files.detect_formats(files.discover(spark, str(tmp_path))).collect()}
    assert found == {"a.pdf": "PDF", "bad.xlsx": None, "c.docx": "XLSX"}


def test_stream_stages_write_each_batch_once(spark, small, tmp_path):
    source = ingest.read_events(spark, small, "events.parquet")
    for _ in range(2):
        ingest.stage_stream(source, lambda rows: rows.groupBy("event_type").count(), f"{tmp_path}/out", f"{tmp_path}/state", "event_id").awaitTermination()
    got = {r.event_type: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.event_type: r["count"] for r in spark.read.parquet(f"{small}/events.parquet").groupBy("event_type").count().collect()}
    assert got == want


def test_streams_read_a_table_of_part_files(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_ingest_counts", "stream_windowed_counts", "stream_user_sessions", "stream_first_seen"):
        got, want = (sorted(map(tuple, entry.queries()[name](spark, at).collect()), key=str) for at in (str(tmp_path), small))
        assert got == want and want, name
