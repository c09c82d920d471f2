"""Newest events as state of a stream: against a batch, with late events and forgotten state."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tidewell.sources.shared import shared_folder
from tidewell.streaming import status

SCHEMA = "doc_id long, ts timestamp, event_id long, event_type string"


def run(spark, files, **law):
    """files: one micro-batch each, in this order."""
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    own = status.state_session(spark, 2_000_000 if len(files) == 1 else 10)
    for k, rows in enumerate(files):
        spark.createDataFrame([(d, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), e, t) for d, h, e, t in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/f{k}")
    stream = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/f*")
    return {r.doc_id: (r.event_id, r.event_type) for r in status.follow(spark, stream, "doc_id", shared_folder(spark), **law).collect()}


def test_ties_nulls_and_order_inside_a_batch(spark):
    rows = [(1, 5, 1, "a"), (1, 5, 2, "b"), (1, 4, 9, "c"), (2, 1, 3, None), (None, 1, 4, "x"), (3, 2, None, "x")]
    assert run(spark, [rows]) == {1: (2, "b"), 2: (3, None)}


def test_late_events_are_dropped_and_old_ones_in_time_lose(spark):
    files = [[(1, 100, 1, "a"), (2, 10, 2, "a")], [(1, 90, 3, "old"), (2, 99, 4, "b")], [(3, 1, 5, "late"), (2, 200, 6, "c")]]
    assert run(spark, files, late="24 hours", parts=2) == {1: (1, "a"), 2: (6, "c")}


def test_forgotten_state_does_not_lose_the_newest(spark):
    files = [[(1, 0, 1, "a")], [(2, 500, 2, "b")], [(2, 501, 3, "c")], [(1, 490, 4, "d"), (2, 502, 5, "e")]]
    assert run(spark, files, late="24 hours", quiet=3_600_000, parts=1) == {1: (4, "d"), 2: (5, "e")}


def test_the_whole_table_equals_the_batch(spark, small):
    from __spark_entry__ import queries

    got = {r.doc_id: r for r in queries()["stream_document_status"](spark, small).collect()}
    want = {r.doc_id: r for r in queries()["document_status"](spark, small).collect()}
    assert got == want and len(want) > 0 and any(r.last_event for r in want.values())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != status.STORE
