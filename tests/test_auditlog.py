"""The guarded audit log: rows as by a plain reading, buckets read, what a run that died leaves."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidewell.operators import auditlog
from tidewell.sources.shared import shared_folder

SCHEMA = "user string, ts timestamp, event_id long, event_type string, note string"


def events(spark, rows):
    return spark.createDataFrame([(u, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), e, t, f"n{e}") for u, m, e, t in rows], SCHEMA)


def plain(batches, repeatable):
    seen, out = set(), set()
    for rows in batches:
        for u, _, e, t in sorted(rows, key=lambda r: (r[1], r[2])):
            if t in repeatable:
                out.add(e)
            elif (u, t) not in seen:
                seen.add((u, t))
                out.add(e)
    return out


def folder_of(spark):
    return f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"


@pytest.mark.parametrize("bits", [auditlog.BITS, 8])
def test_rows_are_those_of_a_plain_reading(spark, bits):
    rng, folder, batches = random.Random(4), folder_of(spark), []
    for b in range(3):
        batches.append([(rng.choice([None, *"abcdefgh"]), rng.randrange(9), 100 * b + k, rng.choice(["x", "y", None, "click"])) for k in range(25)])
        auditlog.append(events(spark, batches[-1]), folder, "user", ("click",), buckets=5, bits=bits)
    log = spark.read.parquet(f"{folder}/log").collect()
    assert len(log) == len({r.event_id for r in log}) and {r.event_id for r in log} == plain(batches, ("click",))
    assert all(r.note == f"n{r.event_id}" for r in log)


def test_only_the_buckets_of_known_events_are_read(spark):
    folder = folder_of(spark)
    assert auditlog.append(events(spark, [(f"u{k}", 0, k, "x") for k in range(300)]), folder, "user", buckets=16) == (0, 0)
    assert auditlog.append(events(spark, [(f"v{k}", 0, 1000 + k, "x") for k in range(50)]), folder, "user", buckets=16) == (0, 16)
    assert auditlog.append(events(spark, [("u7", 0, 2000, "x"), ("w", 0, 2001, "x")]), folder, "user", buckets=16) == (1, 16)
    assert auditlog.append(events(spark, []), folder, "user", buckets=16) == (0, 16)
    assert spark.read.parquet(f"{folder}/log").count() == 351


def test_bits_without_their_events_lose_nothing(spark):
    folder = folder_of(spark)
    auditlog.append(events(spark, [("a", 0, 1, "x")]), folder, "user")
    # a run that died after its filters: bits of b, no event of b
    auditlog._marks(events(spark, [("b", 0, 2, "x")]), "user", auditlog.BITS).groupBy("slice").agg(F.bitmap_construct_agg("place").alias("bitmap")).write.mode("append").parquet(f"{folder}/filters")
    auditlog.append(events(spark, [("b", 0, 3, "x"), ("a", 5, 4, "x")]), folder, "user")
    assert {r.event_id for r in spark.read.parquet(f"{folder}/log").collect()} == {1, 3}
