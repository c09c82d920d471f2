"""The newest event of each key as state of a stream, with timers that let it go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewell.streaming.ingest import run_to_end

#: The state store that state of this kind needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_ROWS = 1_000_000
CHANGES = "key long, part int, at long, event_id long, event_type string"


def state_session(spark: SparkSession, rows: int) -> SparkSession:
    """A session of the same application for streams with state: the store is its own setting, the caller's are untouched.

    A stream's number of state partitions stays what it was at its first start, and each holds a store of some
    megabytes on its executor however little is in it. So it goes by `rows`, the events that state is expected for:
    one partition for each STATE_ROWS, the cluster's parallelism at least.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", str(max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS))))
    return own


class NewestEvent(StatefulProcessor):
    """Keeps a key's newest event (time, then id) and tells each change; a timer drops the state `quiet` ms after that event."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long, event_id long, event_type string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.newest.get()) if self.newest.exists() else None
        best = old
        for pdf in rows:
            if len(pdf):
                r = pdf.sort_values(["at", "event_id"]).iloc[-1]
                one = (int(r["at"]), int(r["event_id"]), r["event_type"])
                best = one if best is None or one[:2] > best[:2] else best
        if best == old or best is None:
            return
        if old is not None:
            self.handle.deleteTimer(old[0] // 1000 + self.quiet)
        self.newest.update(best)
        self.handle.registerTimer(best[0] // 1000 + self.quiet)
        yield pd.DataFrame([(int(key[0]), int(key[1]), *best)], columns=["key", "part", "at", "event_id", "event_type"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_events(events: DataFrame, key: str, late: str = "2 days", quiet: int = 7 * 86_400_000, parts: int = 8) -> DataFrame:
    """CHANGES of the newest event of each key in a stream events(key, ts, event_id, event_type) of a session with STORE.

    Events later than `late` behind the newest one seen are dropped, as are those without key, time or id. A key's
    events are kept in `parts` states by their id, so that a key with a third of all events is not one task's; each
    tells its own changes, and `current` takes the newest of them. State goes `quiet` ms after its event, so what is
    kept grows with the keys of that time, not with all keys; an event that comes afterwards is told as a change, and
    `current` decides by time.
    """
    rows = events.where(f"`{key}` is not null and ts is not null and event_id is not null").withWatermark("ts", late)
    rows = rows.select(F.col(key).cast("long").alias("key"), F.pmod(F.xxhash64("event_id"), F.lit(parts)).cast("int").alias("part"), "ts", F.unix_micros("ts").alias("at"), "event_id", "event_type")
    return rows.groupBy("key", "part").transformWithStateInPandas(NewestEvent(quiet), CHANGES, "Append", "EventTime")


def current(changes: DataFrame, key: str) -> DataFrame:
    """(key, ts, event_id, event_type): the newest of the told changes."""
    best = changes.groupBy("key").agg(F.max(F.struct("at", "event_id", "event_type")).alias("e"))
    return best.select(F.col("key").alias(key), F.timestamp_micros("e.at").alias("ts"), "e.event_id", "e.event_type")


def follow(spark: SparkSession, events: DataFrame, key: str, shared: str, **law) -> DataFrame:
    """The current event of each key after a stream over what is there; events is a stream of a state_session."""
    return current(spark.read.parquet(run_to_end(newest_events(events, key, **law), shared)), key)
