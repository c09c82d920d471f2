"""An append-only log that keeps each kind of event once for a key, with a filter beside it that spares reading the log.

Below a folder: `log`, by bucket of the key (kinds that may be repeated lie in bucket -1, which is never asked), and
`filters`, bitmaps over two hashes of (key, kind). An append asks the bitmaps first: an event with a bit that is not
set is new for certain; the others are held against the log exactly, and only their buckets are read. Each append
adds the bitmaps of its own events (before the log, so a run that dies between leaves bits too many, never too few);
what is read of the filters is 4 KB for each slice that fresh events fall into. Null keys are a key of their own;
a null kind is a kind. event_id names an event: rows of one id are one event, but for kinds that may be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.joins import small_side

ONCE_BUCKETS, BITS, SEEDS = 64, 1 << 23, (11, 23)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _repeats(repeatable: tuple) -> Column:
    return F.coalesce(F.col("event_type").isin(*repeatable), F.lit(False))


def _marks(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """rows, once for each hash, with the slice and the place in it of that hash's bit."""
    places = F.array(*(F.pmod(F.xxhash64(F.lit(s), F.col(key), F.coalesce("event_type", F.lit("\0"))), F.lit(bits)) + 1 for s in SEEDS))
    return rows.withColumn("h", F.explode(places)).withColumns({"slice": F.bitmap_bucket_number("h"), "place": F.bitmap_bit_position("h")}).drop("h")


def _is_set(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def suspects(once: DataFrame, filters: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """event_id of those events all of whose bits are set: maybe in the log already."""
    asked = _marks(once.select(key, "event_type", "event_id"), key, bits)
    slices = small_side(asked.select("slice").distinct(), 20_000)
    held = filters.join(slices, "slice", "left_semi").groupBy("slice").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    found = asked.join(held, "slice").where(_is_set(F.col("bitmap"), F.col("place")))
    return found.groupBy("event_id").agg(F.count("*").alias("n")).where(F.col("n") == len(SEEDS)).select("event_id")


def append(fresh: DataFrame, folder: str, key: str, repeatable: tuple = (), buckets: int = ONCE_BUCKETS, bits: int = BITS) -> tuple[int, int]:
    """Appends fresh(key, ts, event_id, event_type, ...) by the law above; returns (buckets read, buckets there are).

    Of fresh events of one key and kind the first by time and id counts. buckets and bits are the log's own and the
    same for each append (about ten bits for each key and kind that the log will hold).
    """
    spark = fresh.sparkSession
    rows = fresh.withColumn("bucket", F.when(_repeats(repeatable), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int"))
    many = rows.where("bucket = -1")
    first = rows.where("bucket >= 0").groupBy(key, "event_type").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    once = rows.where("bucket >= 0").join(first.select("event_id"), "event_id", "left_semi").dropDuplicates(["event_id"])
    read = there = 0
    if exists(spark, f"{folder}/filters"):
        log = spark.read.parquet(f"{folder}/log")
        maybe = once.join(suspects(once, spark.read.parquet(f"{folder}/filters"), key, bits), "event_id", "left_semi")
        there = log.where("bucket >= 0").select("bucket").distinct().count()
        ask = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # at most `buckets` numbers
        read = len(ask)
        kept = log.where(F.col("bucket").isin(ask)).select(F.col(key).alias("seen key"), F.col("event_type").alias("seen type"))
        known = maybe.join(kept, F.col(key).eqNullSafe(F.col("seen key")) & F.col("event_type").eqNullSafe(F.col("seen type")), "left_semi").select("event_id")
        once = once.join(known, "event_id", "left_anti")
    new = _marks(once.select(key, "event_type"), key, bits).groupBy("slice").agg(F.bitmap_construct_agg("place").alias("bitmap"))
    new.write.mode("append").parquet(f"{folder}/filters")
    once.unionByName(many).write.mode("append").partitionBy("bucket").parquet(f"{folder}/log")
    return read, there
