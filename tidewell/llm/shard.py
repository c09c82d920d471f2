"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Only DataFrame functions. Global row numbers come from counts: equal rows (id, size, checksum) are one group with a
count, combined before the shuffle; groups fall into BUCKETS hash buckets; the counts of the buckets give each
bucket's first number, and a group's numbers follow those of the smaller groups in its bucket. The table of buckets
has BUCKETS rows whatever the input, so it is broadcast; only ids and two numbers are shuffled, never texts. So
neither a null or repeated id nor a row with very many copies lands in one task: groups of more than RUN rows are
dealt out in runs.

The numbers 0 to N-1 lie in a grid of a x b cells, a = ceil(sqrt(N)), b = ceil(N / a). A Feistel network of ROUNDS
rounds that alternate between the two coordinates permutes the grid; a number that leaves 0 to N-1 is permuted again
(cycle walking) until it is back. Fewer than a cells lie outside, so a walk is rarely needed. Position p goes to
shard p mod n, slot p div n: counts differ by one at most and slots have no gaps. Anyone can compute where row g is
from (g, N, seed) alone.

Null texts have size 1 and checksum 0, very long ones are read where they stand; null ids are numbered like any
other; repeated rows get numbers of their own (they are interchangeable). An empty table gives an empty table; further
columns are dropped, and the id column may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BUCKETS = 4096
#: Rows of a group that one task writes out at a time.
RUN = 65_536
ROUNDS = 6
SEED = 20240229
#: Steps of a walk in one expression. Walks are shorter than a, so up to N = 4225 none can be longer; above that a
#: longer one has a probability below 1e-100, and would raise an error rather than misplace a row.
WALK = 64


def feistel(x: Column, a: Column, b: Column, seed: int = SEED) -> Column:
    """One pass of the network over the grid of a x b cells."""
    right = x % b
    left = ((x - right) / b).cast("long")
    for k in range(ROUNDS):
        if k % 2:
            right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed + k), left), b), b)
        else:
            left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed + k), right), a), a)
    return left * b + right


def permuted(x: Column, n: Column, a: Column, b: Column, seed: int = SEED) -> Column:
    """x in 0..n-1 to its place, by walking cycles until the place is below n."""
    step = lambda p: F.when(p < n, p).otherwise(feistel(p, a, b, seed))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(x, a, b, seed), lambda p, _: step(p))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def number_rows(rows: DataFrame) -> DataFrame:
    """rows(id, size, crc) plus g (global row number from 0) and n (rows in all)."""
    groups = rows.groupBy("id", "size", "crc").agg(F.count("*").alias("c")).withColumn("bucket", F.pmod(F.xxhash64("id", "crc", "size"), F.lit(BUCKETS)))
    counts = groups.groupBy("bucket").agg(F.sum("c").alias("c"))
    w = Window.orderBy("bucket")
    starts = counts.select("bucket", (F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("start"), F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    before = F.sum("c").over(Window.partitionBy("bucket").orderBy("id", "crc", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    first = groups.withColumn("before", before).join(F.broadcast(starts), "bucket").select("id", "size", "crc", "c", "n", (F.col("start") + F.col("before")).alias("g"))
    runs = first.where(F.col("c") > RUN).select("id", "size", "crc", "n", "g", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(RUN).cast("long"))).alias("from"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(tasks, "g", "from").select("id", "size", "crc", "n", (F.col("g") + F.col("from")).alias("g"), F.least(F.col("c") - F.col("from"), F.lit(RUN)).alias("c"))
    each = first.where(F.col("c") <= RUN).select("id", "size", "crc", "n", "g", "c").unionByName(runs)
    return each.select("id", "size", "crc", "n", F.explode(F.sequence(F.col("g"), F.col("g") + F.col("c") - 1)).alias("g"))


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id, size, text_crc32, g, shard, slot) of each row."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = number_rows(docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("crc")))
    a = F.ceil(F.sqrt(F.col("n"))).cast("long")
    grid = rows.withColumn("a", a).withColumn("b", F.ceil(F.col("n") / F.col("a")).cast("long"))
    placed = grid.select("*", permuted(F.col("g"), F.col("n"), F.col("a"), F.col("b"), seed).alias("place"))
    shard = F.pmod("place", F.lit(shards))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "g", shard.cast("int").alias("shard"), ((F.col("place") - shard) / shards).cast("long").alias("slot"))


def op4_shard(spark, sf_dir):
    out = shard_rows(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
