"""Driver tables, and the governed view of documents that retrieval works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import split_blank

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def governed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with owner, classification (toxic 1: RESTRICTED, 0: PUBLIC, unlabelled: null), deletion, title, time, digest."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(
        "doc_id", "text", "lang",
        F.col("source").alias("owner_id"),
        F.when(F.col("toxic") == 1, "RESTRICTED").when(F.col("toxic") == 0, "PUBLIC").alias("classification"),
        F.when(F.col("doc_id") % 17 == 0, F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))).alias("deleted_at"),
        F.array_join(F.slice(split_blank(F.col("text")), 1, 6), " ").alias("title"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("created_at"),
        F.sha2("text", 256).alias("sha256"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions: each asks for its own words, as a viewer who owns one source."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(
        F.col("item_id").alias("question_id"),
        F.array_join(split_blank(F.col("text")), " ").alias("question"),
        F.concat(F.lit("src"), F.pmod("item_id", F.lit(20)).cast("string")).alias("viewer_id"),
        (F.col("item_id") % 10 == 0).alias("is_admin"),
    )
