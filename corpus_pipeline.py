"""A training corpus from `documents`: quality, near duplicates, benchmark passages, secrets, tokens.

STAGES are (name, function) in their order; each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of docs.

A row with a null text counts as empty throughout. Each row is a document of its own, whether its doc_id is null or repeated.
Further columns of docs pass through; a struct keeps them apart from what an operator adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, decontaminate, quality, secrets, simhash
from tidewell.llm.common import cut, table
from tidewell.session import ship_package


def _beside(docs: DataFrame) -> DataFrame:
    """docs as (doc: all columns, text)."""
    return docs.select(F.struct("*").alias("doc"), "text")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above; it is trained on the labelled rows of sf_dir.

    Null and empty texts get the score of the bias; repeated rows are scored each; without labels every document stays;
    an empty table gives an empty table.
    """
    weights = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score_texts(_beside(docs), weights).where(F.col("score") >= quality.THRESHOLD).select("doc.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id (nulls last; of equal ones, any one row).

    Rows get a key of their own, written once with them, so that null and repeated ids neither lose nor join documents.
    """
    rows = cut(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "pipeline-rows")
    order = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), "row")
    groups = cut(simhash.near_duplicates(rows.select(order.alias("id"), "doc.text"), "id"), "pipeline-groups")
    first = groups.where("id.row = component.row").select("id.row")
    return rows.join(first, "row", "left_semi").select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, or with fewer than one word in twenty inside them.

    Null and empty texts and texts without words stay; repeated rows are judged each; an empty benchmark drops nothing.
    """
    found = decontaminate.match_items(_beside(docs), table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated(decontaminate.hits(), F.col("n_words"))).select("doc.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by <SECRET>; n_chars follows where there is such a column.

    Texts without secrets, null and empty ones among them, and their n_chars stay as they are; repeated rows are
    masked each.
    """
    found = secrets.scan_secrets(_beside(docs)).select("doc.*", F.col("redacted").alias("redacted text"), F.col("spans").alias("secret spans"))
    changed = F.col("secret spans") != ""
    new = {"text": F.when(changed, F.col("redacted text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("redacted text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and the digests of ids and decoded text, a row for each document.

    Null and empty texts have no tokens; null and repeated ids stay rows of their own.
    """
    return bpe.encode_texts(docs.select("doc_id", "source", "text"), bpe.default_vocabulary())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", to_tokens),
]

#: The stages' classifier, fingerprints and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name}")
    return docs
