"""The folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir of the session.

    Where that is unset, a folder made for the session if Spark runs in this process (tests); on a cluster an error,
    since each machine would write to a disk of its own.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidewell.scratch", None)
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = f"file://{tempfile.mkdtemp(prefix='tidewell-')}"
        spark.conf.set("tidewell.scratch", known)
    return f"{known.rstrip('/')}/tidewell-{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> None:
    """Deletes all that this application has written into its shared folder; results that still read it are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: what several branches of a plan need is computed once."""
    path = f"{shared_folder(df.sparkSession)}/tidewell-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def borrowed(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """stored(), for the length of a block: what was written is deleted after it."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/tidewell-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
