"""Session settings, and shipping the package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent

#: What a session for this library sets; sizes of partitions and memory belong to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("tidewell").config(map=DEFAULTS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package's modules (once for a context), so that Python workers can import them."""
    context = spark.sparkContext
    if getattr(context, "_tidewell_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="tidewell-py-")) / "tidewell_py.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    context.addPyFile(str(target))
    context._tidewell_shipped = True
