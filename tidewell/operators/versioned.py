"""A table of rows by key, in buckets, that replaces keys without rewriting the rest and never shows half a change.

Rows are in buckets by a hash of the key; each version is a manifest, a small file that names the folder of every
bucket. A replacement writes the buckets of its keys into a new folder, and only then a manifest that names them
beside the others' old folders. Readers take the newest manifest: they see all of a version or nothing of it, and a
run that fails on the way leaves files that no manifest names. Two writers of one version: the second fails, since a
manifest is never written over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.joins import small_side

BUCKETS = 64


class VersionedTable:
    """The table below a folder, by key. Null keys are a key of their own. The schema is that of the first version."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ manifests

    def versions(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise ValueError(f"no version at {self.folder}")
        rows = self.spark.read.text(f"{self.folder}/manifests/{known[-1] if version is None else version:012d}.json", wholetext=True)
        return json.loads(rows.first()[0])

    def _commit(self, version: int, manifest: dict) -> int:
        """Writes the manifest under a name of its own and gives it the version's name, which must be free."""
        draft = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._path(f"{self.folder}/manifests/{version:012d}.json")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.folder} has been written by another run")
        return version

    # ------------------------------------------------------------ rows

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _write(self, rows: DataFrame, n: int) -> str:
        to = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket(n)).repartition("bucket").write.partitionBy("bucket").parquet(to)
        return to

    def _folders(self, to: str) -> dict[str, str]:
        """bucket -> folder of what _write has written."""
        return {f.getPath().getName().removeprefix("bucket="): f"{to}/{f.getPath().getName()}" for f in self._fs.listStatus(self._path(to)) if f.isDirectory() and f.getPath().getName().startswith("bucket=")}

    def create(self, rows: DataFrame, buckets: int = BUCKETS) -> int:
        to = self._write(rows, buckets)
        return self._commit(1, {"buckets": buckets, "schema": rows.schema.json(), "folders": self._folders(to)})

    def _of(self, manifest: dict, wanted: set[str] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [p for b, p in sorted(manifest["folders"].items()) if wanted is None or b in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest if none is named."""
        return self._of(self.manifest(version))

    def replace(self, fresh: DataFrame, gone: DataFrame | None = None) -> int:
        """A new version where the keys of fresh (and those of gone) have the rows of fresh alone. Other buckets stay as they are."""
        version = self.versions()[-1]
        old = self.manifest(version)
        keys = fresh.select(self.key) if gone is None else fresh.select(self.key).unionByName(gone.select(self.key))
        keys = keys.distinct()
        touched = {str(r[0]) for r in keys.select(self._bucket(old["buckets"])).distinct().collect()}  # at most the number of buckets
        if not touched:
            return version
        before, named = self._of(old, touched), small_side(keys.select(F.col(self.key).alias("replaced key")))
        kept = before.join(named, before[self.key].eqNullSafe(F.col("replaced key")), "left_anti")
        to = self._write(kept.unionByName(fresh.select(*kept.columns)), old["buckets"])
        folders = {b: p for b, p in old["folders"].items() if b not in touched} | self._folders(to)
        return self._commit(version + 1, old | {"folders": folders})
