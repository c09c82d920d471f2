"""A paged listing as a source, for batches and for streams: spark.read.format("paged_listing"), spark.readStream.format(...).

A listing is a folder with a folder of Parquet files for each page (page=0, page=1, ...) and markers of how far it has
been listed; pages without a marker at or after them are still being written and are not read. Each page is a
partition of its own, so a listing is read by as many tasks as it has pages. A stream's offset is the next page, kept
in its checkpoint: a run that is started again goes on where the last one ended, and a failed batch reads the same
pages again. Workers open the folder by pyarrow: file, s3, gs or hdfs addresses.

Columns are those of the reader's schema, by name; ones that a page has not are null. An empty listing has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "paged_listing"


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Listing:
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder = schema, options["path"].rstrip("/")

    def listed(self) -> int:
        """How many pages there are."""
        files, at = pa.fs.FileSystem.from_uri(self.folder)
        marks = files.get_file_info(pa.fs.FileSelector(f"{at}/listed", allow_not_found=True))
        return max((int(m.base_name.removeprefix("upto=")) for m in marks if m.base_name.startswith("upto=")), default=0)

    def rows(self, page: Page | None) -> Iterator[pa.RecordBatch]:
        if page is None:  # what Spark reads where there are no partitions
            return
        files, at = pa.fs.FileSystem.from_uri(self.folder)
        at = f"{at}/page={page.number}"
        if files.get_file_info(at).type == pa.fs.FileType.NotFound:
            return
        shape = to_arrow_schema(self.schema)
        for b in pa.dataset.dataset(at, schema=shape, filesystem=files, format="parquet").to_batches():
            yield b


class _Reader(_Listing, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(n) for n in range(self.listed())]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class _StreamReader(_Listing, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self, *_) -> dict:
        return {"page": self.listed()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(n) for n in range(start["page"], end["page"])]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        raise ValueError("a paged listing needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, self.options)


def write_pages(rows: DataFrame, folder: str, page: Column, upto: int) -> None:
    """Adds rows as pages (those without a page to page 0), and then a marker that pages below `upto` are there."""
    rows.withColumn("page", F.coalesce(page, F.lit(0))).repartition("page").write.mode("append").partitionBy("page").parquet(folder)
    rows.sparkSession.createDataFrame([(upto, True)], "upto long, there boolean").write.mode("append").partitionBy("upto").parquet(f"{folder}/listed")


def read_listing(spark: SparkSession, folder: str, columns: str, stream: bool = False) -> DataFrame:
    """The listing with these columns (DDL), as a table or a stream."""
    spark.dataSource.register(PagedListing)
    source = spark.readStream if stream else spark.read
    return source.format(FORMAT).schema(columns).load(folder)
