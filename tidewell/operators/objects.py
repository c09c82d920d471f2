"""Stored objects by key: put, copied, deleted and listed in a folder that driver and executors share.

Each call is one pass over a table of keys, and each task works on its own keys, so a call is as wide as its table. A
call that is tried again does no harm: an object is written beside its place and then moved to it, a copy replaces its
target, and what is gone already stays gone. Keys are file names; objects lie in folders by the end of a hash of theirs. Null
keys are left out. Workers open the folder by pyarrow: file, s3, gs or hdfs addresses.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


FOLDERS = 256


def _place(root: str, key: str) -> str:
    return f"{root}/{zlib.crc32(key.encode()) % FOLDERS:02x}/{key}"


def _each(rows: DataFrame, folder: str, do: Callable) -> int:
    """Calls do(files, root, *row) for every row; how many did something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(folder)
        for b in batches:
            done = sum(bool(do(files, root, *row)) for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["done"])

    return rows.mapInArrow(run, "done long").agg(F.coalesce(F.sum("done"), F.lit(0))).first()[0]


def _write(files, root: str, key: str, content: bytes) -> bool:
    place, draft = _place(root, key), f"{root}/drafts/{uuid.uuid4().hex}"
    files.create_dir(f"{root}/drafts", recursive=True)
    files.create_dir(place.rpartition("/")[0], recursive=True)
    with files.open_output_stream(draft) as out:
        out.write(content)
    files.move(draft, place)
    return True


def _read(files, root: str, key: str) -> bytes | None:
    if files.get_file_info(_place(root, key)).type != pa.fs.FileType.File:
        return None
    with files.open_input_stream(_place(root, key)) as f:
        return f.read()


def put_objects(objects: DataFrame, folder: str) -> int:
    """Stores objects(key, content); a key that is there is replaced, of equal keys in one table any one stays."""
    return _each(objects.where("key is not null and content is not null").select("key", "content"), folder, _write)


def copy_objects(pairs: DataFrame, folder: str) -> int:
    """Copies pairs(source, target); sources that are not there copy nothing."""

    def copy(files, root, source, target):
        content = _read(files, root, source)
        return content is not None and _write(files, root, target, content)

    return _each(pairs.where("source is not null and target is not null").select("source", "target"), folder, copy)


def delete_objects(keys: DataFrame, folder: str) -> int:
    """Deletes keys(key); what is not there is deleted already."""

    def delete(files, root, key):
        try:
            files.delete_file(_place(root, key))
        except FileNotFoundError:
            return False
        return True

    return _each(keys.where("key is not null").select("key"), folder, delete)


def list_objects(spark: SparkSession, folder: str) -> DataFrame:
    """(key, length) of what is stored, empty objects too; each of the FOLDERS is listed by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(folder)
        for b in batches:
            for n in b.column(0).to_pylist():
                found = [f for f in files.get_file_info(pa.fs.FileSelector(f"{root}/{n:02x}", allow_not_found=True)) if f.type == pa.fs.FileType.File]
                yield pa.RecordBatch.from_arrays([pa.array([f.base_name for f in found], pa.string()), pa.array([f.size for f in found], pa.int64())], ["key", "length"])

    return spark.range(0, FOLDERS, 1, 16).mapInArrow(run, "key string, length long")
