"""What the training-data operators share: tables, cut points, hashing, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.sources.shared import shared_folder

#: Rows that are turned into Python objects at a time. Spark bounds Arrow batches by bytes; no session setting is touched.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, SLICE_ROWS at a time."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


def map_texts(df: DataFrame, fn: Callable[[list], list], schema: str, text: str = "text") -> DataFrame:
    """Replace the column text by what fn makes of each batch of texts: one list or array for each field of schema.

    The other columns pass as they are (Arrow arrays, so nulls and large ids stay exact). One scan, no shuffle;
    a task holds one Arrow batch (bounded by bytes) and SLICE_ROWS rows as objects. A column that has the name of a
    new one is replaced by it.
    """
    new = T.StructType.fromDDL(schema)
    kept = [f for f in df.schema.fields if f.name != text and f.name not in new.names]
    out = T.StructType(kept + new.fields)
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in new.fields]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = fn(b.column(b.schema.get_field_index(text)).to_pylist())
            arrays = [b.column(b.schema.get_field_index(n)) for n in names]
            arrays += [pa.array(v, kind) for v, (_, kind) in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names + [n for n, _ in arrow])

    return df.mapInArrow(run, out)


def packed(docs: DataFrame, *apart: str) -> DataFrame:
    """docs as the columns `apart` and a struct `doc` of all others, so that an operator's own columns cannot clash with them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in apart] or [F.lit(0).alias("none")]
    return docs.select(F.struct(*others).alias("doc"), *(F.col(f"`{c}`") for c in apart))


def unpacked(df: DataFrame, *new: str) -> DataFrame:
    """The columns of `doc` and the new ones; where names clash, the new one stays."""
    old = [f.name for f in df.schema["doc"].dataType.fields if f.name not in new and f.name != "none"]
    return df.select(*(F.col(f"doc.`{c}`") for c in old), *new)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewell-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, label: str = "links") -> DataFrame:
    """Connected components of edges(a, b) by alternating large and small stars; returns (node, root), root < node.

    A node that is its component's smallest is not listed. Each round is two groupings by node (minima, combined
    before the shuffle) and two joins, so a node with very many links is split by adaptive skew joins. Rounds end
    when the set of links no longer changes; their number grows with the logarithm of the longest path.
    Nulls and loops are ignored; repeated links count once; an empty table gives an empty table.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = cut(links, label)
    seen = _signature(links)
    while seen[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), label)
        now = _signature(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _signature(links: DataFrame) -> tuple:
    """Row count and two order-free digests of a set of links."""
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())
