"""Redaction of identifiers across the passages of one request, and the boundary record."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.identifiers import find_identifiers, preview
from tidewell.operators.access import sendable, tier_rank

FINDINGS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("value", T.StringType())]))


def find_all(df: DataFrame, text: str = "text") -> DataFrame:
    """df plus findings (a column of that name is replaced): offsets need a matcher, so this one step runs in Arrow batches."""
    kept = [f for f in df.schema.fields if f.name != "findings"]
    out = T.StructType([*kept, T.StructField("findings", FINDINGS)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": s, "end": e, "label": k, "value": v} for s, e, k, v in find_identifiers(t)] for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), pa.array(found, kind)], out.names)

    return df.mapInArrow(run, out)


def redact(passages: DataFrame, request: str, place: str, text: str = "text") -> DataFrame:
    """passages (one row each, numbered by place within a request) plus findings and redacted.

    Placeholders are numbered per request and label in the order in which values are first met: passages in order,
    within a passage from its end to its start. The numbering ranks distinct values; each finding then looks up its
    value's number by a join, so a request of any size never becomes one map or one row. Equal rows are redacted
    alike; null keys are keys like any other.
    """
    found = find_all(passages.withColumn("row key", F.md5(F.coalesce(F.col(text), F.lit("")))), text)
    values = found.select(request, place, "row key", F.explode("findings").alias("f")).select(request, place, "row key", "f.*")
    met = F.struct(F.col(place).alias("p"), (-F.col("start")).alias("s"))
    first = values.groupBy(request, "label", "value").agg(F.min(met).alias("met"))
    number = F.row_number().over(Window.partitionBy(request, "label").orderBy("met", "value"))
    numbered = first.select(F.col(request).alias("of"), F.col("label").alias("kind"), F.col("value").alias("what"), F.concat(F.lit("<"), "label", F.lit("_"), number.cast("string"), F.lit(">")).alias("mark"))
    named = values.join(numbered, F.col(request).eqNullSafe(F.col("of")) & (F.col("label") == F.col("kind")) & (F.col("value") == F.col("what")))
    marks = named.groupBy(F.col(request).alias("of"), F.col(place).alias("at"), F.col("row key").alias("key")).agg(F.collect_set(F.struct("start", "end", "mark")).alias("marks"))
    joined = found.join(marks, F.col(request).eqNullSafe(F.col("of")) & F.col(place).eqNullSafe(F.col("at")) & (F.col("row key") == F.col("key")), "left")
    kept = [c for c in passages.columns if c not in ("findings", "redacted")]
    return _spliced(joined.select(*kept, "findings", F.array_sort("marks").alias("marks"), F.col(text).alias("redacted")))


def _spliced(df: DataFrame) -> DataFrame:
    """df with marks written over their places in the column redacted, each text in one pass."""
    out = T.StructType([f for f in df.schema.fields if f.name != "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for t, marks in zip(b.column("redacted").to_pylist(), b.column("marks").to_pylist(), strict=True):
                parts, at = [], 0
                for m in marks or ():
                    parts += [t[at : m["start"]], m["mark"]]
                    at = m["end"]
                new.append("".join(parts) + t[at:] if marks else t)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in out.names[:-1]), pa.array(new, pa.string())], out.names)

    return df.mapInArrow(run, out)


def masked_values(redacted: DataFrame, request: str) -> DataFrame:
    """(request, label, values, previews): distinct values of each label."""
    rows = redacted.select(request, F.explode("findings").alias("f")).select(request, "f.label", "f.value").distinct()
    return rows.groupBy(request, "label").agg(F.count("*").alias("values"), F.array_sort(F.collect_list(preview(F.col("value")))).alias("previews"))


def boundary_record(passages: DataFrame, request: str, allow_restricted: bool = False, expected: str | None = None) -> DataFrame:
    """Per request: passages considered, sent and withheld, the tier of those sent, and whether it was refused.

    Only PUBLIC passages are sent unless the setting allows the others too; the tier of what is sent is the strictest
    in it, unknown tiers counting as RESTRICTED. A request is refused where nothing is left to send, or where the
    column `expected` names another number of passages than there are.
    """
    sent = F.lit(True) if allow_restricted else sendable(F.col("classification"))
    wrong = F.max(F.col(expected)) if expected else F.lit(None).cast("long")
    out = passages.groupBy(request).agg(
        F.count("*").alias("considered"), F.count_if(sent).alias("sent"), F.count_if(~sent).alias("withheld"),
        F.max(F.when(sent, tier_rank(F.col("classification")))).alias("rank"), wrong.alias("expected"),
    )
    tier = F.when(F.coalesce("rank", F.lit(0)) == 0, "PUBLIC").otherwise("RESTRICTED")
    refused = (F.col("sent") == 0) | F.coalesce(F.col("expected") != F.col("considered"), F.lit(False))
    return out.select(request, "considered", "sent", "withheld", tier.alias("tier"), refused.alias("refused"))


def masked_record(redacted: DataFrame, request: str) -> DataFrame:
    """(request, masked): the labels of each request with how many distinct values they masked and their partials, most first, then by label."""
    per = masked_values(redacted, request)
    entry = F.struct((-F.col("values")).alias("order"), "label", "values", "previews")
    lists = per.groupBy(request).agg(F.array_sort(F.collect_list(entry)).alias("m"))
    return lists.select(request, F.transform("m", lambda m: F.struct(m["label"].alias("label"), m["values"].alias("count"), m["previews"].alias("previews"))).alias("masked"))
