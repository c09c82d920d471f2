"""BM25 with early stopping: the best passages of each question without summing every pair of a question and a passage.

A posting is (term, key, columns that permissions need, impact); its impact is the BM25 weight of the term in the
passage, summed over the passage's fields. A passage's score is the sum of its impacts for a question's terms.

best() walks in three rounds, each a few joins on terms:

1. Heads. The HEAD largest impacts of every term give partial sums; the pool-th largest of a question is a score that
   the pool reaches at least.
2. Essential terms. Terms are put in order of their largest impact. Passages that hold only the first of them, as many
   as together stay below that score, cannot be in the pool: these terms find no candidates. Of the other terms' blocks
   only those are read whose bound, with the largest impacts of all other terms, can reach the score. Sums over them
   raise the score; candidates that cannot reach it with all other terms are out.
3. Completion. What is left looks up its impacts for the other terms, block by block: a posting's block follows from
   the passage's key, so only blocks that a candidate falls into are read.

Common words, which hold most postings, are in the third round for nearly every question. Permissions, deletion and
scope hold before a sum is made. Sums are compared with a margin, so rounding loses nothing; scores are rounded to 9
places and ties go to the smaller key.

The walk reads an index (write_blocks). For one batch of questions without one, best_of_texts() gives the same rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewell.functions.joins import small_side
from tidewell.functions.text import lexical_question, terms
from tidewell.sources.shared import borrowed, stored

# Parameters of the ranking.
BM25_K1, BM25_B = 1.2, 0.75
FIELDS = ("text", "title")
PERMISSION = ("classification", "owner_id", "deleted_at")
HEAD = 64
#: Sums that differ by less may differ by rounding alone.
MARGIN = 1e-6
#: Impacts of a term are in so many layers, and postings of a layer in blocks of about so many.
LAYERS, BLOCK = 4, 128
#: Folders of an index by a hash of the term, and postings that one of its files holds at most, about.
TERM_BUCKETS, FILE_POSTINGS = 64, 2_000_000
#: Postings of a term beyond which it is divided, terms of a segment, and postings that a task writes at a time, about.
HOT, SEGMENT_TERMS, OUT_POSTINGS = 500_000, 4_000_000, 200_000


def top(df: DataFrame, per: str, order: list[Column], k: int, name: str) -> DataFrame:
    """The first k rows of each group, with their place."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col(name) <= k)


def question_terms(asked: DataFrame) -> DataFrame:
    """(question_id, term) of the trimmed questions."""
    return asked.select("question_id", F.explode(F.array_distinct(terms(lexical_question(F.col("question"))))).alias("term"))


# ---------------------------------------------------------------- postings


def counted_terms(docs: DataFrame, key: list[str], fields: tuple, vocabulary: DataFrame | None = None) -> DataFrame:
    """(field, key, permission columns, term, dl, tf), and a row of the term '' for each field of each document.

    Each text is taken to terms once. vocabulary(term): other terms leave before anything is shuffled.
    (explode_outer: with explode, Spark infers a filter on the array's size and splits every text twice.)
    """
    whole = docs.select(F.struct(*key).alias("key"), *PERMISSION, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("ts")) for f in fields))).alias("f"))
    rows = whole.select("key", *PERMISSION, "f.field", F.size("f.ts").alias("dl"), F.explode_outer(F.array_append("f.ts", F.lit(""))).alias("term"))
    if vocabulary is not None:
        none = docs.sparkSession.createDataFrame([("",)], "term string")
        rows = rows.join(small_side(vocabulary.select("term").unionByName(none).distinct()), "term", "left_semi")
    return rows.groupBy("field", "key", *PERMISSION, "term", "dl").agg(F.count("*").alias("tf"))


def weighed(counted: DataFrame) -> DataFrame:
    """Postings (term, key, permission columns, impact) from counted_terms(), written."""
    figures = counted.where("term = ''").groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    tf = counted.where("term <> ''")
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("mean")))
    rows = tf.join(df, ["field", "term"]).join(F.broadcast(figures), "field")
    return rows.groupBy("term", "key", *PERMISSION).agg(F.sum(idf * weight).alias("impact"))


def best_of_texts(wanted: DataFrame, docs: DataFrame, key: list[str], pool: int, may: Column, scope: DataFrame | None = None, fields: tuple = FIELDS) -> DataFrame:
    """What best() gives, for one batch of questions without an index: their terms' postings are made from the texts and summed, none left out.

    The texts are read once and only postings of asked terms are kept, so there is no block that a walk could spare.
    """
    counted = stored(counted_terms(docs, key, fields, wanted.select("term").distinct()), "terms")
    scores = summed(weighed(counted), wanted, may, scope).withColumn("score", F.round("s", 9))
    return top(scores.drop("s"), "question_id", [F.col("score").desc(), F.col("key")], pool, "place")


def summed(rows: DataFrame, some: DataFrame, may: Column, scope: DataFrame | None, indexed: bool = False) -> DataFrame:
    """(question_id, key, s): the sums of the postings that count, for questions' terms.

    indexed: postings go to their key's task before they meet the questions, once instead of once for each question.
    """
    few = small_side(some)
    if indexed and few is not some:
        rows = rows.repartition("key")
    out = rows.join(few, "term").where(may).select("question_id", "key", "impact")
    out = out if scope is None else out.join(scope.select("question_id", "key").distinct(), ["question_id", "key"], "left_semi")
    return out.groupBy("question_id", "key").agg(F.sum("impact").alias("s"))


def field_rows(docs: DataFrame, key: list[str], fields: tuple) -> DataFrame:
    """(key, permission columns, h, fields: (field, dl, ts)), a row for each key and permissions; dl is null where it is the number of ts.

    h: a hash of the key. Rows that repeat a key are put together as counted_terms() does; others are not shuffled.
    """
    entry = "array<struct<field:int,dl:int,ts:array<string>>>"
    listed = F.array(*(F.struct(F.lit(k).alias("field"), F.lit(None).cast("int").alias("dl"), terms(F.col(f)).alias("ts")) for k, f in enumerate(fields))).cast(entry)
    rows = docs.select(F.struct(*key).alias("key"), *PERMISSION, hash_of(F.struct(*key)).alias("h"), listed.alias("fields"))
    again = stored(docs.select(F.struct(*key).alias("again")).groupBy("again").count().where("count > 1").select("again"), "again")
    if again.isEmpty():
        return rows
    again = small_side(again)
    lone = rows.join(again, F.col("key").eqNullSafe(F.col("again")), "left_anti")
    parts = rows.join(again, F.col("key").eqNullSafe(F.col("again")), "left_semi").select("key", *PERMISSION, "h", F.explode("fields").alias("f"))
    parts = parts.groupBy("key", *PERMISSION, "h", "f.field", F.size("f.ts").alias("dl")).agg(F.flatten(F.collect_list("f.ts")).alias("ts"))
    return lone.unionByName(parts.groupBy("key", *PERMISSION, "h").agg(F.collect_list(F.struct("field", "dl", "ts")).cast(entry).alias("fields")))


SEGMENTS = "g int, payload binary"


def _segments(buckets: int, spread: int, hot: dict[str, int]):
    """field_rows() -> SEGMENTS: postings of some documents, sorted by term, one row for each group of terms; with the entries and documents that they name."""

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Slices of about SEGMENT_TERMS terms."""
        ends = np.cumsum(pc.list_value_length(pc.list_flatten(b.column("fields")).field("ts")).to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], ends])[np.cumsum(b.column("fields").value_lengths().to_numpy())]
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SEGMENT_TERMS, "right")))
            yield b.slice(at, stop - at)
            at = stop

    def segment(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        listed = b.column("fields")
        edoc = np.repeat(np.arange(b.num_rows, dtype=np.int32), listed.value_lengths().to_numpy())
        field, dl, ts = listed.flatten().flatten()
        lens = ts.value_lengths().to_numpy()
        dl = np.where(dl.is_null().to_numpy(zero_copy_only=False), lens, dl.fill_null(0).to_numpy()).astype(np.int32)
        known = ts.flatten().dictionary_encode()
        words = known.dictionary.to_pylist()
        if not words:
            return
        u, tf = np.unique(np.repeat(np.arange(len(lens), dtype=np.int64), lens) * len(words) + known.indices.to_numpy(), return_counts=True)
        e, c = (u // len(words)).astype(np.int32), (u % len(words)).astype(np.int32)
        crc = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.int64)
        salts = np.array([hot.get(w, 1) for w in words], np.int64)
        salt = salt_of(b.column("h").to_numpy().astype(np.int64)[edoc[e]], salts[c])
        g = (crc % buckets * spread)[c] + ((crc // buckets)[c] + salt) % spread
        rank = np.empty(len(words), np.int32)
        rank[pc.sort_indices(known.dictionary).to_numpy()] = np.arange(len(words), dtype=np.int32)
        order = np.lexsort((e, rank[c], g))
        e, c, tf, g = e[order], c[order], tf[order].astype(np.int32), g[order]
        docs = pa.StructArray.from_arrays([b.column(n) for n in ("key", *PERMISSION, "h")], names=["key", *PERMISSION, "h"])
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        for at, stop in zip(starts, [*starts[1:], len(g)], strict=True):
            own, place = np.unique(e[at:stop], return_inverse=True)
            held, of = np.unique(edoc[own], return_inverse=True)
            first = np.flatnonzero(np.concatenate([[True], c[at + 1 : stop] != c[at : stop - 1]]))
            columns = {"terms": known.dictionary.take(pa.array(c[at:stop][first])), "counts": np.diff(np.append(first, stop - at)).astype(np.int32), "entry": place.astype(np.int32), "tf": tf[at:stop]}
            columns |= {"doc": of.astype(np.int32), "field": field.to_numpy()[own].astype(np.int8), "dl": dl[own], "docs": docs.take(pa.array(held))}
            made = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(v)], v if isinstance(v, pa.Array) else pa.array(v)) for v in columns.values()], names=list(columns))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, made.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(made)
            yield pa.RecordBatch.from_arrays([pa.array([g[at]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["g", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in cut(b):
                yield from segment(some)

    return run


def _blocks(buckets: int, spread: int, hot: dict[str, int], hot_df: dict[str, list[int]], figures: list[tuple[int, float]], head: int, layers: int, block: int, out: pa.Schema):
    """SEGMENTS sorted by g -> blocks and heads of each group of terms."""
    width, n, mean = len(figures), np.array([x for x, _ in figures], float), np.array([x for _, x in figures], float)

    def group(g: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        made = [pa.ipc.open_stream(p).read_next_batch() for p in payloads]
        flat = lambda name: [m.column(name).flatten() for m in made]
        join = lambda name: np.concatenate([x.to_numpy() for x in flat(name)])
        shifted = lambda name, by: np.concatenate([x.to_numpy() + k for x, k in zip(flat(name), np.concatenate([[0], np.cumsum([len(y) for y in flat(by)])]).astype(np.int64), strict=False)])
        known = pa.concat_arrays(flat("terms")).dictionary_encode()
        t = np.repeat(known.indices.to_numpy().astype(np.int64), join("counts"))
        e, doc = shifted("entry", "doc"), shifted("doc", "docs")
        docs, field, dl, tf, words = pa.concat_arrays(flat("docs")), join("field").astype(np.int64), join("dl"), join("tf"), known.dictionary.to_pylist()
        df = np.bincount(t * width + field[e], minlength=width * len(words)).reshape(-1, width).astype(float)
        for k, w in enumerate(words):
            if w in hot_df:
                df[k] = hot_df[w]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        value = idf[t, field[e]] * (tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl[e] / mean[field[e]])))
        salts = np.array([hot.get(w, 1) for w in words], np.int64)
        h = docs.field("h").to_numpy().astype(np.int64)
        of = doc[e]
        order = np.lexsort((of, salt_of(h[of], salts[t]), t))
        t, of, value = t[order], of[order], value[order]
        first = starts(t, of)
        t, of, impact = t[first], of[first], np.add.reduceat(value, first)
        salt = salt_of(h[of], salts[t])
        own = starts(t, salt)
        size = np.diff(np.append(own, len(t)))
        top, many = np.repeat(np.maximum.reduceat(impact, own), size), np.repeat(size, size)
        whole = (many <= head) & (salts[t] == 1)
        layer = np.where(whole, 0, np.minimum(layers - 1, np.floor((1 - impact / top) * layers))).astype(np.int64)
        key = (np.repeat(np.arange(len(own)), size) * layers + layer)
        _, of_layer, count = np.unique(key, return_inverse=True, return_counts=True)
        parts = np.where(whole, 1, -(-count // block)[of_layer])
        part = h[of] % parts

        def rows(kind: str, pick: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Batches of some hundred thousand postings; pick: postings in order, edges: where rows begin."""
            ends = np.append(edges[1:], len(pick))
            at = 0
            while at < len(edges):
                stop = max(at + 1, int(np.searchsorted(ends, edges[at] + OUT_POSTINGS, "right")))
                some, lead = pick[edges[at] : ends[stop - 1]], pick[edges[at:stop]]
                if kind == "parts":
                    lists, bound = pa.nulls(stop - at, out.field("postings").type), top[lead]
                else:
                    own_docs = docs.take(pa.array(of[some]))
                    posting = pa.StructArray.from_arrays([*(own_docs.field(x) for x in ("key", *PERMISSION)), pa.array(impact[some])], fields=list(out.field("postings").type.value_type))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(edges[at:stop], ends[stop - 1]) - edges[at], pa.int32()), posting)
                    bound = np.maximum.reduceat(impact[some], edges[at:stop] - edges[at])
                columns = {"term": known.dictionary.take(pa.array(t[lead])), "salt": salt[lead], "salts": salts[t[lead]], "layer": layer[lead], "parts": parts[lead], "part": part[lead], "whole": whole[lead], "bound": bound, "postings": lists, "kind": [kind] * (stop - at), "bucket": np.full(stop - at, g // spread)}
                yield pa.RecordBatch.from_arrays([columns[x.name].cast(x.type) if isinstance(columns[x.name], pa.Array) else pa.array(columns[x.name], x.type) for x in out], schema=out)
                at = stop

        order = np.lexsort((of, part, key))
        yield from rows("blocks", order, starts(key[order], part[order]))
        yield from rows("parts", order, starts(key[order]))
        large = np.flatnonzero(~whole)
        if len(large):
            order = large[np.lexsort((of[large], -impact[large], key[large] // layers))]
            run_ = starts(key[order] // layers)
            order = order[np.arange(len(order)) - np.repeat(run_, np.diff(np.append(run_, len(order)))) < head]
            yield from rows("heads", order, starts(key[order] // layers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for g, payload in zip(b.column("g").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if held and g != at:
                    yield from group(at, held)
                    held = []
                at = g
                held.append(payload)
        if held:
            yield from group(at, held)

    return run


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def write_blocks(docs: DataFrame, path: str, key: list[str], fields: tuple = FIELDS, buckets: int = TERM_BUCKETS) -> None:
    """An index of docs at path: blocks, heads and tops. docs: the key, the fields and the permission columns.

    Corpus figures, which cover all rows of docs, are counted first. Then tasks make segments of their documents, with
    postings as an entry's number and a count, compressed, and these are shuffled once, by groups of terms; a group's
    task has all postings of its terms, weighs them and writes blocks. A term of more than HOT postings is divided by a
    hash of the key. A term's impacts are in LAYERS layers by size; a layer's postings are dealt over blocks of about BLOCK
    by a hash of their key. A block has a bound, its largest impact. A term of HEAD postings at most is one block.
    """
    spark, rows = docs.sparkSession, field_rows(docs, key, fields)
    counted = rows.select(F.explode("fields").alias("f")).select("f.field", F.coalesce("f.dl", F.size("f.ts")).alias("dl"), F.explode_outer(F.array_append(F.array_distinct("f.ts"), F.lit(""))).alias("term"))
    with borrowed(counted.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("dl")), "figures") as figures:
        of = {r["field"]: (r["df"], r["dl"] / r["df"]) for r in figures.where("term = ''").collect()}
        total = figures.where("term <> ''").agg(F.sum("df")).first()[0] or 0
        common = figures.where("term <> ''").groupBy("term").agg(F.sum("df").alias("n"), F.map_from_entries(F.collect_list(F.struct("field", "df"))).alias("df")).where(F.col("n") > HOT).collect()  # at most total / HOT rows
    hot = {r["term"]: -(-r["n"] // HOT) for r in common}
    hot_df = {r["term"]: [r["df"].get(k, 0) for k in range(len(fields))] for r in common}
    spread = max(1, total // (buckets * FILE_POSTINGS))
    segments = rows.mapInArrow(_segments(buckets, spread, hot), SEGMENTS)
    posting = T.StructType([*(rows.schema[c] for c in ("key", *PERMISSION)), T.StructField("impact", T.DoubleType())])
    schema = T.StructType([T.StructField("term", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("salt", "salts", "layer", "parts", "part")), T.StructField("whole", T.BooleanType()), T.StructField("bound", T.DoubleType()), T.StructField("postings", T.ArrayType(posting)), T.StructField("kind", T.StringType()), T.StructField("bucket", T.IntegerType())])
    make = _blocks(buckets, spread, hot, hot_df, [of.get(k, (0, 1.0)) for k in range(len(fields))], HEAD, LAYERS, BLOCK, to_arrow_schema(schema))
    written = segments.repartition("g").sortWithinPartitions("g").mapInArrow(make, schema)
    written.write.partitionBy("kind", "bucket").option("compression", "zstd").parquet(path)
    fs = (at := spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for kind in ("blocks", "heads", "parts"):
        fs.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, f"kind={kind}"))
    spark.createDataFrame([(buckets, T.StructType([f for f in schema if f.name != "kind"]).json())], "buckets int, schema string").write.parquet(f"{path}/kind=shape")


def hash_of(key: Column) -> Column:
    """A number below 2**31 - 1."""
    return F.pmod(F.xxhash64(key), F.lit(2**31 - 1)).cast("int")


def salt_of(h, salts):
    """The division of a common term that a key's hash falls into; for numpy arrays. Blocks.blocks_for() has the same as columns."""
    return h // 1021 % salts


def block_of(key: Column, parts: Column) -> Column:
    return F.pmod(hash_of(key), parts).cast("int")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


class Blocks:
    """Postings (term, key, permissions, impact) of a written index. Joins on (bucket, term) prune the folders that hold no wanted term."""

    def __init__(self, spark: SparkSession, path: str):
        shape = spark.read.parquet(f"{path}/kind=shape").first()
        self.buckets, schema = shape["buckets"], T.StructType.fromJson(json.loads(shape["schema"]))
        self.read = lambda name: spark.read.schema(schema).parquet(f"{path}/kind={name}")

    def tops(self) -> DataFrame:
        """(term, top): the largest impact of each term."""
        return self.read("parts").groupBy("term").agg(F.max("bound").alias("top"))

    def _keyed(self, wanted: DataFrame) -> DataFrame:
        return wanted.withColumn("bucket", bucket_of(F.col("term"), self.buckets))

    def heads(self, wanted: DataFrame) -> DataFrame:
        """The HEAD largest postings of the wanted terms (of a divided term, those of each division)."""
        some = small_side(self._keyed(wanted.select("term").distinct()))
        found = self.read("heads").unionByName(self.read("blocks").where("whole")).join(some, ["bucket", "term"], "left_semi")
        return found.select("term", F.explode("postings").alias("p")).select("term", "p.*")

    def blocks_above(self, wanted: DataFrame) -> DataFrame:
        """Blocks of wanted(term, least) that have a posting of that impact."""
        return self.read("blocks").join(small_side(self._keyed(wanted)), ["bucket", "term"]).where("bound >= least")

    def blocks_for(self, pairs: DataFrame) -> DataFrame:
        """Blocks that pairs(term, key) fall into, of every layer."""
        mine = F.pmod(F.floor(hash_of(F.col("key")) / F.lit(1021)), F.col("salts")) == F.col("salt")
        places = pairs.select("term", "key").distinct().join(self.read("parts").select("term", "salt", "salts", "layer", "parts"), "term").where(mine).select("term", "salt", "layer", block_of(F.col("key"), F.col("parts")).alias("part")).distinct()
        return self.read("blocks").join(self._keyed(places), ["bucket", "term", "salt", "layer", "part"], "left_semi")

    def above(self, wanted: DataFrame) -> DataFrame:
        """Postings of the blocks of wanted(term, least) that have one of that impact."""
        return self.blocks_above(wanted).select("term", F.explode("postings").alias("p")).select("term", "p.*")

    def of(self, pairs: DataFrame) -> DataFrame:
        """(term, key, impact) of pairs(term, key)."""
        rows = self.blocks_for(pairs).select("term", F.explode("postings").alias("p")).select("term", "p.key", "p.impact")
        return rows.join(pairs.select("term", "key").distinct(), ["term", "key"])


# ---------------------------------------------------------------- the walk


def plan_of(wanted: DataFrame, postings: Blocks) -> DataFrame:
    """wanted with, for each term of a question: top, upto (the sum of the tops so far, smallest first) and others (of all but it), written.

    A window holds the terms of one question.
    """
    w = Window.partitionBy("question_id")
    rows = wanted.join(postings.tops().join(small_side(wanted.select("term").distinct()), "term", "left_semi"), "term")
    return stored(rows.withColumn("upto", F.sum("top").over(w.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0))).withColumn("others", F.sum("top").over(w) - F.col("top")), "walk")


def reached(sums: DataFrame, pool: int) -> DataFrame:
    """(question_id, score): what the pool-th passage of a question has at least; questions with fewer have no row."""
    return top(sums, "question_id", [F.col("s").desc()], pool, "at").where(F.col("at") == pool).select("question_id", F.col("s").alias("score"))


def essential() -> Column:
    return F.col("upto") >= F.col("score") - MARGIN


def needed(plan: DataFrame) -> DataFrame:
    """(term, least): the impact from which a posting of an essential term can matter to any of the questions."""
    return plan.where(essential()).groupBy("term").agg(F.min(F.col("score") - MARGIN - F.col("others")).alias("least"))


def best(wanted: DataFrame, postings: Blocks, pool: int, may: Column, scope: DataFrame | None = None) -> DataFrame:
    """(question_id, key, score, place): the first `pool` passages of each question.

    wanted(question_id, term and the columns of the asker that `may` reads); may: whether a posting counts for a
    question; scope(question_id, key): the only passages that count. Questions without terms, null terms and empty
    tables find nothing.
    """
    plan = plan_of(wanted, postings)
    first = reached(summed(postings.heads(wanted), plan, may, scope, True), pool)
    plan = stored(plan.join(first, "question_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "walk")
    sums = stored(summed(postings.above(needed(plan)), plan.where(essential()), may, scope, True), "sums")
    rest = plan.groupBy("question_id").agg(F.max("score").alias("old"), F.max(F.when(~essential(), F.col("upto"))).alias("rest"))
    bar = rest.join(reached(sums, pool), "question_id", "left").select("question_id", F.coalesce("rest", F.lit(0.0)).alias("rest"), F.greatest("old", F.coalesce("score", F.lit(0.0))).alias("bar"))
    left = stored(sums.join(bar, "question_id").where(F.col("s") + F.col("rest") >= F.col("bar") - MARGIN).select("question_id", "key", "s"), "candidates")
    pairs = left.select("question_id", "key").join(plan.where(~essential()).select("question_id", "term"), "question_id")
    added = postings.of(pairs).join(pairs, ["term", "key"]).select("question_id", "key", F.col("impact").alias("s"))
    scores = left.unionByName(added).groupBy("question_id", "key").agg(F.round(F.sum("s"), 9).alias("score"))
    return top(scores, "question_id", [F.col("score").desc(), F.col("key")], pool, "place")


def walked(wanted: DataFrame, postings: Blocks, pool: int, may: Column) -> DataFrame:
    """One row: blocks_held of the wanted terms, and blocks_read by the second round of a walk. (The third reads what its candidates fall into.)"""
    plan = plan_of(wanted, postings)
    plan = stored(plan.join(reached(summed(postings.heads(wanted), plan, may, None), pool), "question_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "walk")
    held = postings.blocks_above(wanted.select("term", F.lit(0.0).alias("least")).distinct()).agg(F.count("*").alias("blocks_held"))
    return held.crossJoin(postings.blocks_above(needed(plan)).agg(F.count("*").alias("blocks_read")))
