"""Registered queries over listings, sinks, cells and passages, each with its SQL twin beside it where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.operators import auditlog, chunking, evals, grids, language, layout, lifecycle, listings, objects, redaction, retrieval, sinks, versioned
from tidewell.sources import listing
from tidewell.sources.files import storage_key
from tidewell.sources.shared import shared_folder
from tidewell.sources.tables import governed_documents, questions, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(r"""with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', e'\\1\x01', 'g'), e'\x01'), lambda s: trim(s, e' \t\n\r')), lambda s: s <> '') s from documents),
c as (select doc_id, cast(i - 1 as int) chunk_index, length(s[i]) char_count from s, lateral (select unnest(range(1, len(s) + 1)) i))
select doc_id, chunk_index, char_count, doc_id in (select vec_id from embeddings) embedded from c where chunk_index between 5 and 24""")
def chunk_listing(spark, sf_dir) -> DataFrame:
    """The second page of each document's sentences as passages (a page is the feature)."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("chunk_index", "t")).select("doc_id", "chunk_index", F.length("t").alias("char_count"))
    return listings.chunk_listing(chunks, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), 20, 5)


@query("select o_custkey file_id, c_name \"name\", count(*) pending from orders join customer on c_custkey = o_custkey where o_orderstatus = 'P' group by all")
def pending_files(spark, sf_dir):
    """Customers as files, their pending orders as versions."""
    versions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("CURRENT").alias("state"))
    return listings.pending_files(versions, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("name")))


@query("select s_suppkey doc_id, n_name email from supplier left join nation on n_nationkey = s_nationkey and n_regionkey <> 0")
def documents_with_owner(spark, sf_dir):
    """Suppliers as documents, nations as their owners; those of one region are gone."""
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_nationkey").alias("owner_id"))
    users = table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("email"))
    return listings.with_owner(docs, users).select("doc_id", "email")


@query("""with b as (select [r for r in [case when not coalesce(lang in ('en', 'de', 'fr', 'es'), false) then 'lang' end, case when not coalesce(length(source) <= 4, false) then 'source' end, case when not coalesce(n_chars = length(text), false) then 'n_chars' end] if r is not null] r from documents)
select array_to_string(r, ',') broken, count(*) n from b group by all""")
def broken_rules(spark, sf_dir):
    """Documents by the rules of the table that they break: known languages, short sources, right lengths."""
    rules = {"lang": F.col("lang").isin("en", "de", "fr", "es"), "source": F.length("source") <= 4, "n_chars": F.col("n_chars") == F.length("text")}
    docs = table(spark, sf_dir, "documents").select(F.array_join(listings.broken_rules(rules), ",").alias("broken"))
    return docs.groupBy("broken").agg(F.count("*").alias("n"))


@query("select event_type, count(*) cases, count(*) filter (value > 50) passed, median(value) median_seconds from events group by 1")
def suite_tallies(spark, sf_dir):
    """Events as cases of a suite: passes by kind, and the median time."""
    events = table(spark, sf_dir, "events")
    times = events.groupBy("event_type").agg(F.median("value").alias("median_seconds"))
    return listings.tally(events, "event_type", F.col("value") > 50).join(times, "event_type")


@query("""with d as (select doc_id, ['EXTRACTED', 'CHUNKED', 'CHUNKING_FAILED', 'EMBEDDING_FAILED', 'LIVE'][doc_id % 5 + 1] status from documents)
select doc_id, 'CHUNKED' status, 'EMBED' stage from d where status = 'EMBEDDING_FAILED' and not exists (select 1 from events where event_id % 1000 = doc_id and event_type = 'purchase' and event_id % 4 < 2)""")
def backfill_reset(spark, sf_dir):
    """Documents whose vectors failed and that no live job has, set back to where the stage takes them up."""
    status = F.element_at(F.array(*map(F.lit, ("EXTRACTED", "CHUNKED", "CHUNKING_FAILED", "EMBEDDING_FAILED", "LIVE"))), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", status.alias("status"))
    jobs = table(spark, sf_dir, "events").where("event_type = 'purchase'").select((F.col("event_id") % 1000).alias("doc_id"), F.when(F.col("event_id") % 4 < 2, "PENDING").otherwise("DONE").alias("status"))
    return lifecycle.backfill_reset(docs, jobs, "EMBED")


@query("select sha256(html) || '.html' \"key\", count(*) pages from pages group by 1")
def storage_keys(spark, sf_dir):
    """Where pages would be kept: one key for equal content."""
    return table(spark, sf_dir, "pages").select(storage_key(F.encode("html", "UTF-8"), F.lit(".HTML")).alias("key")).groupBy("key").agg(F.count("*").alias("pages"))


@query(r"select page_id, coalesce(nullif(trim(case when page_id % 2 = 0 then url end), ''), regexp_replace(url, '^.*/', '')) title from pages")
def page_titles(spark, sf_dir):
    """A title where there is one, else the last part of the address."""
    return table(spark, sf_dir, "pages").select("page_id", tx.title_of(F.when(F.col("page_id") % 2 == 0, F.col("url")), F.col("url")).alias("title"))


@query("""with c as (select o_custkey, o_orderkey, o_orderstatus, row_number() over w k, first_value(o_orderpriority) over w f from orders window w as (partition by o_custkey, o_orderstatus order by o_orderkey))
select o_custkey, o_orderkey, f o_orderpriority from c""")
def filled_cells(spark, sf_dir):
    """Orders of a customer as a sheet whose priority cells are merged down over rows of one status."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey")) == 1
    cells = table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.when(first, F.col("o_orderpriority")))
    return grids.fill_down(cells, "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderstatus").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("select p_partkey, '[Figure] (text read from a picture by OCR)' || case when p_size % 2 = 0 then ' ' || p_brand else '' end || chr(10) || p_name \"text\" from part")
def figure_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", grids.figure_text(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.col("p_name")).alias("text"))


@query("select source owner_id, 'QUARANTINED' status, count(*) documents, count(*) jobs from documents group by 1")
def landed_documents(spark, sf_dir):
    """Documents landed in quarantine with a scan job each, read back."""
    folder = _folder(spark, "landing")
    sinks.land(governed_documents(spark, sf_dir).select("doc_id", "owner_id", "classification", "sha256"), folder, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    docs, jobs = spark.read.parquet(f"{folder}/documents"), spark.read.parquet(f"{folder}/jobs").where("stage = 'SCAN' and status = 'PENDING'")
    per = jobs.groupBy("doc_id").agg(F.count("*").alias("jobs"))
    return docs.join(per, "doc_id").groupBy("owner_id", "status").agg(F.count("*").alias("documents"), F.sum("jobs").alias("jobs"))


@query("select doc_id, lang, md5(text) digest from documents where text is not null")
def artifact_round_trip(spark, sf_dir):
    """Documents as JSON artifacts, written and read back."""
    folder = _folder(spark, "artifacts")
    sinks.write_artifacts(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), folder, "normalized")
    rows = spark.read.parquet(f"{folder}/normalized").select("doc_id", F.from_json("artifact", "doc_id long, lang string, text string").alias("a"))
    return rows.where("a.text is not null").select("doc_id", "a.lang", F.md5("a.text").alias("digest"))


@query("select doc_id, e.vec_id is not null embedded from documents d left join embeddings e on e.vec_id = d.doc_id and len(e.embedding) = 64")
def vectors_written_back(spark, sf_dir):
    folder = _folder(spark, "vectors")
    sinks.write_vectors(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), folder, width=64)
    return spark.read.parquet(folder).select("doc_id", F.col("embedding").isNotNull().alias("embedded"))


@query("""with o as (select user_id, event_type, min(event_id) event_id from events where event_id % 2 = 0 and event_type <> 'click' group by all),
n as (select user_id, event_type, arg_min(event_id, (ts, event_id)) event_id from events where event_id % 2 = 1 and event_type <> 'click' group by all)
select user_id, event_type, event_id from n where not exists (select 1 from o where o.user_id = n.user_id and o.event_type = n.event_type) union all select user_id, event_type, event_id from events where event_id % 2 = 1 and event_type = 'click'""")
def audit_appended(spark, sf_dir):
    """Events of odd number appended to a log that holds the even ones: a kind once for each user, clicks in full."""
    events, folder = table(spark, sf_dir, "events"), _folder(spark, "audit")
    sinks.append_audit(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), folder, "user_id", ("click",))
    return spark.read.parquet(folder).select("user_id", "event_type", "event_id")


@query(ORACLE_SQL["audit_appended"])
def audit_log_guarded(spark, sf_dir):
    """audit_appended by the log with filters beside it: even events first, then the odd ones."""
    events, folder = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), _folder(spark, "audit-log")
    for parity in (0, 1):
        auditlog.append(events.where(F.col("event_id") % 2 == parity), folder, "user_id", ("click",))
    return spark.read.parquet(f"{folder}/log").where("event_id % 2 = 1").select("user_id", "event_type", "event_id")


@query("select owner_id, considered, sent, withheld, case when sent = 0 or bad = 0 then 'PUBLIC' else 'RESTRICTED' end tier, sent = 0 or considered <> 40 refused from (select source owner_id, count(*) considered, count(*) sent, 0 withheld, count(*) filter (t is distinct from 0) bad from documents left join (select doc_id, max(toxic) t from labels group by 1) using (doc_id) where doc_id % 17 <> 0 group by 1)")
def boundary_record_open(spark, sf_dir):
    """The record of each owner's documents where the setting lets all tiers pass; 40 documents are expected of each."""
    docs = governed_documents(spark, sf_dir).where("deleted_at is null").withColumn("expected", F.lit(40).cast("long"))
    return redaction.boundary_record(docs, "owner_id", allow_restricted=True, expected="expected")


@query()
def masked_records(spark, sf_dir):
    """What each conversation's record says of its masked values."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return redaction.masked_record(redaction.redact(turns, "conv_id", "turn"), "conv_id")


@query()
def passage_search(spark, sf_dir):
    """Questions over passages: documents are cut into passages, indexed by text, heading and title with their permissions, and ranked."""
    docs, folder = governed_documents(spark, sf_dir), _folder(spark, "passages")
    found = retrieval.search_passages(questions(spark, sf_dir), chunking.passages_of(docs), folder, 10)
    return found.select("question_id", "doc_id", "chunk_index", F.round("score", 6).alias("score"), "place")


@query()
def questions_of_documents(spark, sf_dir):
    """How many questions of an evaluation set each document gave."""
    return evals.derive_questions(governed_documents(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("questions"))


@query("""with d as (select doc_id, lang, text, string_split(text, '') c from documents where text is not null),
g as (select doc_id, lang, c[i] || c[i + 1] || c[i + 2] g from d, lateral (select unnest(range(1, len(c) - 1)) i)),
p as (select lang, g, count(*) n from g where lang is not null and doc_id % 5 <> 0 group by lang, g qualify row_number() over (partition by lang order by n desc, g) <= 2000),
v as (select distinct g from p), l as (select lang, sum(n) + (select count(*) from v) s from p group by lang),
w as (select l.lang, v.g, ln((coalesce(n, 0) + 1) / s) w from l cross join v left join p on p.lang = l.lang and p.g = v.g),
o as (select doc_id, g, count(*) n from g semi join v using (g) group by all),
s as (select doc_id, w.lang, sum(n * w) s from o join w using (g) group by all),
b as (select doc_id, arg_max(lang, s) b from s group by doc_id)
select doc_id, case when length(trim(text, e' \t\n\r')) >= 40 then b end detected from documents left join b using (doc_id)""")
def detected_languages(spark, sf_dir):
    """The language of each document by profiles that four fifths of the documents are counted into."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    fitted = language.profiles(language.gram_counts(docs.where("doc_id % 5 <> 0")))
    return language.detect_languages(docs.select("doc_id", "text"), fitted)


@query("""with o as (select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders)
select o_custkey, count(*) orders, round(sum(case when o_custkey % 10 = 3 then o_totalprice * 2 else o_totalprice end), 2) total, max(o_custkey % 10 = 3) replaced
from o where o_custkey % 10 <> 7 and not (o_custkey % 10 = 3 and o_orderstatus = 'F') group by o_custkey""")
def replaced_by_key(spark, sf_dir):
    """Orders by customer in a versioned table: some customers' rows are replaced, some go; the last version is read."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").withColumn("replaced", F.lit(False))
    kept = versioned.VersionedTable(spark, _folder(spark, "versioned"), "o_custkey")
    kept.create(orders)
    fresh = orders.where("o_custkey % 10 = 3 and o_orderstatus <> 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn("replaced", F.lit(True))
    kept.replace(fresh, orders.where("o_custkey % 10 = 3 or o_custkey % 10 = 7"))
    return kept.read().groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("replaced").alias("replaced"))


def _listed_pages(spark, sf_dir, folder: str, size: int = 100) -> tuple[DataFrame, int]:
    """pages as the entries of an outside listing, and how many pages of `size` ids they make."""
    entries = table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("long").alias("size"))
    last = entries.agg(F.coalesce(F.max("page_id"), F.lit(-1))).first()[0]
    return entries, last // size + 1


_HOSTS = "select regexp_extract(url, '^https?://([^/]+)', 1) host, count(*) entries, sum(length(html)) size from pages group by 1"


def _by_host(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count("*").alias("entries"), F.sum("size").alias("size"))


@query(_HOSTS)
def listed_hosts(spark, sf_dir):
    """A paged listing read as a table: entries by host."""
    folder = _folder(spark, "listing")
    entries, n = _listed_pages(spark, sf_dir, folder)
    listing.write_pages(entries, folder, F.floor(F.col("page_id") / 100).cast("int"), n)
    return _by_host(listing.read_listing(spark, folder, "page_id long, url string, size long"))


@query(_HOSTS)
def stream_listed_hosts(spark, sf_dir):
    """The same listing as a stream that is stopped after half of the pages and goes on from its checkpoint when the rest is there."""
    folder, out = _folder(spark, "listing"), _folder(spark, "listed")
    entries, n = _listed_pages(spark, sf_dir, folder)
    at = F.floor(F.col("page_id") / 100).cast("int")
    for rows, upto in ((entries.where(at < n // 2), n // 2), (entries.where(at >= n // 2), n)):
        listing.write_pages(rows, folder, at, upto)
        source = listing.read_listing(spark, folder, "page_id long, url string, size long", stream=True)
        source.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return _by_host(spark.read.schema("page_id long, url string, size long").parquet(f"{out}/rows"))


@query(r"""with recursive w as (select p_partkey % 50 page, 'w' || p_partkey word, p_partkey % 7 * 34.0 + p_partkey % 5 x1, p_partkey // 200 * 13.0 + p_partkey % 3 y1, p_partkey % 7 * 34.0 + p_partkey % 5 + 14 + p_partkey % 11 x2, p_partkey // 200 * 13.0 + p_partkey % 3 + 8 y2 from part),
c as (select *, (y1 + y2) / 2 cy, 8.0 h from w),
r as (select *, sum(s) over (partition by page order by cy, x1, word) "row" from (select *, case when coalesce(cy - lag(cy) over (partition by page order by cy, x1, word) > 0.6 * h, true) then 1 else 0 end s from c)),
q as (select *, sum(t) over (partition by page, "row" order by x1, x2, word) piece from (select *, case when coalesce(x1 - max(x2) over (partition by page, "row" order by x1, x2, word rows between unbounded preceding and 1 preceding) > 2 * h, true) then 1 else 0 end t from r)),
p as (select page, "row", piece, string_agg(word, ' ' order by x1, x2, word) t, min(x1) l, max(x2) r, round(avg(cy), 6) cy, any_value(h) h from q group by all),
u as (select b.page, b."row", b.piece, arg_max({'row': a."row", 'piece': a.piece}, {'c': a.cy, 'l': -a.l, 'row': a."row", 'piece': a.piece}) up from p b join p a on a.page = b.page and b.cy > a.cy and b.cy - a.cy <= 1.8 * b.h
  and (least(b.r, a.r) - greatest(b.l, a.l) >= 0.3 * least(b.r - b.l, a.r - a.l) or abs(b.l - a.l) <= 1.5 * b.h) group by all),
k as (select page, "row", piece, "row" tr, piece tp from p anti join u using (page, "row", piece) union all select u.page, u."row", u.piece, k.tr, k.tp from u join k on k.page = u.page and k."row" = u.up."row" and k.piece = u.up.piece)
select page, cast(row_number() over (partition by page order by tr, tp) as int) block, count(*) pieces, string_agg(t, chr(10) order by k."row", k.piece) "text" from k join p using (page, "row", piece) group by page, tr, tp""")
def text_blocks(spark, sf_dir):
    """Part names as loose words of pictures: stacked pieces as blocks."""
    parts = table(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(50)).alias("page"), F.col("p_partkey").alias("k"), F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("word"))
    x, y = F.pmod("k", F.lit(7)) * 34.0 + F.pmod("k", F.lit(5)), F.floor(F.col("k") / 200) * 13.0 + F.pmod("k", F.lit(3))
    words = parts.select("page", "word", x.alias("x1"), y.alias("y1"), (x + 14 + F.pmod("k", F.lit(11))).alias("x2"), (y + 8).alias("y2"))
    return layout.text_blocks(words, "page")


@query("""with d as (select doc_id, encode(coalesce(text, '')) c, sha256(coalesce(text, '')) || '.txt' k from documents),
o as (select distinct k "key", octet_length(c) length from d)
select * from o where "key" not in (select k from d where doc_id % 10 = 1) union all
select 'copy-' || "key", length from o where "key" in (select k from d where doc_id % 10 = 0)""")
def stored_objects(spark, sf_dir):
    """Texts stored under their digest; some are copied under another key, then some deleted; what is there is listed."""
    folder = _folder(spark, "objects")
    docs = table(spark, sf_dir, "documents").withColumn("content", F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    docs = docs.select("doc_id", "content", storage_key(F.col("content"), F.lit(".txt")).alias("key"))
    objects.put_objects(docs.select("key", "content").dropDuplicates(["key"]), folder)
    objects.copy_objects(docs.where("doc_id % 10 = 0").select(F.col("key").alias("source"), F.concat(F.lit("copy-"), "key").alias("target")).distinct(), folder)
    objects.delete_objects(docs.where("doc_id % 10 = 1").select("key").distinct(), folder)
    return objects.list_objects(spark, folder)
