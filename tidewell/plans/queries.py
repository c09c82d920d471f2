"""The registered queries over the driver tables. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import identifiers, lattice
from tidewell.functions import text as tx
from tidewell.operators import access, ann, answers, chunking, docsearch, evals, grids, layout, lexical, lifecycle, proximity, quantised, records, redaction, retrieval, sinks, sync
from tidewell.plans import catalogue
from tidewell.sources.files import html_units
from tidewell.sources.shared import shared_folder, stored
from tidewell.sources.tables import governed_documents, questions, table
from tidewell.streaming import ingest, status

QUERIES: dict = dict(catalogue.QUERIES)


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---------------------------------------------------------------- permission and listing


def _visible(spark, sf_dir, viewer: str | None, admin: bool) -> DataFrame:
    docs = governed_documents(spark, sf_dir)
    may = access.visible(F.col("classification"), F.col("owner_id"), F.lit(viewer).cast("string"), F.lit(admin))
    return docs.where(F.col("deleted_at").isNull() & may).select("doc_id", "owner_id", "classification")


@query
def visible_documents_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(spark, sf_dir, "src3", False)


@query
def visible_documents_anon(spark, sf_dir):
    return _visible(spark, sf_dir, None, False)


@query
def visible_documents_admin(spark, sf_dir):
    return _visible(spark, sf_dir, "src3", True)


@query
def document_page_with_total(spark, sf_dir):
    """A page of the visible documents, newest first, and how many there are."""
    seen = _visible(spark, sf_dir, "src3", False)
    total = seen.agg(F.count("*").alias("total"))
    return seen.orderBy(F.col("doc_id").desc()).offset(20).limit(20).crossJoin(F.broadcast(total)).select("doc_id", "owner_id", "total")


@query
def restorable_documents(spark, sf_dir):
    mine = lifecycle.restorable(_records(spark, sf_dir), F.lit("src3"), F.lit(False))
    return mine.orderBy(F.col("deleted_at").desc(), "doc_id").limit(50).select("doc_id", "owner_id")


# ---------------------------------------------------------------- retrieval


def _asked(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return questions(spark, sf_dir).join(vectors, "question_id")


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _search(spark, sf_dir, **how) -> DataFrame:
    return retrieval.search(_asked(spark, sf_dir), governed_documents(spark, sf_dir), _vectors(spark, sf_dir), **how)


def _told(found: DataFrame, *more: str) -> DataFrame:
    return found.select("question_id", "doc_id", F.round("score", 6).alias("score"), "semantic_rank", "lexical_rank", F.round("similarity", 6).alias("similarity"), *more)


@query
def semantic_topk(spark, sf_dir):
    docs = governed_documents(spark, sf_dir).where("deleted_at is null").select("doc_id", "classification", "owner_id")
    best = retrieval.semantic_arm(_asked(spark, sf_dir), _vectors(spark, sf_dir).join(docs, "doc_id"), 10)
    return best.select("question_id", "doc_id", F.round("similarity", 6).alias("similarity"), "semantic_rank")


@query
def bm25_postings(spark, sf_dir):
    """Per term of the corpus: documents and occurrences."""
    return retrieval.postings(table(spark, sf_dir, "documents"), "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


@query
def bm25_topk(spark, sf_dir):
    best = retrieval.lexical_arm(_asked(spark, sf_dir), governed_documents(spark, sf_dir), 10)
    return best.select("question_id", "doc_id", F.round("lexical_score", 6).alias("lexical_score"), "lexical_rank")


@query
def bm25_indexed_topk(spark, sf_dir):
    """bm25_topk from an index of blocks that is written first."""
    docs, path = governed_documents(spark, sf_dir), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    lexical.write_blocks(docs, path, ["doc_id"])
    best = retrieval.lexical_arm(_asked(spark, sf_dir), docs, 10, index=path)
    return best.select("question_id", "doc_id", F.round("lexical_score", 6).alias("lexical_score"), "lexical_rank")


@query
def hybrid_rrf(spark, sf_dir):
    return _told(_search(spark, sf_dir, limit=10), "fusion_rank")


@query
def hybrid_semantic_only(spark, sf_dir):
    return _told(_search(spark, sf_dir, limit=10, mode="semantic"), "fusion_rank")


@query
def hybrid_lexical_only(spark, sf_dir):
    return _told(_search(spark, sf_dir, limit=10, mode="lexical"), "fusion_rank")


@query
def hybrid_scoped(spark, sf_dir):
    """Hybrid search of each asker inside the documents they own."""
    return _told(_search(spark, sf_dir, limit=10, scope=_own(spark, sf_dir)), "fusion_rank")


def _own(spark, sf_dir) -> DataFrame:
    asked = questions(spark, sf_dir).select("question_id", F.col("viewer_id").alias("owner_id"))
    return governed_documents(spark, sf_dir).select("doc_id", "owner_id").join(asked, "owner_id").select("question_id", "doc_id")


@query
def grounding_scoped(spark, sf_dir):
    """The gate for scoped searches: any hit inside the scope grounds a question."""
    found = _search(spark, sf_dir, limit=10, scope=_own(spark, sf_dir))
    return retrieval.grounding(found, questions(spark, sf_dir), governed_documents(spark, sf_dir), scoped=True).select("question_id", "best_similarity", "grounded")


@query
def rerank_overlap(spark, sf_dir):
    return _told(_search(spark, sf_dir, limit=10, rerank=True), "rerank_score", "position")


@query
def rerank_proximity(spark, sf_dir):
    """Hybrid search, reranked by how near a question's terms stand."""
    found = stored(_search(spark, sf_dir, limit=retrieval.RERANK_FETCH), "fused")
    scores = proximity.near_scores(found, questions(spark, sf_dir), governed_documents(spark, sf_dir))
    return _told(proximity.reranked(found, scores, 10), "rerank_score", "position")


@query
def rerank_measures(spark, sf_dir):
    """Hit rate at one and mean reciprocal rank of the fused order and of two rerankings of it, where the documents that hold a run of an item's terms are expected."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    docs = governed_documents(spark, sf_dir)
    live = docs.where("deleted_at is null")
    expected = stored(evals.holders_of(live, items), "expected")
    asked = _asked(spark, sf_dir).withColumn("is_admin", F.lit(True))
    found = stored(retrieval.search(asked, docs, _vectors(spark, sf_dir), limit=retrieval.RERANK_FETCH), "fused")
    near = proximity.reranked(found, proximity.near_scores(found, asked, docs), retrieval.RERANK_FETCH)
    overlap = retrieval.rerank_overlap(found, asked, docs, retrieval.RERANK_FETCH)
    out = None
    for name, rows, place in (("fused", found, "fusion_rank"), ("overlap", overlap, "position"), ("proximity", near, "position")):
        first = rows.join(expected, ["question_id", "doc_id"]).groupBy("question_id").agg(F.min(place).alias("place"))
        all_ = expected.select("question_id").distinct().join(first, "question_id", "left")
        row = all_.agg(F.count("*").alias("questions"), F.round(F.avg((F.coalesce("place", F.lit(0)) == 1).cast("int")), 6).alias("hit_at_1"), F.round(F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))), 6).alias("mrr")).select(F.lit(name).alias("ranking"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query
def grounding_gate(spark, sf_dir):
    return retrieval.grounding(_search(spark, sf_dir, limit=10), questions(spark, sf_dir), governed_documents(spark, sf_dir))


@query
def grounded_results(spark, sf_dir):
    found, asked = _search(spark, sf_dir, limit=10), questions(spark, sf_dir)
    gate = retrieval.grounding(found, asked, governed_documents(spark, sf_dir))
    return _told(retrieval.withhold(found, gate), "fusion_rank")


@query
def token_usage_rollup(spark, sf_dir):
    return retrieval.token_usage(_search(spark, sf_dir, limit=10), governed_documents(spark, sf_dir))


@query
def document_metadata_search(spark, sf_dir):
    """For each question, how many documents hold it in title, owner or text, and the newest of them."""
    found = retrieval.search_metadata(governed_documents(spark, sf_dir), questions(spark, sf_dir))
    return found.groupBy("question_id").agg(F.count("*").alias("hits"), F.max(F.struct("created_at", "doc_id"))["doc_id"].alias("newest"))


@query
def lexical_trim(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", tx.lexical_question(F.col("text")).alias("searched"), F.array_join(tx.informative_terms(F.col("text")), " ").alias("informative"))


@query
def eval_hit_at_k(spark, sf_dir):
    """Hit rates of lexical search where a benchmark item should find the documents that hold a run of its terms."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    docs = governed_documents(spark, sf_dir)
    expected = evals.holders_of(docs.where("deleted_at is null"), items)
    asked = questions(spark, sf_dir).withColumn("is_admin", F.lit(True))
    best = retrieval.lexical_arm(asked.join(expected.select("question_id").distinct(), "question_id", "left_semi"), docs, 10)
    return evals.summary(evals.ranks_of(best, expected, "lexical_rank"))


@query
def eval_question_templates(spark, sf_dir):
    return evals.derive_questions(governed_documents(spark, sf_dir)).select("doc_id", "question", "tests")


@query
def eval_candidates(spark, sf_dir):
    """Up to three passages of each source for an evaluation set (a sampling operator)."""
    docs = _records(spark, sf_dir).withColumn("is_table", F.col("doc_id") % 13 == 0)
    return evals.candidates(docs, 3, "owner_id").select("owner_id", "doc_id", "place")


# ---------------------------------------------------------------- text


@query
def clean_text_profile(spark, sf_dir):
    """Cleaned texts: their length and digest."""
    docs = tx.nfkc(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return docs.select("doc_id", tx.clean(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query
def quality_gate(spark, sf_dir):
    """Documents by source and failures of the gate, each text as one page of a scan."""
    docs = table(spark, sf_dir, "documents").select("source", tx.quality_failures(F.length(F.coalesce("text", F.lit(""))), F.lit(1), F.lit(True)).alias("f"))
    return docs.groupBy("source", F.array_join("f", ",").alias("failures")).agg(F.count("*").alias("n"))


@query
def prose_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(tx.prose_ratio(F.col("text")), 6).alias("ratio"))


@query
def effective_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", tx.effective_language(tx.prose_ratio(F.col("text")), F.col("lang")).alias("effective"))
    return docs.groupBy("lang", "effective").agg(F.count("*").alias("n"), F.count_if(F.col("effective") != "en").alias("skipped"))


@query
def split_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.paragraphs(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("paragraphs"), F.aggregate("p", F.lit(0), lambda a, p: F.greatest(a, F.length(p))).alias("longest"))


@query
def split_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("sentences"), F.aggregate("s", F.lit(0), lambda a, s: F.greatest(a, F.length(s))).alias("longest"))


def _chunks(spark, sf_dir) -> DataFrame:
    """Passages of documents, the title as the one heading that is looked for."""
    docs = governed_documents(spark, sf_dir).select("doc_id", "text", F.array("title").alias("headings"))
    return chunking.chunk_sections(chunking.split_sections(docs, ["doc_id"]), "doc_id")


@query
def chunk_documents(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", "char_count", F.md5("text").alias("digest"))


#: Target and largest number of tokens of a passage.
TOKEN_TARGET, TOKEN_WINDOW = 400, 500


def _pieces() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@query
def chunk_documents_by_tokens(spark, sf_dir):
    """Passages under a budget of tokens instead of characters, and their tokens."""
    docs = governed_documents(spark, sf_dir).select("doc_id", "text", F.array("title").alias("headings"))
    chunks = chunking.chunk_sections(chunking.split_sections(docs, ["doc_id"]), "doc_id", measure=lattice.TokenCount(_pieces()), target=TOKEN_TARGET, maximum=TOKEN_WINDOW)
    return lattice.with_tokens(chunks, _pieces()).select("doc_id", "chunk_index", "char_count", "tokens", F.md5("text").alias("digest"))


@query
def token_usage_by_lattice(spark, sf_dir):
    """token_usage_rollup with tokens counted by pieces."""
    found, docs = _search(spark, sf_dir, limit=10), governed_documents(spark, sf_dir)
    return retrieval.token_usage(found, lattice.with_tokens(docs.select("doc_id", "text"), _pieces()), tokens=F.col("tokens"))


@query
def chunk_stats(spark, sf_dir):
    """Per document: passages, characters, the largest passage, and whether numbers have no gaps."""
    return _chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("char_count").alias("chars"), F.max("char_count").alias("largest"), (F.max("chunk_index") == F.count("*") - 1).alias("contiguous"))


@query
def table_row_groups(spark, sf_dir):
    """Line items of each supplier as a table, in groups of whole rows under a repeated header."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", F.concat_ws(" | ", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), "l_returnflag").alias("line")).alias("s"))
    tables = lines.groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]).alias("lines")).withColumn("header", F.lit("order | line | quantity | flag"))
    return chunking.row_groups(tables, "l_suppkey", "header", "lines").select("l_suppkey", "group", "rows", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query
def heading_levels(spark, sf_dir):
    """Headings of pages and their level by size: h1 to h6 as type sizes over the pages' text."""
    heads = html_units(table(spark, sf_dir, "pages")).select("page_id", "place", F.col("heading").alias("text"), (F.lit(26.0) - 2 * F.col("level")).alias("size"))
    body = table(spark, sf_dir, "pages").select("page_id", F.lit(-1).alias("place"), F.trim(F.regexp_replace(F.regexp_replace("html", r"(?s)<[^>]*>", " "), r"\s+", " ")).alias("text"), F.lit(10.0).alias("size"))
    lines = layout.infer_headings(heads.unionByName(body), "page_id")
    return lines.where("level is not null").select("page_id", "place", "level", F.length("text").alias("chars"))


@query
def words_in_cells(spark, sf_dir):
    """Part names as words laid out on a grid of cells: which words each cell holds."""
    parts = table(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(50)).alias("page"), F.col("p_partkey").alias("k"), F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("word"))
    at = parts.withColumn("x1", F.pmod("k", F.lit(37)) * 7.0).withColumn("y1", F.pmod("k", F.lit(23)) * 11.0).withColumn("x2", F.col("x1") + 12).withColumn("y2", F.col("y1") + 8)
    cells = parts.select("page").distinct().withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(47)))).select("page", F.col("c").alias("cell"), (F.pmod("c", F.lit(8)) * 32.0).alias("cx1"), (F.floor(F.col("c") / 8) * 44.0).alias("cy1"))
    cells = cells.withColumn("cx2", F.col("cx1") + 32).withColumn("cy2", F.col("cy1") + 44)
    return layout.words_in_cells(at, cells, "page", 32.0)


# ---------------------------------------------------------------- governance


@query
def find_emails(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.[A-Za-z]{2,})"), F.lit(1))
    rows = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", F.explode(found).alias("email"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("email").alias("values"), F.min("email").alias("first"))


@query
def find_pii_counts(spark, sf_dir):
    """Identifiers by kind over all documents."""
    found = redaction.find_all(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("findings").alias("f")).groupBy("f.label").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query
def redact_conversations(spark, sf_dir):
    """Each conversation as one request: placeholders and digests of its redacted turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    red = redaction.redact(turns, "conv_id", "turn")
    return red.select("conv_id", "turn", F.size("findings").alias("findings"), F.md5("redacted").alias("digest"))


@query
def redact_documents(spark, sf_dir):
    """Documents of each source as one request."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    red = redaction.redact(docs, "source", "doc_id").where(F.size("findings") > 0)
    return red.select("source", "doc_id", F.size("findings").alias("findings"), F.md5("redacted").alias("digest"))


@query
def masked_boundary_record(spark, sf_dir):
    """The boundary record of each owner's documents, with the list of what was masked in those that are sent."""
    docs = governed_documents(spark, sf_dir).where("deleted_at is null")
    sent = docs.where(access.sendable(F.col("classification"))).select("owner_id", "doc_id", "text")
    masked = redaction.masked_record(redaction.redact(sent, "owner_id", "doc_id"), "owner_id")
    return redaction.boundary_record(docs, "owner_id").join(masked, "owner_id", "left").select("owner_id", "considered", "sent", "withheld", "tier", "refused", F.to_json("masked").alias("masked"))


@query
def mask_preview(spark, sf_dir):
    words = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", F.explode(tx.split_blank(F.col("text"))).alias("w")).where(F.contains("w", F.lit("@")))
    return words.select("doc_id", identifiers.preview(F.col("w")).alias("preview")).groupBy("doc_id", "preview").agg(F.count("*").alias("n"))


@query
def boundary_record(spark, sf_dir):
    """What each owner's documents would send past the boundary."""
    return redaction.boundary_record(governed_documents(spark, sf_dir).where("deleted_at is null"), "owner_id")


@query
def answer_context(spark, sf_dir):
    """The numbered context of each question."""
    made = answers.compose_context(_search(spark, sf_dir, limit=8, mode="lexical"), governed_documents(spark, sf_dir))
    return made.select("question_id", "passages", F.length("context").alias("chars"), F.md5("context").alias("digest"))


def _answers(spark, sf_dir) -> DataFrame:
    """Assistant turns as answers, the user turn before as context; a closing sentence adds markers and figures to check."""
    turns = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("context", F.lag("text").over(w)).where("role = 'assistant'")
    n = F.pmod("conv_id", F.lit(7)) + 1
    year = (F.lit(1990) + F.col("conv_id") % 30).cast("string")
    marked = F.concat("text", F.lit(" See ["), n.cast("string"), F.lit("] and [9] , in "), year, F.lit(" for 12 of 1,02,040."))
    return rows.select("conv_id", "turn", marked.alias("answer"), F.concat_ws(" ", "context", (F.lit(1990) + F.col("turn") * 3).cast("string"), F.lit("102040")).alias("context"))


@query
def citation_check(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    cleaned, valid, invalid = answers.verify_citations(F.col("answer"), F.lit(5))
    return rows.select("conv_id", "turn", F.md5(cleaned).alias("digest"), F.array_join(F.transform(valid, lambda n: n.cast("string")), ",").alias("valid"), F.array_join(F.transform(invalid, lambda n: n.cast("string")), ",").alias("invalid"))


@query
def numeric_fidelity(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumn("numbers", answers.checkable_numbers(F.col("answer")))
    rows = rows.withColumn("ok", answers.supported(F.col("numbers"), answers.normalised(F.col("context"))))
    return rows.select("conv_id", "turn", F.size("numbers").alias("checked"), F.size("ok").alias("supported"), F.round(answers.ratio(F.size("ok"), F.size("numbers")), 6).alias("fidelity"))


@query
def citation_coverage(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumn("s", answers.claims(F.col("answer")))
    return rows.select("conv_id", "turn", F.size("s").alias("sentences"), F.size(answers.cited(F.col("s"))).alias("cited"))


@query
def quote_fidelity(spark, sf_dir):
    """Quotations of assistant turns, the user turn before quoted whole or cut."""
    rows = _answers(spark, sf_dir).withColumn("answer", F.concat(F.lit('It says "'), F.substring("context", 1, 40), F.lit('" and “'), F.reverse(F.substring("context", 1, 30)), F.lit("” and \"no\".")))
    rows = rows.withColumn("q", answers.quotations(F.col("answer"))).withColumn("hay", answers.normalised(F.col("context")))
    return rows.select("conv_id", "turn", F.size("q").alias("quotes"), F.size(F.filter("q", lambda q: F.contains(F.col("hay"), answers.normalised(q)))).alias("verbatim"))


@query
def fidelity_rollup(spark, sf_dir):
    """Micro-averages over all answers: sums first, then ratios."""
    n = numeric_fidelity(spark, sf_dir).agg(F.sum("checked").alias("checked"), F.sum("supported").alias("supported"))
    c = citation_coverage(spark, sf_dir).agg(F.sum("sentences").alias("sentences"), F.sum("cited").alias("cited"))
    return n.crossJoin(c).select("checked", "supported", "sentences", "cited", F.round(answers.ratio(F.col("supported"), F.col("checked")), 6).alias("numeric"), F.round(answers.ratio(F.col("cited"), F.col("sentences")), 6).alias("coverage"))


@query
def hedged_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.groupBy("turn").agg(F.count("*").alias("n"), F.count_if(answers.hedges(F.col("text"))).alias("hedged"))


@query
def followup_expand(spark, sf_dir):
    return answers.expand_followups(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "expanded", F.md5("searched").alias("digest"))


# ---------------------------------------------------------------- lifecycle


@query
def dedup_canonical(spark, sf_dir):
    return lifecycle.dedup_canonical(_records(spark, sf_dir)).select("doc_id", "canonical_id", "is_duplicate")


@query
def tier_escalation(spark, sf_dir):
    return lifecycle.escalate_tiers(_records(spark, sf_dir)).where("copies > 1").select("canonical_id", "copies", "tier", "escalated")


@query
def version_chain(spark, sf_dir):
    return lifecycle.version_chain(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


def _jobs(spark, sf_dir) -> DataFrame:
    """events as jobs: stage by type, state and retries by the event's number."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, ("PENDING", "RUNNING", "DONE", "FAILED"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("job_id"), (F.col("event_id") % 1000).alias("doc_id"), F.col("event_type").alias("stage"), status.alias("status"), (F.col("event_id") % 3).alias("priority"), (F.col("event_id") % 5).cast("int").alias("retry_count"), F.col("ts").alias("scheduled_at"), F.when(status == "RUNNING", F.col("ts") + F.expr("interval 5 minutes")).alias("lease_expires_at"))


@query
def orders_by_priority(spark, sf_dir):
    """The three largest open orders of each priority."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return lifecycle.top_of_each(rows, "o_orderpriority", [F.col("o_totalprice").desc(), F.col("o_orderdate"), F.col("o_orderkey")], 3).select("o_orderpriority", "o_orderkey", "place")


@query
def audit_latest(spark, sf_dir):
    return lifecycle.latest_event(table(spark, sf_dir, "events"), "user_id").select("user_id", "event_id", "event_type")


@query
def audit_first_occurrence(spark, sf_dir):
    return lifecycle.first_occurrences(table(spark, sf_dir, "events"), "user_id", ("click",))


@query
def backfill_candidates(spark, sf_dir):
    docs = governed_documents(spark, sf_dir).where("deleted_at is null")
    return lifecycle.backfill_candidates(docs, _jobs(spark, sf_dir).where("stage = 'purchase'")).select("doc_id")


@query
def batch_status_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query
def report_round_trip(spark, sf_dir):
    """The rollup of batches as a report: written as one file, and read back."""
    rows, folder = batch_status_rollup(spark, sf_dir), f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    sinks.write_report(rows, folder)
    return spark.read.schema(rows.schema).json(folder)


@query
def upload_limits(spark, sf_dir):
    """Orders of a customer and day as an upload batch."""
    files = table(spark, sf_dir, "orders").select(F.concat_ws("-", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")).alias("batch"), (F.col("o_totalprice") * 500).cast("long").alias("size"))
    return lifecycle.batch_check(files, "batch")


@query
def folder_tiers(spark, sf_dir):
    """region > nation > customer as folders; tiers set on regions and on nations go down to customers."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("folder"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("folder"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"))
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("folder"), F.lit("PUBLIC").alias("tier"))
    strict = nations.where("folder in ('n3', 'n7', 'n11')").select("folder", F.lit("RESTRICTED").alias("tier"))
    return sync.folder_tiers(nations.unionByName(customers), roots.unionByName(strict), 3)


def _files(spark, sf_dir):
    """customer as what is known of an outside folder, and as what is listed in it now."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.md5(F.col("c_custkey").cast("string")).alias("md5"), F.col("c_acctbal").cast("string").alias("modified"), F.when(F.col("c_nationkey") % 5 == 0, "RESTRICTED").otherwise("PUBLIC").alias("tier"))
    known = c.where("file_id % 11 <> 0").withColumn("state", F.when(F.col("file_id") % 13 == 0, "REMOVED").when(F.col("file_id") % 17 == 0, "SKIPPED").otherwise("IMPORTED"))
    listing = c.where("file_id % 7 <> 0").withColumn("md5", F.when(F.col("file_id") % 9 == 0, F.md5(F.lit("new"))).when(F.col("file_id") % 10 == 0, F.lit(None)).otherwise(F.col("md5")))
    listing = listing.withColumn("tier", F.when(F.col("file_id") % 19 == 0, "RESTRICTED").otherwise(F.col("tier"))).withColumn("size", F.col("file_id") * 100000).withColumn("reason", F.when(F.col("file_id") % 23 == 0, "a form"))
    return known, listing


@query
def drive_diff(spark, sf_dir):
    return sync.diff(*_files(spark, sf_dir))


@query
def drive_diff_partial(spark, sf_dir):
    return sync.diff(*_files(spark, sf_dir), partial=True).groupBy("action", "tier").agg(F.count("*").alias("n"))


@query
def drive_reconcile(spark, sf_dir):
    """orders of a customer as the imported versions of one file."""
    o = table(spark, sf_dir, "orders")
    versions = o.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("imported_at"), F.when(F.col("o_orderkey") % 3 == 0, "CURRENT").otherwise("PENDING").alias("state"), F.when(F.col("o_orderkey") % 7 == 0, "DUPLICATE").when(F.col("o_orderkey") % 5 == 0, "EXTRACTION_FAILED").when(F.col("o_orderkey") % 4 == 0, "CHUNKED").otherwise("LIVE").alias("status"))
    return sync.reconcile(versions)


@query
def next_sync_slot(spark, sf_dir):
    """When each user's folder is due: the last event as the last success."""
    last = lifecycle.latest_event(table(spark, sf_dir, "events"), "user_id")
    due = sync.next_run(F.lit("2024-06-01 00:00:00").cast("timestamp"), F.col("ts"), F.col("ts"), F.col("user_id") % 4 == 0, 2, 30, "Asia/Kolkata")
    return last.select("user_id", due.alias("due"))


@query
def stream_ingest_counts(spark, sf_dir):
    """events through a file stream into hourly counts; the result is what a batch over the same rows gives."""
    events = ingest.read_events(spark, sf_dir, "events.parquet")
    sink = ingest.run_to_end(events.select("event_id", "event_type", "ts"), shared_folder(spark))
    rows = spark.read.parquet(sink)
    return rows.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- records, grids, index


def _records(spark, sf_dir) -> DataFrame:
    """Governed documents with a status, and some erased ones."""
    docs = governed_documents(spark, sf_dir)
    status = F.when(F.col("doc_id") % 6 == 0, "DUPLICATE").when(F.col("doc_id") % 11 == 0, "SUPERSEDED").otherwise("LIVE")
    return docs.withColumn("status", status).withColumn("purged_at", F.when(F.col("doc_id") % 34 == 0, F.col("deleted_at")))


def _decisions(name):
    def run(spark, sf_dir):
        docs = _records(spark, sf_dir)
        mine = (F.lit("src3"), F.lit(False))
        code = {
            "reclassify_decisions": lambda: records.reclassify_decision(docs, *mine, F.lit("RESTRICTED")),
            "delete_decisions": lambda: records.delete_decision(docs, *mine, F.col("doc_id") % 5 == 0),
            "restore_decisions": lambda: records.restore_decision(docs, *mine, F.col("doc_id") % 7 == 0),
        }[name]()
        return docs.select("doc_id", code.cast("int").alias("code"))

    run.__name__ = name
    return query(run)


for _name in ("reclassify_decisions", "delete_decisions", "restore_decisions"):
    _decisions(_name)


@query
def erasure(spark, sf_dir):
    """Documents after every twentieth one was asked to go; those with a running job stay."""
    docs, jobs = _records(spark, sf_dir), _jobs(spark, sf_dir).where("stage = 'purchase'")
    after, _, _ = records.erase(docs, docs.select("doc_id"), jobs, docs.where("doc_id % 20 = 0").select("doc_id"), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return after.select("doc_id", F.col("sha256").isNull().alias("erased"), F.col("deleted_at").isNotNull().alias("deleted"), F.col("purged_at").isNotNull().alias("purged"))


@query
def erased_jobs(spark, sf_dir):
    docs, jobs = _records(spark, sf_dir), _jobs(spark, sf_dir).where("stage = 'purchase'")
    _, _, left = records.erase(docs, docs.select("doc_id"), jobs, docs.where("doc_id % 20 = 0").select("doc_id"), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return left.groupBy("status").agg(F.count("*").alias("n"))


@query
def document_status(spark, sf_dir):
    audit = table(spark, sf_dir, "events").select((F.col("event_id") % 1500).alias("doc_id"), "ts", "event_id", "event_type")
    return records.document_status(_records(spark, sf_dir), audit)


@query
def document_search_ranked(spark, sf_dir):
    """Documents that hold every term of a question, ranked by where they stand."""
    docs = governed_documents(spark, sf_dir).where("deleted_at is null").select("doc_id", "title", F.col("owner_id").alias("filename"), F.col("text").alias("description"))
    return records.search_documents(docs, questions(spark, sf_dir).select("question_id", "question"))


@query
def document_search_stemmed(spark, sf_dir):
    """Documents that hold the stems of all words of a question, from a written index, ranked by field and nearness."""
    docs = governed_documents(spark, sf_dir).where("deleted_at is null").select("doc_id", "title", F.col("owner_id").alias("filename"), F.col("text").alias("description"))
    path = f"{shared_folder(spark)}/document-index-{uuid.uuid4().hex}"
    docsearch.write_document_index(docs, path)
    return docsearch.search_document_index(questions(spark, sf_dir).select("question_id", "question"), path)


@query
def replaced_chunks(spark, sf_dir):
    """A first set of passages (one a document) with the documents of one language chunked anew."""
    docs = table(spark, sf_dir, "documents")
    old = docs.select("doc_id", F.lit(0).alias("chunk_index"), F.length("text").alias("char_count"))
    fresh = _chunks(spark, sf_dir).join(docs.where("lang = 'de'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "chunk_index", "char_count")
    return records.replace_chunks(old, fresh).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("char_count").alias("chars"))


@query
def language_flips(spark, sf_dir):
    """Documents whose language gate turned when the prose floor went from 0.15 to 0.7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", tx.prose_ratio(F.col("text")).alias("r"))
    old = docs.select("doc_id", (F.when(F.col("r") < 0.15, "en").otherwise(F.col("lang")) == "en").alias("live"))
    new = docs.select("doc_id", (F.when(F.col("r") < 0.7, "en").otherwise(F.col("lang")) == "en").alias("live"))
    return records.flips(old, new, "doc_id", "live")


@query
def rendered_tables(spark, sf_dir):
    """Orders of each customer as a sheet: a title row, a header row, and cells as a reader sees them."""
    o = table(spark, sf_dir, "orders")
    cells = F.array(F.col("o_orderkey").cast("string"), grids.date_cell(F.col("o_orderdate").cast("timestamp")), grids.number_cell(F.floor("o_totalprice").cast("double")), F.col("o_orderstatus"))
    sheets = o.select("o_custkey", F.struct("o_orderkey", cells.alias("cells")).alias("s")).groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["cells"]).alias("body"))
    title = F.array(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")), F.lit(""), F.lit(""), F.lit(""))
    header = F.array(*map(F.lit, ("order", "date", "price", "status")))
    return grids.render_tables(sheets.select("o_custkey", F.concat(F.array(title, header), "body").alias("rows")), "o_custkey").select("o_custkey", "group", "rows", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query
def vector_index_recall(spark, sf_dir):
    """Recall of the cell index against the exact arm for every twentieth vector as a question."""
    v = _vectors(spark, sf_dir)
    docs = governed_documents(spark, sf_dir)
    asked = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("question_id"), F.col("embedding").alias("vector"), F.lit("src3").alias("viewer_id"), F.lit(False).alias("is_admin"))
    centres = ann.fit_centroids(v, 16)
    found = ann.search(asked, ann.index(v, centres), docs, centres, 10, 13)
    exact = retrieval.semantic_arm(asked, v.join(docs.where("deleted_at is null").select("doc_id", "classification", "owner_id"), "doc_id"), 10)
    return ann.recall(found, exact)


@query
def stream_user_sessions(spark, sf_dir):
    """Sessions of users, ended by 30 minutes without an event, on a stream; those still open at its end are told too."""
    source = ingest.read_events(spark, sf_dir, "events.parquet").select("user_id", "ts")
    done = spark.read.parquet(ingest.run_to_end(ingest.sessions(source), shared_folder(spark)))
    rows = ingest.batch_events(spark, sf_dir, "events.parquet").select("user_id", "ts")
    return done.unionByName(ingest.still_open(ingest.sessions(rows), rows, "ended", "1 hour"))


@query
def stream_windowed_counts(spark, sf_dir):
    """Hourly counts by type on a stream, each told once its window is closed; those still open at its end are told too."""
    source = ingest.read_events(spark, sf_dir, "events.parquet")
    done = spark.read.parquet(ingest.run_to_end(ingest.windowed_counts(source), shared_folder(spark)))
    rows = ingest.batch_events(spark, sf_dir, "events.parquet")
    open_ = ingest.still_open(ingest.windowed_counts(rows), rows, "window_end", "2 hours")
    return done.unionByName(open_).select("window_start", "event_type", "n")


@query
def stream_first_seen(spark, sf_dir):
    """Users by event type, the first event of each within the watermark, on a stream that delivers every event twice."""
    events = ingest.read_events(spark, sf_dir, "events.parquet").select("event_id", "event_type", "ts")
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = spark.read.parquet(ingest.run_to_end(ingest.first_seen(twice, ["event_id"]).drop("copy"), shared_folder(spark)))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"))


@query
def stream_document_status(spark, sf_dir):
    """document_status with the newest events kept as state of a stream."""
    own = status.state_session(spark, table(spark, sf_dir, "events").count())
    events = ingest.read_events(own, sf_dir, "events.parquet").select((F.col("event_id") % 1500).alias("doc_id"), "ts", "event_id", "event_type")
    return records.with_status(_records(spark, sf_dir), status.follow(spark, events, "doc_id", shared_folder(spark)))


def _coded(spark, sf_dir):
    """(index of product codes over the live vectors, its quantiser, the vectors), 64 cells and 16 bytes a vector."""
    v = stored(_vectors(spark, sf_dir).join(governed_documents(spark, sf_dir).where("deleted_at is null").select("doc_id", "classification", "owner_id"), "doc_id"), "codes-vectors")
    quantiser, path = quantised.fit(v, 64, 16), f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}"
    quantised.write_index(v, quantiser, path)
    return spark.read.schema(quantised.BLOCKS).parquet(path), quantiser, v


@query
def vector_codes_recall(spark, sf_dir):
    """Recall of the index of product codes against the exact arm for every twentieth vector, and the cells it read."""
    blocks, quantiser, v = _coded(spark, sf_dir)
    asked = _vectors(spark, sf_dir).where("doc_id % 20 = 0").select(F.col("doc_id").alias("question_id"), F.col("embedding").alias("vector"), F.lit("src3").alias("viewer_id"), F.lit(False).alias("is_admin"))
    found = stored(quantised.search(asked, blocks, v, quantiser, 10), "codes-found")
    read = found.groupBy("question_id").agg(F.max("cells_read").alias("cells_read"))
    return ann.recall(found, retrieval.semantic_arm(asked, v, 10)).join(read, "question_id", "left")


@query
def hybrid_through_codes(spark, sf_dir):
    """hybrid_semantic_only with the arm through the index of product codes."""
    blocks, quantiser, _ = _coded(spark, sf_dir)
    return _told(_search(spark, sf_dir, limit=10, mode="semantic", arm=quantised.arm(blocks, quantiser)), "fusion_rank")
