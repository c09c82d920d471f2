"""DuckDB SQL that gives the rows of the registered queries, by another road than the DataFrame plans.

Left out are queries whose rules SQL cannot state: packing of passages, findings with offsets and precedence, and
patterns with lookbehind; tests hold those against plain Python.
"""

from __future__ import annotations

from tidewell.functions.text import LEXICAL_STOPWORDS, UNINFORMATIVE
from tidewell.operators.evals import TEMPLATES
from tidewell.plans import catalogue

_GOV = """
lab as (select doc_id, max(toxic) toxic from labels group by doc_id),
gov as (select d.doc_id, d.text, d.lang, d.source owner_id,
  case when toxic = 1 then 'RESTRICTED' when toxic = 0 then 'PUBLIC' end classification, d.doc_id % 17 = 0 deleted,
  array_to_string(list_slice(list_filter(regexp_split_to_array(coalesce(d.text, ''), '\\s+'), lambda t: t <> ''), 1, 6), ' ') title,
  sha256(d.text) sha256
  from documents d left join lab using (doc_id))"""


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_TERMS = "list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_EDGE = r"regexp_replace(regexp_replace({t}, '^[^\p{{L}}\p{{N}}_(]+', ''), '[^\p{{L}}\p{{N}}_).]+$', '')"

#: Questions: the words of each item; edges and function words go before terms are taken.
_ASK = rf"""
q0 as (select item_id question_id, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> ''), ' ') question,
  'src' || (item_id % 20) viewer_id, item_id % 10 = 0 is_admin from benchmark),
ask as (select q0.*, e.embedding v from q0 join embeddings e on e.vec_id = question_id),
kept as (select question_id, question, list_filter(list_transform(list_filter(regexp_split_to_array(question, '\s+'), lambda t: t <> ''),
    lambda t: regexp_replace(regexp_replace(t, '^[^\p{{L}}\p{{N}}_(]+|[^\p{{L}}\p{{N}}_).]+$', '', 'g'), '([^A-Z])\.$', '\1')),
    lambda t: t <> '' and (regexp_full_match(t, '\p{{Lu}}') or lower(t) not in ({_quoted(LEXICAL_STOPWORDS)}))) k from q0),
want as (select distinct question_id, unnest({_TERMS.format(c="case when len(k) >= 2 then array_to_string(k, ' ') else question end")}) term from kept)"""


def _lexical(pool: int, everyone: bool = False, more: str = "") -> str:
    parts = []
    for f in ("text", "title"):
        parts.append(f"""
{f}_t as (select doc_id, {_TERMS.format(c=f)} ts from gov),
{f}_s as (select count(*) n, avg(len(ts)) mean from {f}_t),
{f}_f as (select doc_id, dl, term, count(*) tf from (select doc_id, len(ts) dl, unnest(ts) term from {f}_t) where term in (select term from want) group by all),
{f}_w as (select f.doc_id, f.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) s
  from {f}_f f join (select term, count(*) df from {f}_f group by term) using (term), {f}_s)""")
    may = "true" if everyone else "(is_admin or classification is distinct from 'RESTRICTED' or owner_id = viewer_id)"
    return ",".join(parts) + f""",
score as (select question_id, doc_id, round(sum(s), 9) lexical_score from want join (select * from text_w union all select * from title_w) using (term) group by all),
lex as (select question_id, doc_id, lexical_score, cast(row_number() over (partition by question_id order by lexical_score desc, doc_id) as int) lexical_rank
  from score join ask using (question_id) join gov using (doc_id) where not deleted and {may} {more} qualify lexical_rank <= {pool})"""


def _semantic(pool: int, more: str = "") -> str:
    return f"""
sem as (select question_id, g.doc_id, round(list_dot_product(cast(a.v as double[]), cast(e.embedding as double[])) / (sqrt(list_dot_product(cast(a.v as double[]), cast(a.v as double[]))) * sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[])))), 9) similarity,
  cast(row_number() over (partition by question_id order by similarity desc, g.doc_id) as int) semantic_rank
  from ask a, embeddings e join gov g on g.doc_id = e.vec_id where not deleted and (is_admin or classification is distinct from 'RESTRICTED' or owner_id = viewer_id) {more}
  qualify semantic_rank <= {pool})"""


def _fused(fetch: int, mode: str = "hybrid") -> str:
    both = {
        "hybrid": "select question_id, doc_id, semantic_rank, lexical_rank, similarity from sem full join lex using (question_id, doc_id)",
        "semantic": "select question_id, doc_id, semantic_rank, cast(null as int) lexical_rank, similarity from sem",
        "lexical": "select question_id, doc_id, cast(null as int) semantic_rank, lexical_rank, cast(null as double) similarity from lex",
    }[mode]
    return f"""
fused as (select *, round(coalesce(1.0 / (60 + semantic_rank), 0) + coalesce(1.0 / (60 + lexical_rank), 0), 9) score,
  cast(row_number() over (partition by question_id order by score desc, doc_id) as int) fusion_rank from ({both}) qualify fusion_rank <= {fetch})"""


_TOLD = "question_id, doc_id, round(score, 6) score, semantic_rank, lexical_rank, round(similarity, 6) similarity"
_HYBRID = f"with {_GOV},{_ASK},{_semantic(50)},{_lexical(50)},{_fused(10)}"
_INFORMATIVE = r"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}\p{{M}}_-]+'), lambda t: length(t) > 2 and t not in (" + _quoted(UNINFORMATIVE) + "))"
_GATE = f""",
rows as (select question_id, similarity, {_INFORMATIVE.format(c="question")} wanted, lexical_rank, lower(text) low from fused join gov using (doc_id) join q0 using (question_id)),
per as (select question_id, max(similarity) best, bool_or(len(wanted) > 0 and lexical_rank is not null and len(list_filter(wanted, lambda t: not contains(low, t))) = 0) lit from rows group by 1),
gate as (select question_id, round(best, 6) best_similarity, coalesce(lit, false) literal, coalesce(lit, false) or coalesce(best >= 0.55, false) grounded from ask left join per using (question_id))"""

_JOBS = """jobs as (select event_id job_id, event_id % 1000 doc_id, event_type stage, ['PENDING', 'RUNNING', 'DONE', 'FAILED'][event_id % 4 + 1] status, event_id % 3 priority,
  cast(event_id % 5 as int) retry_count, ts scheduled_at, case when event_id % 4 = 1 then ts + interval 5 minutes end lease_expires_at from events)"""

_ANSWERS = """ans as (select conv_id, turn, text || ' See [' || (conv_id % 7 + 1) || '] and [9] , in ' || (1990 + conv_id % 30) || ' for 12 of 1,02,040.' answer,
  concat_ws(' ', before, 1990 + turn * 3, '102040') context
  from (select *, lag(text) over (partition by conv_id order by turn) before from conversations) where role = 'assistant')"""
_NORM = r"regexp_replace(regexp_replace(replace(lower({c}), ',', ''), '(\d)(st|nd|rd|th)\b', '\1', 'g'), '\s+', ' ', 'g')"
_FILES = """
cust as (select c_custkey file_id, md5(cast(c_custkey as varchar)) md5, cast(c_acctbal as varchar) modified, case when c_nationkey % 5 = 0 then 'RESTRICTED' else 'PUBLIC' end tier from customer),
old as (select *, case when file_id % 13 = 0 then 'REMOVED' when file_id % 17 = 0 then 'SKIPPED' else 'IMPORTED' end state from cust where file_id % 11 <> 0),
new as (select file_id, case when file_id % 9 = 0 then md5('new') when file_id % 10 = 0 then null else md5 end md5, modified, case when file_id % 19 = 0 then 'RESTRICTED' else tier end tier, file_id * 100000 size, file_id % 23 = 0 form from cust where file_id % 7 <> 0),
both_ as (select coalesce(o.file_id, n.file_id) file_id, o.state, o.tier old_tier, n.tier, n.size, n.form, n.file_id is null gone, o.state in ('IMPORTED', 'REMOVED') had,
  case when o.md5 is not null and n.md5 is not null then o.md5 <> n.md5 else o.modified is distinct from n.modified end changed
  from old o full join new n on o.file_id = n.file_id),
acts as (select *, case when gone and ({partial} or state <> 'IMPORTED') then 'KEEP' when gone then 'REMOVE' when had and not changed and state = 'REMOVED' then 'RESTORE'
  when had and not changed and old_tier is distinct from tier then 'RECLASSIFY' when had and not changed then 'UNCHANGED' when form then 'SKIP' when size > 104857600 then 'SKIP'
  when had and state = 'IMPORTED' then 'EDIT' else 'IMPORT' end act from both_)"""

_FIGURE = r"(?:^|[^\w.])((?:\d{{1,3}}(?:,\d{{2,3}})+(?:\.\d+)?|\d+\.\d+|\d{{4,}}|\d{{1,3}}(?:st|nd|rd|th)?))(?:$|[^\w])"
#: Blanks are doubled so that a boundary that one match takes is still there for the next.
_FIDELITY = rf"""with {_ANSWERS}, p as (select *, regexp_extract_all(replace(regexp_replace(answer, '\[\d+\]', ' ', 'g'), ' ', '  '), '{_FIGURE.format()}', 1) found from ans),
f as (select *, list_distinct(list_filter(list_transform(found, lambda x: {_NORM.format(c="x")}), lambda x: not regexp_full_match(x, '[0-9]|10'))) nums, list_filter(nums, lambda x: contains({_NORM.format(c="context")}, x)) ok from p)"""

def _template_sql() -> str:
    """Every pattern's first match as a question; of equal questions the one of the smallest document."""
    parts = []
    for k, (pattern, question, tests) in enumerate(TEMPLATES):
        before, after = question.split("{0}")
        parts.append(f"select doc_id, {k} k, '{before}' || trim(regexp_extract(text, '{pattern}', 1)) || '{after}' question, '{tests}' tests from gov where trim(regexp_extract(text, '{pattern}', 1)) <> ''")
    parts.append(r"select doc_id, 99, 'What does the corpus say about ' || trim(title) || '?', 'a section heading' from gov where length(trim(title)) between 9 and 89 and not regexp_matches(trim(title), '^\p{Nd}')")
    return f"with {_GOV}, m as ({' union all '.join(parts)}) select doc_id, question, tests from m qualify row_number() over (partition by lower(question) order by doc_id, question, tests) = 1"


ORACLE_SQL: dict[str, str] = {
    "visible_documents_user": f"with {_GOV} select doc_id, owner_id, classification from gov where not deleted and (classification is distinct from 'RESTRICTED' or owner_id = 'src3')",
    "visible_documents_anon": f"with {_GOV} select doc_id, owner_id, classification from gov where not deleted and classification is distinct from 'RESTRICTED'",
    "visible_documents_admin": f"with {_GOV} select doc_id, owner_id, classification from gov where not deleted",
    "document_page_with_total": f"with {_GOV}, seen as (select doc_id, owner_id from gov where not deleted and (classification is distinct from 'RESTRICTED' or owner_id = 'src3')) select doc_id, owner_id, (select count(*) from seen) total from seen order by doc_id desc limit 20 offset 20",
    "restorable_documents": f"with {_GOV} select doc_id, owner_id from gov where deleted and doc_id % 34 <> 0 and doc_id % 6 <> 0 and doc_id % 11 <> 0 and owner_id = 'src3' order by doc_id desc limit 50",
    "semantic_topk": f"with {_GOV},{_ASK},{_semantic(10)} select question_id, doc_id, round(similarity, 6) similarity, semantic_rank from sem",
    "bm25_postings": f"select term, count(*) df, cast(sum(tf) as bigint) cf, max(tf) max_tf from (select doc_id, term, count(*) tf from (select doc_id, unnest({_TERMS.format(c='text')}) term from documents) group by all) group by term",
    "bm25_topk": f"with {_GOV},{_ASK},{_lexical(10)} select question_id, doc_id, round(lexical_score, 6) lexical_score, lexical_rank from lex",
    "bm25_indexed_topk": f"with {_GOV},{_ASK},{_lexical(10)} select question_id, doc_id, round(lexical_score, 6) lexical_score, lexical_rank from lex",
    "hybrid_rrf": f"{_HYBRID} select {_TOLD}, fusion_rank from fused",
    "hybrid_semantic_only": f"with {_GOV},{_ASK},{_semantic(50)},{_fused(10, 'semantic')} select {_TOLD}, fusion_rank from fused",
    "hybrid_lexical_only": f"with {_GOV},{_ASK},{_lexical(50)},{_fused(10, 'lexical')} select {_TOLD}, fusion_rank from fused",
    "hybrid_scoped": f"with {_GOV},{_ASK},{_semantic(50, more='and g.owner_id = a.viewer_id')},{_lexical(50, more='and owner_id = viewer_id')},{_fused(10)} select {_TOLD}, fusion_rank from fused",
    "grounding_scoped": f"with {_GOV},{_ASK},{_semantic(50, more='and g.owner_id = a.viewer_id')},{_lexical(50, more='and owner_id = viewer_id')},{_fused(10)}{_GATE} select question_id, best_similarity, grounded or question_id in (select question_id from fused) grounded from gate",
    "rerank_overlap": f"""with {_GOV},{_ASK},{_semantic(200)},{_lexical(200)},{_fused(50)},
r as (select fused.*, list_distinct({_INFORMATIVE.format(c="question")}) w, lower(text[1:900]) head from fused join gov using (doc_id) join q0 using (question_id)),
s as (select *, round(case when len(w) = 0 then 0 else len(list_filter(w, lambda t: contains(head, t))) / len(w) end, 6) rerank_score from r)
select {_TOLD}, rerank_score, cast(row_number() over (partition by question_id order by rerank_score desc, fusion_rank) as int) position from s qualify position <= 10""",
    "grounding_gate": f"{_HYBRID}{_GATE} select * from gate",
    "grounded_results": f"{_HYBRID}{_GATE} select {_TOLD}, fusion_rank from fused where question_id in (select question_id from gate where grounded)",
    "token_usage_rollup": f"{_HYBRID} select question_id, cast(sum(least(n, 512)) as bigint) context_tokens, count(*) filter (n > 512) truncated_results, cast(sum(greatest(n - 512, 0)) as bigint) truncated_tokens, count(semantic_rank) semantic_hits, count(lexical_rank) lexical_hits from (select fused.*, greatest(1, length(text) // 4) n from fused join gov using (doc_id)) group by question_id",
    "document_metadata_search": f"with {_GOV},{_ASK} select question_id, count(*) hits, max(doc_id) newest from q0 join gov on contains(lower(concat_ws(chr(1), title, owner_id, text)), lower(question)) where question <> '' group by question_id",
    "eval_hit_at_k": f"""with {_GOV}, it as (select item_id question_id, {_TERMS.format(c="text")} ts, least(8, len(ts)) k from benchmark where len({_TERMS.format(c="text")}) > 0),
keys as (select distinct question_id, k, array_to_string(list_slice(ts, i, i + k - 1), ' ') run from it, lateral (select unnest(range(1, len(ts) - k + 2)) i)),
runs as (select doc_id, n, array_to_string(list_slice(ts, i, i + n - 1), ' ') run from (select doc_id, {_TERMS.format(c="text")} ts from gov where not deleted), (select distinct k n from keys), lateral (select unnest(range(1, len(ts) - n + 2)) i)),
want_docs as (select distinct question_id, doc_id from runs join keys on runs.run = keys.run and n = k),{_ASK},{_lexical(10, everyone=True)},
r as (select question_id, min(lexical_rank) k from (select distinct question_id from want_docs) left join (lex join want_docs using (question_id, doc_id)) using (question_id) group by 1)
select count(*) n, round(avg(case when k = 1 then 1.0 else 0.0 end), 6) hit_at_1, round(avg(case when k <= 5 then 1.0 else 0.0 end), 6) hit_at_5, round(avg(case when k is not null then 1.0 else 0.0 end), 6) hit_at_k, round(avg(coalesce(1.0 / k, 0.0)), 6) mrr from r""",
    "eval_candidates": r"""select source owner_id, doc_id, cast(row_number() over (partition by source order by md5('5077:' || doc_id), doc_id) as int) place from documents
where doc_id % 17 <> 0 and doc_id % 6 <> 0 and doc_id % 11 <> 0 and doc_id % 13 <> 0 and length(text) between 320 and 2400 and coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda t: length(t) >= 3 and not regexp_matches(t, '\p{Nd}')), lambda t: length(t))), 0) / length(text) >= 0.45 qualify place <= 3""",
    "quality_gate": "select source, case when length(coalesce(text, '')) = 0 then 'EMPTY_TEXT' when length(text) < 50 then 'LOW_TEXT_DENSITY' else '' end failures, count(*) n from documents group by all",
    "prose_ratio": r"select doc_id, round(case when length(coalesce(text, '')) = 0 then 0 else coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda t: length(t) >= 3 and not regexp_matches(t, '\p{Nd}')), lambda t: length(t))), 0) / length(text) end, 6) ratio from documents",
    "effective_language": r"with r as (select lang, case when length(coalesce(text, '')) = 0 then 0 else coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda t: length(t) >= 3 and not regexp_matches(t, '\p{Nd}')), lambda t: length(t))), 0) / length(text) end ratio from documents), e as (select lang, case when ratio < 0.15 then 'en' else lang end effective from r) select lang, effective, count(*) n, count(*) filter (effective <> 'en') skipped from e group by all",
    "split_paragraphs": r"with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda p: trim(p, e' \t\n\r')), lambda p: p <> '') p from documents) select doc_id, cast(len(p) as int) paragraphs, cast(coalesce(list_max(list_transform(p, lambda x: length(x))), 0) as int) longest from p",
    "split_sentences": r"with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', e'\\1\x01', 'g'), e'\x01'), lambda s: trim(s)), lambda s: s <> '') s from documents) select doc_id, cast(len(s) as int) sentences, cast(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) as int) longest from s",
    "heading_levels": r"""with h as (select page_id, unnest(regexp_extract_all(html, '(?is)(<h[1-6][^>]*>.*?</h[1-6]>)')) raw, generate_subscripts(regexp_extract_all(html, '(?is)(<h[1-6][^>]*>.*?</h[1-6]>)'), 1) - 1 place from pages),
t as (select page_id, place, 26 - 2 * cast(regexp_extract(raw, '(?i)^<h([1-6])', 1) as int) size, trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) txt from h
 union all select page_id, -1, 10, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) from pages),
b as (select page_id, arg_max(size, (chars, size)) body from (select page_id, size, sum(length(txt)) chars from t group by all) group by page_id),
l as (select page_id, size, row_number() over (partition by page_id order by size desc) level from (select distinct t.page_id, size from t join b using (page_id) where size >= body * 1.15))
select page_id, cast(place as int) place, cast(level as int) level, cast(length(txt) as int) chars from t join l using (page_id, size) where length(txt) <= 120""",
    "words_in_cells": """with p as (select p_partkey % 50 page, p_partkey k, 'w' || p_partkey word, p_partkey % 37 * 7.0 x1, p_partkey % 23 * 11.0 y1 from part),
c as (select page, c cell, c % 8 * 32.0 cx1, c // 8 * 44.0 cy1 from (select distinct page from p), range(48) r(c))
select page, cast(cell as int) cell, string_agg(word, ' ' order by y1, x1, word) "text" from p join c using (page)
where least(x1 + 12, cx1 + 32) - greatest(x1, cx1) >= 0.8 * 12 and least(y1 + 8, cy1 + 44) - greatest(y1, cy1) >= 0.5 * 8 group by page, cell""",
    "find_emails": r"select doc_id, count(*) n, count(distinct email) \"values\", min(email) \"first\" from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.[A-Za-z]{2,}')) email from documents) group by doc_id".replace('\\"', '"'),
    "mask_preview": r"""with w as (select doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda t: contains(t, '@'))) w from documents), p as (select doc_id, w[1:strpos(w, '@') - 1] l, w[strpos(w, '@') + 1:] d from w),
h as (select *, case when length(l) > 4 then l[1:3] else '' end h from p) select doc_id, h || repeat('x', greatest(3, length(l) - length(h))) || '@' || d preview, count(*) n from h group by all""",
    "boundary_record": f"with {_GOV} select owner_id, count(*) considered, count(*) filter (classification = 'PUBLIC') sent, count(*) filter (classification is distinct from 'PUBLIC') withheld, 'PUBLIC' tier, count(*) filter (classification = 'PUBLIC') = 0 refused from gov where not deleted group by owner_id",
    "answer_context": f"with {_GOV},{_ASK},{_lexical(40)},{_fused(8, 'lexical')}, m as (select question_id, count(*) passages, string_agg('[' || fusion_rank || '] (' || title || ')' || chr(10) || text, chr(10) || chr(10) order by fusion_rank) c from fused join gov using (doc_id) group by 1) select question_id, passages, cast(length(c) as int) chars, md5(c) digest from m",
    "citation_check": rf"""with {_ANSWERS}, m as (select *, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: cast(x as bigint)))) ms from ans),
v as (select *, list_filter(ms, lambda n: n between 1 and 5) ok, list_filter(ms, lambda n: n not between 1 and 5) bad from m)
select conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(answer, '\[([6-9]|\d\d+|0)\]', '', 'g'), ' {{2,}}', ' ', 'g'), ' +([.,;:])', '\1', 'g'))) digest, array_to_string(ok, ',') valid, array_to_string(bad, ',') invalid from v""",
    "citation_coverage": rf"""with {_ANSWERS}, s as (select conv_id, turn, list_filter(list_transform(regexp_split_to_array(regexp_replace(answer, '([.!?])\s+', e'\\1\x01', 'g'), e'\x01'), lambda s: trim(s)), lambda s: length(s) >= 25) s from ans)
select conv_id, turn, cast(len(s) as int) sentences, cast(len(list_filter(s, lambda x: regexp_matches(x, '\[\d+\]'))) as int) cited from s""",
    "quote_fidelity": rf"""with {_ANSWERS}, a as (select conv_id, turn, context, [context[1:40], reverse(context[1:30])] q from ans), k as (select *, list_filter(list_transform(q, lambda x: trim(x)), lambda x: length(x) >= 25) kept from a)
select conv_id, turn, cast(len(kept) as int) quotes, cast(len(list_filter(kept, lambda x: contains({_NORM.format(c="context")}, {_NORM.format(c="x")}))) as int) verbatim from k""",
    "hedged_answers": "select turn, count(*) n, count(*) filter (regexp_matches(lower(text), 'do not|does not|no mention|not mention|not specify|cannot|no information')) hedged from conversations where role = 'assistant' group by turn",
    "followup_expand": r"""with u as (select conv_id, turn, trim(coalesce(text, '')) question from conversations where role = 'user'), b as (select *, lag(question) over (partition by conv_id order by turn, question) before, lower(question) low from u),
f as (select *, coalesce(before, '') <> '' and question <> '' and (len(regexp_split_to_array(low, '\s+')) <= 3
  or regexp_matches(low, '^(what about|and what|and the|what of|how about|and how|is it|are they|are these|does it|do they|did it|was it|why is|why are|why did|when is|when did|who is|who are|and|but|also|then|so) ')
  or (len(regexp_split_to_array(low, '\s+')) < 8 and regexp_matches(low, '\b(it|its|they|them|their|this|that|these|those|the same|above|there)\b'))) expanded from b)
select conv_id, turn, expanded, md5(case when expanded then before || ' ' || question else question end) digest from f""",
    "dedup_canonical": "with d as (select doc_id, text, doc_id % 6 <> 0 and doc_id % 11 <> 0 live from documents), c as (select *, min(doc_id) filter (live) over (partition by text) \"first\" from d) select doc_id, case when text is null then doc_id else \"first\" end canonical_id, coalesce(live and text is not null and doc_id <> \"first\", false) is_duplicate from c",
    "tier_escalation": f"""with {_GOV}, l as (select *, doc_id % 6 <> 0 and doc_id % 11 <> 0 live from gov where text is not null),
g as (select min(doc_id) filter (live) canonical_id, count(*) copies, bool_or(classification = 'RESTRICTED') r, bool_or(classification = 'PUBLIC') p, arg_min(coalesce(classification, '-'), doc_id) filter (live) was from l group by text)
select canonical_id, copies, case when r then 'RESTRICTED' when p then 'PUBLIC' end tier, coalesce(case when r then 'RESTRICTED' when p then 'PUBLIC' end, '-') <> was escalated from g where copies > 1 and canonical_id is not null""",
    "version_chain": "select o_custkey, o_orderkey, cast(row_number() over w as int) as version, lag(o_orderkey) over w as supersedes, case when lead(o_orderkey) over w is null then 'LIVE' else 'SUPERSEDED' end as status from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
    "orders_by_priority": "select o_orderpriority, o_orderkey, cast(row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderdate, o_orderkey) as int) place from orders where o_orderstatus = 'O' qualify place <= 3",
    "stream_user_sessions": """with e as (select user_id, ts, ts >= lag(ts) over w + interval 30 minutes as gap from events window w as (partition by user_id order by ts)),
s as (select *, sum(case when coalesce(gap, true) then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) k from e)
select user_id, min(ts) began, max(ts) + interval 30 minutes ended, count(*) events from s group by user_id, k""",
    "stream_windowed_counts": "select date_trunc('hour', ts) window_start, event_type, count(*) n from events group by all",
    "audit_latest": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "audit_first_occurrence": "select user_id, event_type, event_id from events qualify event_type = 'click' or row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
    "backfill_candidates": f"with {_JOBS} select doc_id from documents where doc_id % 17 <> 0 and not exists (select 1 from jobs where jobs.doc_id = documents.doc_id and stage = 'purchase' and status in ('PENDING', 'RUNNING'))",
    "batch_status_rollup": "select o_orderpriority, o_orderstatus, count(*) n from orders group by all",
    "upload_limits": "with f as (select o_custkey || '-' || year(o_orderdate) batch, cast(trunc(o_totalprice * 500) as bigint) size from orders) select batch, count(*) files, cast(sum(size) as bigint) bytes, count(*) <= 5 and sum(size) <= 262144000 and max(size) <= 104857600 and min(size) > 0 accepted from f group by batch",
    "folder_tiers": "select 'r' || r_regionkey folder, 'PUBLIC' tier from region union all select 'n' || n_nationkey, case when n_nationkey in (3, 7, 11) then 'RESTRICTED' else 'PUBLIC' end from nation union all select 'c' || c_custkey, case when c_nationkey in (3, 7, 11) then 'RESTRICTED' else 'PUBLIC' end from customer",
    "drive_diff": f"with {_FILES.format(partial='false')} select file_id, act \"action\", case when gone then old_tier when act = 'EDIT' and old_tier is not distinct from tier then old_tier else tier end tier from acts",
    "drive_diff_partial": f"with {_FILES.format(partial='true')} select act \"action\", case when gone then old_tier else tier end tier, count(*) n from acts group by all",
    "drive_reconcile": """with v as (select o_custkey file_id, o_orderkey document_id, o_orderdate at_, case when o_orderkey % 3 = 0 then 'CURRENT' else 'PENDING' end state,
 case when o_orderkey % 7 = 0 then 'DUPLICATE' when o_orderkey % 5 = 0 then 'EXTRACTION_FAILED' when o_orderkey % 4 = 0 then 'CHUNKED' else 'LIVE' end status from orders),
s as (select *, case when state = 'PENDING' and status = 'DUPLICATE' then 'DUPLICATE' when state = 'PENDING' and status = 'EXTRACTION_FAILED' then 'FAILED' else state end settled, row_number() over (partition by file_id order by at_ desc, document_id desc) k from v),
l as (select *, bool_or(k = 1 and settled = 'PENDING' and status = 'LIVE') over (partition by file_id) live from s)
select file_id, document_id, state, status, case when live and k = 1 then 'CURRENT' when live and settled in ('CURRENT', 'PENDING') then 'SUPERSEDED' else settled end new_state from l""",
    "next_sync_slot": """with e as (select user_id, ts from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1), l as (select *, ts + interval 330 minutes loc from e), s as (select *, date_trunc('day', loc) + interval 150 minutes slot from l)
select user_id, cast(case when user_id % 4 = 0 then ts + interval 3600 seconds else case when slot <= loc then slot + interval 1 day else slot end - interval 330 minutes end as timestamp) due from s""",
    "stream_ingest_counts": "select event_type, date_trunc('day', ts) \"day\", count(*) n from events group by all",
    "reclassify_decisions": f"with {_GOV} select doc_id, case when classification = 'RESTRICTED' and owner_id <> 'src3' then 404 when owner_id <> 'src3' then 403 when doc_id % 34 = 0 then 410 when classification = 'RESTRICTED' then 409 else 200 end code from gov",
    "delete_decisions": f"with {_GOV} select doc_id, case when classification = 'RESTRICTED' and owner_id <> 'src3' then 404 when owner_id <> 'src3' then 403 when doc_id % 34 = 0 then 404 when doc_id % 5 = 0 then 409 else 200 end code from gov",
    "restore_decisions": f"with {_GOV} select doc_id, case when classification = 'RESTRICTED' and owner_id <> 'src3' then 404 when owner_id <> 'src3' then 403 when doc_id % 34 = 0 then 410 when doc_id % 17 <> 0 or (doc_id % 11 = 0 and doc_id % 6 <> 0) or doc_id % 7 = 0 then 409 else 200 end code from gov",
    "erasure": f"""with {_GOV}, {_JOBS}, going as (select doc_id, sha256 from gov where doc_id % 20 = 0 and doc_id % 34 <> 0 and not exists (select 1 from jobs where jobs.doc_id = gov.doc_id and stage = 'purchase' and status = 'RUNNING')),
h as (select doc_id, deleted, sha256, doc_id in (select doc_id from going) or (doc_id % 6 = 0 and sha256 in (select sha256 from going)) hit from gov)
select doc_id, hit or sha256 is null erased, deleted or hit "deleted", hit or doc_id % 34 = 0 purged from h""",
    "erased_jobs": f"""with {_GOV}, {_JOBS}, p as (select * from jobs where stage = 'purchase'), going as (select doc_id from gov where doc_id % 20 = 0 and doc_id % 34 <> 0 and doc_id not in (select doc_id from p where status = 'RUNNING'))
select case when status = 'PENDING' and doc_id in (select doc_id from going) then 'FAILED' else status end status, count(*) n from p group by 1""",
    "document_status": f"""with {_GOV}, d as (select *, case when doc_id % 6 = 0 then 'DUPLICATE' when doc_id % 11 = 0 then 'SUPERSEDED' else 'LIVE' end status from gov),
e as (select event_id % 1500 doc_id, event_type, event_id from events qualify row_number() over (partition by event_id % 1500 order by ts desc, event_id desc) = 1), a as (select sha256, min(doc_id) active_id from d where status = 'LIVE' group by sha256)
select doc_id, status, event_type last_event, event_id, case when status = 'DUPLICATE' then active_id end duplicate_of from d left join e using (doc_id) left join a using (sha256)""",
    "document_search_ranked": f"""with {_GOV},{_ASK}, w as (select question_id, list_distinct({_TERMS.format(c="question")}) ts from q0), t as (select question_id, len(ts) n, unnest(ts) term from w),
h as (select doc_id, term, sum(wt) wt from (select distinct doc_id, 1.0 wt, 1 f, unnest({_TERMS.format(c="title")}) term from gov where not deleted union all select distinct doc_id, 0.4, 2, unnest({_TERMS.format(c="owner_id")}) from gov where not deleted union all select distinct doc_id, 0.2, 3, unnest({_TERMS.format(c="text")}) from gov where not deleted) where term in (select term from t) group by all)
select question_id, doc_id, round(cast(sum(wt) as double), 6) "rank" from t join h using (term) group by question_id, doc_id, n having count(*) = n""",
    "language_flips": r"""with r as (select lang, case when length(coalesce(text, '')) = 0 then 0 else coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda t: length(t) >= 3 and not regexp_matches(t, '\p{Nd}')), lambda t: length(t))), 0) / length(text) end x from documents)
select x < 0.15 or lang = 'en' "before", x < 0.7 or lang = 'en' "after", count(*) n from r group by all""",
    "eval_question_templates": _template_sql(),
    "stream_first_seen": "select event_type, count(*) n, count(distinct event_id) events from events group by event_type",
    "lexical_trim": rf"""with u as (select conv_id, turn, text from conversations where role = 'user'),
k as (select *, list_filter(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> ''),
  lambda t: regexp_replace(regexp_replace(t, '^[^\p{{L}}\p{{N}}_(]+|[^\p{{L}}\p{{N}}_).]+$', '', 'g'), '([^A-Z])\.$', '\1')),
  lambda t: t <> '' and (regexp_full_match(t, '\p{{Lu}}') or lower(t) not in ({_quoted(LEXICAL_STOPWORDS)}))) k from u)
select conv_id, turn, case when len(k) >= 2 then array_to_string(k, ' ') else text end searched, array_to_string({_INFORMATIVE.format(c="coalesce(text, '')")}, ' ') informative from k""",
    "numeric_fidelity": _FIDELITY + " select conv_id, turn, cast(len(nums) as int) checked, cast(len(ok) as int) supported, round(len(ok) / nullif(len(nums), 0), 6) fidelity from f",
    "fidelity_rollup": _FIDELITY + rf""", s as (select list_filter(list_transform(regexp_split_to_array(regexp_replace(answer, '([.!?])\s+', e'\\1\x01', 'g'), e'\x01'), lambda s: trim(s)), lambda s: length(s) >= 25) s from ans),
n as (select cast(sum(len(nums)) as bigint) checked, cast(sum(len(ok)) as bigint) supported from f), c as (select cast(sum(len(s)) as bigint) sentences, cast(sum(len(list_filter(s, lambda x: regexp_matches(x, '\[\d+\]')))) as bigint) cited from s)
select checked, supported, sentences, cited, round(supported / nullif(checked, 0), 6) "numeric", round(cited / nullif(sentences, 0), 6) coverage from n, c""",
    "clean_text_profile": r"""with a as (select doc_id, regexp_replace(translate(translate(coalesce(text, ''), chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(173), ''), chr(11) || chr(12), chr(10) || chr(10)), '[\x00-\x08\x0E-\x1F\x7F]', '', 'g') t from documents),
b as (select doc_id, regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '(?im)^[ \t]*(?:cont(?:d|inued)?\.*[ \t.]*(?:p(?:age|\.)?[ \t.]*)?\d{0,3}[ \t]*/?-?|[-–—][ \t]*\d{1,3}[ \t]*[-–—]|page[ \t]+\d{1,4}(?:[ \t]+of[ \t]+\d{1,4})?)[ \t]*(?:\n|\z)', '', 'g') t from a),
c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([\p{L}\p{N}_])-\n([a-z])', '\1\2', 'g'), '[ \t]{2,}', ' ', 'g'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') t from b),
d as (select doc_id, trim(t, e' \t\n\r') t from c) select doc_id, cast(length(t) as int) chars, md5(t) digest from d""",
}
ORACLE_SQL["questions_of_documents"] = f"select doc_id, count(*) questions from ({ORACLE_SQL['eval_question_templates']}) group by doc_id"
ORACLE_SQL |= catalogue.ORACLE_SQL
ORACLE_SQL["report_round_trip"] = ORACLE_SQL["batch_status_rollup"]
ORACLE_SQL["stream_document_status"] = ORACLE_SQL["document_status"]
