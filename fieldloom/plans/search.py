"""Queries over the index: statistics, scoring, fusion, cuts, linked parts, upkeep; with their SQL.

Questions are the reported issues of every order whose id is divisible by 50, asked of all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.config import RetrievalConfig
from fieldloom.functions import text as T
from fieldloom.functions import vector as V
from fieldloom.operators import index, retrieval
from fieldloom.plans import sqltext as S
from fieldloom.session import spread, table

EVERY = 50
TOP = 20


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_documents")


def index_for(x: DataFrame, asked: DataFrame) -> retrieval.Index:
    return retrieval.asked_index(x, retrieval.query_terms(asked))


def questions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "work_orders").where((F.col("record_id") % EVERY == 0) & (T.clean_string(F.col("reported_issue")) != ""))
    return o.select(F.col("record_id").alias("query_id"), F.col("reported_issue").alias("query"))


_ASKED = f"SELECT record_id AS query_id, reported_issue AS query FROM work_orders WHERE record_id % {EVERY} = 0 AND trim(reported_issue) <> ''"


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return spread(docs(spark, d).select("doc_id", "text"), spark).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"))


def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Every posting, a row each; index.inverted_index gathers them by term."""
    return index.postings(index.document_fields(spread(docs(spark, d), spark))).select("term", "doc_id", "field", "tf", "field_weight", "field_length")


def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    return index.average_lengths(index.document_fields(spread(docs(spark, d), spark))).select("field", F.round("avg_len", 6).alias("avg_len"))


def document_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return index.document_counts(docs(spark, d))


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return index.document_frequencies(index.postings(index.document_fields(spread(docs(spark, d), spark))))


def query_term_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each question in order of first occurrence."""
    q = questions(spark, d).select("query_id", F.posexplode(T.unique_terms(T.tokens(F.col("query")))).alias("pos", "term"))
    return q.groupBy("query_id").agg(F.count("*").alias("terms"), F.max_by("term", "pos").alias("last_term"), F.min_by("term", "pos").alias("first_term"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(index_for(docs(spark, d), questions(spark, d)), ["work_order"], TOP)


def bm25_matched_terms(spark: SparkSession, d: str) -> DataFrame:
    """What matched in each question's best order, a row per term and field."""
    ix = index_for(docs(spark, d), questions(spark, d))
    best = retrieval.bm25(ix, ["work_order"], 1)
    m = retrieval.matched_terms(ix, best)
    return m.select("query_id", "doc_id", F.explode("matched_terms").alias("m")).select("query_id", "doc_id", "m.term", "m.field", "m.tf", "m.field_weight")


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _embeddings(spark, d).where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_search(_vectors(spark, d), _embeddings(spark, d), 10).select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "score", "rank")


_VEC = f"""
 e AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
 vp AS (SELECT a.doc_id AS query_id, b.doc_id, 1 - list_cosine_similarity(a.v, b.v) AS distance FROM e a JOIN e b ON a.doc_id % {EVERY} = 0),
 vec AS (SELECT *, round(1 / (1 + distance), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM vp) WHERE rank <= 10)
"""


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """The documents table as searchable documents of one type, title and text as fields."""
    n = table(spark, d, "documents")
    fields = F.map_from_arrays(F.array(F.lit("fault_title"), F.lit("chunk_text")), F.array(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    return n.select("doc_id", F.lit("note").alias("doc_type"), fields.alias("fields"))


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Questions are titles of notes; their vectors are those of the embeddings table with the same id."""
    n = _notes(spark, d)
    asked = table(spark, d, "documents").where((F.col("doc_id") % EVERY == 0) & F.col("title").isNotNull()).select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    bm = retrieval.bm25(index_for(n, asked), ["note"], TOP)
    vec = retrieval.vector_search(_vectors(spark, d).join(asked.select("query_id"), "query_id", "left_semi"), _embeddings(spark, d), 10)
    return retrieval.fuse(bm, vec, TOP, 0.75).select("query_id", "doc_id", "score", "rank")


_NOTES = "(SELECT doc_id, 'note' AS doc_type, map(['fault_title', 'chunk_text'], [coalesce(title, ''), coalesce(text, '')]) AS fields FROM documents)"
_HYBRID = f"""WITH {S.field_ctes(_NOTES)}, {S.question_ctes(f"SELECT doc_id AS query_id, title AS query FROM documents WHERE doc_id % {EVERY} = 0 AND title IS NOT NULL")},
 {S.bm25_ctes("note", "bm", _NOTES)}, {S.top_ctes("bm", "bmt", TOP)}, {_VEC},
 va AS (SELECT * FROM vec WHERE query_id IN (SELECT query_id FROM asked)),
 x AS (SELECT query_id, doc_id, 0.75 * score / CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY query_id) END AS s FROM bmt),
 y AS (SELECT query_id, doc_id, 0.25 * score / CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY query_id) END AS s FROM va),
 z AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.s, 0) + coalesce(y.s, 0) AS raw FROM x FULL JOIN y ON x.query_id = y.query_id AND x.doc_id = y.doc_id),
 {S.top_ctes("z", "r", TOP)} SELECT * FROM r"""


def relative_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The order channel as it is returned: 50 candidates, cut at 45 % of the best score, at most 10."""
    x = docs(spark, d)
    return retrieval.search_channel("work_orders", x, index_for(x, questions(spark, d)), RetrievalConfig()).drop("mode")


def typical_fault_search(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return retrieval.search_channel("manual_typical_faults", x, index_for(x, questions(spark, d)), RetrievalConfig()).drop("mode")


def _code_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where((F.col("doc_id") % EVERY == 0) & F.col("text").isNotNull()).select(F.col("doc_id").alias("query_id"), F.concat(F.lit("code "), F.coalesce("fault_code", F.lit("none"))).alias("query"))


_CODES = f"SELECT doc_id AS query_id, 'code ' || coalesce(fault_code, 'none') AS query FROM documents WHERE doc_id % {EVERY} = 0 AND text IS NOT NULL"
_EXACT = f"""
 ex AS (SELECT query_id, doc_id, 100.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM (SELECT DISTINCT query_id, doc_id FROM asked
   JOIN index_documents ON doc_type = 'manual_fault_code' AND upper(fields['fault_code']) = upper(regexp_extract(query, '^code ([A-Za-z][0-9]{{3,}}[A-Za-z0-9_-]*)$', 1)))),
 exact AS (SELECT * FROM ex WHERE rank <= 8)
"""


def fault_code_exact(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fault_code_hits(_code_questions(spark, d), docs(spark, d), 8)


def fault_code_search(spark: SparkSession, d: str) -> DataFrame:
    x, q = docs(spark, d), _code_questions(spark, d)
    return retrieval.search_fault_codes(x, index_for(x, q), q, RetrievalConfig())


def rank_ordered_parts(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.retrieve(docs(spark, d), table(spark, d, "part_evidence"), questions(spark, d), channels=("work_orders",))
    return found["part_evidence"].select("query_id", "work_order_id", F.col("order_rank").cast("bigint").alias("order_rank"), "part_id", "part_code", "quantity")


def evidence_flatten(spark: SparkSession, d: str) -> DataFrame:
    """The first eight pieces of evidence of each question, of all four channels, with titles."""
    found = retrieval.retrieve(docs(spark, d), table(spark, d, "part_evidence"), questions(spark, d))
    titled = {c: found[c].join(docs(spark, d).select("doc_id", "title"), "doc_id") for c in retrieval.CHANNELS} | {"part_evidence": retrieval.part_hits(found["part_evidence"])}
    return retrieval.flatten(titled, 8).select("query_id", "channel", "doc_id", "title", "score", "channel_rank", "rank")


def evidence_package(spark: SparkSession, d: str) -> DataFrame:
    """The package of each question: its hits by channel, its linked orders, how the parts came, and warnings."""
    q, events, config = questions(spark, d), [], RetrievalConfig()
    found = retrieval.retrieve(docs(spark, d), table(spark, d, "part_evidence"), q, config, events=events)
    got = retrieval.package(found, q, config, 8, events)
    ids = [F.array_join(F.transform(c, lambda x: x["doc_id"]), ",").alias(c) for c in (*retrieval.CHANNELS, "part_evidence")]
    return got.select("query_id", "mode", F.array_join(F.map_values("channel_modes"), ",").alias("channel_modes"), "top_k", *ids, F.array_join("linked_work_order_ids", ",").alias("linked"), F.col("part_candidate_source.work_order_hit_count").alias("order_hits"), F.size("warnings").alias("warnings"))


def threshold_events(spark: SparkSession, d: str) -> DataFrame:
    """What the order channel's cut did to each question's candidates."""
    x, held = docs(spark, d), {}
    found = retrieval.search(x, index_for(x, questions(spark, d)), RetrievalConfig(), ("work_orders",), candidates=held)
    e = retrieval.threshold_events(held["work_orders"], found["work_orders"], "work_orders", RetrievalConfig(), 8)
    return e.select("query_id", "candidate_count", "returned_count", "candidate_top_k", "top_score", "score_threshold", "max_hits")


def part_channel(spark: SparkSession, d: str) -> DataFrame:
    """Linked parts as hits: rank, title and preview."""
    found = retrieval.retrieve(docs(spark, d), table(spark, d, "part_evidence"), questions(spark, d), channels=("work_orders",))
    return retrieval.part_hits(found["part_evidence"]).select("query_id", "doc_id", "rank", "title", "body_preview", F.col("metadata")["part_code"].alias("part_code"))


_BASE = f"WITH {S.field_ctes()}, {S.question_ctes(_ASKED)}, {S.bm25_ctes('work_order')}"
_CUT = f"{_BASE}, {S.top_ctes('bm', 'bmt', 50)}, {S.cut_ctes('bmt', 'cut', 0.45, 10)}"
_TYPICAL = f"{S.bm25_ctes('manual_typical_fault', 'tf')}, {S.top_ctes('tf', 'tft', 30)}, {S.cut_ctes('tft', 'tcut', 0.55, 5)}"

#: of the hit orders the parts, as hits; typical faults and codes that questions name in their text
_PARTS = f"""h AS (SELECT query_id, metadata['work_order_id'] AS work_order_id, min(rank) AS order_rank FROM cut JOIN index_documents USING (doc_id) WHERE metadata['work_order_id'] <> '' GROUP BY ALL),
 ph0 AS (SELECT query_id, order_rank, e.*, coalesce(nullif({S.CLEAN('part_name')}, ''), nullif({S.CLEAN('part_number_name')}, ''), '') AS pname, row_number() OVER (PARTITION BY query_id ORDER BY order_rank, part_id) AS rank FROM h JOIN part_evidence e USING (work_order_id)),
 ph AS (SELECT query_id, rank, 'part:' || work_order_id || ':' || rank AS doc_id, coalesce(nullif(pname, ''), nullif({S.CLEAN('part_code')}, ''), '备件证据 ' || rank) AS title, {S.CLEAN('part_code')} AS part_code,
   concat_ws(chr(10), CASE WHEN pname <> '' THEN '新件备件名称: ' || pname END, CASE WHEN {S.CLEAN('part_code')} <> '' THEN '新件物料编码: ' || {S.CLEAN('part_code')} END, CASE WHEN {S.CLEAN('quantity')} <> '' THEN '新件数量: ' || {S.CLEAN('quantity')} END,
     '来源工单: ' || {S.CLEAN('work_order_id')}, CASE WHEN {S.CLEAN('reported_issue')} <> '' THEN '用户报修内容: ' || {S.CLEAN('reported_issue')} END) AS body_preview FROM ph0)"""
_HIT_CODES = f"""qc AS ({S.codes_of('query_id', 'query', 'asked')}),
 xh AS (SELECT query_id, doc_id, 100.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM (SELECT DISTINCT query_id, doc_id FROM qc JOIN index_documents ON doc_type = 'manual_fault_code' AND upper(fields['fault_code']) = code)),
 {S.bm25_ctes('manual_fault_code', 'fc')}, {S.top_ctes('fc', 'fct', 8)}, fcodes AS (SELECT * FROM xh WHERE rank <= 8 UNION ALL SELECT * FROM fct WHERE query_id IN (SELECT query_id FROM qc) AND query_id NOT IN (SELECT query_id FROM xh))"""


def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("p").alias("provider"), F.when(F.col("label") < 5, "a").otherwise("b").alias("model"))
    return index.missing_embeddings(table(spark, d, "documents").select("doc_id"), e, "p", "a")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "work_orders").select(F.lit("work_order").alias("source_kind"), "source_path", F.sha2(F.coalesce("raw_text", F.lit("")), 256).alias("content_hash"), "record_id")


def resume_filter(spark: SparkSession, d: str) -> DataFrame:
    """Of the sources, two thirds are in the manifest; a fifth of those failed, a seventh have changed since."""
    s = _sources(spark, d)
    manifest = s.where("record_id % 3 <> 0").select("source_kind", "source_path", F.when(F.col("record_id") % 7 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("record_id") % 5 == 0, "failed").otherwise("completed").alias("status"))
    return index.pending_sources(s, manifest).select("source_path", "content_hash")


def upsert_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders delivered again replace those of their source; a touched source without rows is gone."""
    o = table(spark, d, "work_orders").select("record_id", "source_path", "encoding")
    new = o.where("record_id % 4 = 0").withColumn("encoding", F.lit("new"))
    return index.upsert_by_source(o, new, touched=o.where("record_id % 2 = 0"))


def last_documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders share a document id where they share a work-order id; the last source path wins."""
    o = table(spark, d, "work_orders").select(F.concat(F.lit("wo:"), F.coalesce("work_order_id", T.short_hash(F.col("source_path")))).alias("doc_id"), "record_id", "source_path")
    return index.last_per_document(o)


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "work_orders").select(F.coalesce(F.upper("work_order_id"), F.lit("none")).alias("doc_id"), "record_id", F.create_map().cast("map<string,string>").alias("metadata"))
    return index.unique_doc_ids(o, "record_id").select("doc_id", "record_id", F.col("metadata")["duplicate_of"].alias("duplicate_of"))


def numbered_documents(spark: SparkSession, d: str) -> DataFrame:
    return index.number_documents(docs(spark, d).select("doc_id")).select("doc_id", F.col("document_id").cast("bigint").alias("document_id"))


def source_manifest(spark: SparkSession, d: str) -> DataFrame:
    """State of each log file's sources after a stream of events: the latest by time."""
    p = table(spark, d, "parse_log").where("line is not null").select(F.lit("log").alias("source_kind"), F.md5("line").alias("source_path"), F.lit("x").alias("content_hash"), F.when(F.col("raw_id") % 3 == 0, "failed").otherwise("completed").alias("status"), F.col("received_at").alias("updated_at"))
    return index.merge_manifest(p.limit(0), p).select("source_kind", "source_path", "status", "updated_at")


def work_order_documents(spark: SparkSession, d: str) -> DataFrame:
    o = index.work_order_documents(table(spark, d, "work_orders"))
    return o.select("doc_id", "doc_type", "title", F.col("fields")["solution"].alias("solution"), F.col("metadata")["work_order_id"].alias("work_order_id"), "source_path")


def exploded_parts(spark: SparkSession, d: str) -> DataFrame:
    return index.part_rows(table(spark, d, "work_orders"), "record_id").select("record_id", F.col("part_ord").cast("int").alias("part_ord"), "part_name", "part_code", "quantity")


QUERIES = {f.__name__: f for f in (token_stats, inverted_index, index_statistics, document_type_counts, term_frequencies, query_term_dedup, bm25_topk, bm25_matched_terms, vector_topk, hybrid_fusion, relative_threshold, typical_fault_search, fault_code_exact, fault_code_search, rank_ordered_parts, part_channel, evidence_flatten, evidence_package, threshold_events, missing_embeddings, resume_filter, upsert_orders, last_documents, duplicate_ids, numbered_documents, source_manifest, work_order_documents, exploded_parts)}

_CLEAN = S.CLEAN
_FIRST = lambda *cs: "coalesce(" + ", ".join(f"nullif({_CLEAN(c)}, '')" for c in cs) + ")"
_WO_ID = f"coalesce(nullif({_CLEAN('work_order_id')}, ''), substr(sha1(source_path), 1, 12))"

SQL = {
    "token_stats": f"WITH {S.token_ctes('index_documents', 'doc_id', 'text')} SELECT d.doc_id, count(term) AS n_tokens, count(DISTINCT term) AS n_terms FROM index_documents d LEFT JOIN tok t ON t.doc_id = d.doc_id GROUP BY 1",
    "inverted_index": f"WITH {S.field_ctes()} SELECT term, p.doc_id, p.field, tf, {S.WEIGHT.replace('field ', 'p.field ', 1)} AS field_weight, field_length FROM post p JOIN flen l ON l.doc_id = p.doc_id AND l.field = p.field",
    "index_statistics": f"WITH {S.field_ctes()} SELECT field, round(avg_len, 6) AS avg_len FROM avgl",
    "document_type_counts": "SELECT doc_type, greatest(count(*), 1) AS doc_count FROM index_documents GROUP BY 1",
    "term_frequencies": f"WITH {S.field_ctes()} SELECT doc_type, term, count(DISTINCT doc_id) AS df FROM post GROUP BY ALL",
    "query_term_dedup": f"""WITH q AS ({_ASKED}), w AS (SELECT query_id, regexp_extract_all(lower(replace(query, '﻿', '')), '[A-Za-z0-9][A-Za-z0-9_.-]*') AS ws, regexp_extract_all(lower(replace(query, '﻿', '')), '[\\x{{4e00}}-\\x{{9fff}}]+') AS rs FROM q),
        a AS (SELECT query_id, 0 AS k, i AS j, 0 AS g, 0 AS n, regexp_replace(ws[i], '^[._-]+|[._-]+$', '', 'g') AS term FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
        r AS (SELECT query_id, j, rs[j] AS r FROM (SELECT *, unnest(range(1, len(rs) + 1)) AS j FROM w)),
        u AS (SELECT * FROM a WHERE term <> '' UNION ALL SELECT query_id, 1, j, 0, 0, r FROM r WHERE length(r) <= 12 UNION ALL SELECT query_id, 1, j, 1, i, substr(r, i::INT, 2) FROM (SELECT *, unnest(range(1, length(r))) AS i FROM r)
          UNION ALL SELECT query_id, 1, j, 2, i, substr(r, i::INT, 3) FROM (SELECT *, unnest(range(1, length(r) - 1)) AS i FROM r)),
        f AS (SELECT query_id, term, min((k, j, g, n)) AS pos FROM u GROUP BY ALL)
        SELECT query_id, count(*) AS terms, arg_max(term, pos) AS last_term, arg_min(term, pos) AS first_term FROM f GROUP BY query_id""",
    "bm25_topk": f"{_BASE}, {S.top_ctes('bm', 'r', TOP)} SELECT * FROM r",
    "bm25_matched_terms": f"{_BASE}, {S.top_ctes('bm', 'r', 1)} SELECT DISTINCT m.query_id, m.doc_id, term, field, tf, w AS field_weight FROM bm_m m JOIN r ON r.query_id = m.query_id AND r.doc_id = m.doc_id",
    "vector_topk": f"WITH {_VEC} SELECT query_id, doc_id, round(distance, 6) AS distance, score, rank FROM vec",
    "hybrid_fusion": _HYBRID,
    "relative_threshold": f"{_CUT} SELECT * FROM cut",
    "typical_fault_search": f"WITH {S.field_ctes()}, {S.question_ctes(_ASKED)}, {_TYPICAL} SELECT * FROM tcut",
    "fault_code_exact": f"WITH asked AS ({_CODES}), {_EXACT} SELECT * FROM exact",
    "fault_code_search": f"""WITH {S.field_ctes()}, {S.question_ctes(_CODES)}, {_EXACT}, {S.bm25_ctes('manual_fault_code', 'fc')}, {S.top_ctes('fc', 'fct', 8)}
        SELECT query_id, doc_id, score, rank FROM exact UNION ALL SELECT * FROM fct WHERE query_id NOT IN (SELECT query_id FROM exact) AND query_id IN (SELECT query_id FROM asked WHERE query <> 'code none')""",
    "rank_ordered_parts": f"""{_CUT}, h AS (SELECT query_id, metadata['work_order_id'] AS work_order_id, min(rank) AS order_rank FROM cut JOIN index_documents USING (doc_id) WHERE metadata['work_order_id'] <> '' GROUP BY ALL)
        SELECT query_id, work_order_id, order_rank, part_id, part_code, quantity FROM h JOIN part_evidence USING (work_order_id)""",
    "evidence_flatten": f"""{_CUT}, {_TYPICAL}, {_PARTS}, {_HIT_CODES}, u AS (SELECT query_id, 'work_orders' AS channel, 0 AS priority, doc_id, score, rank AS channel_rank FROM cut UNION ALL SELECT query_id, 'part_evidence', 1, doc_id, NULL, rank FROM ph
          UNION ALL SELECT query_id, 'manual_fault_codes', 2, doc_id, score, rank FROM fcodes UNION ALL SELECT query_id, 'manual_typical_faults', 3, doc_id, score, rank FROM tcut)
        SELECT query_id, channel, doc_id, coalesce(ph_title, d_title) AS title, score, channel_rank, rank FROM (SELECT u.*, p.title AS ph_title, d.title AS d_title, row_number() OVER (PARTITION BY u.query_id ORDER BY priority, channel_rank, u.doc_id) AS rank
          FROM u LEFT JOIN ph p ON u.channel = 'part_evidence' AND p.query_id = u.query_id AND p.rank = u.channel_rank LEFT JOIN index_documents d ON u.channel <> 'part_evidence' AND d.doc_id = u.doc_id) WHERE rank <= 8""",
    "evidence_package": f"""{_CUT}, {_TYPICAL}, {_PARTS}, {_HIT_CODES}
        SELECT q.query_id, 'bm25' AS mode, 'bm25,bm25,bm25' AS channel_modes, 8 AS top_k, coalesce((SELECT string_agg(doc_id, ',' ORDER BY rank) FROM cut c WHERE c.query_id = q.query_id), '') AS work_orders, coalesce((SELECT string_agg(doc_id, ',' ORDER BY rank) FROM tcut c WHERE c.query_id = q.query_id), '') AS manual_typical_faults,
          coalesce((SELECT string_agg(doc_id, ',' ORDER BY rank) FROM fcodes c WHERE c.query_id = q.query_id), '') AS manual_fault_codes, coalesce((SELECT string_agg(doc_id, ',' ORDER BY rank) FROM ph c WHERE c.query_id = q.query_id), '') AS part_evidence,
          coalesce((SELECT string_agg(work_order_id, ',' ORDER BY order_rank, work_order_id) FROM (SELECT DISTINCT query_id, order_rank, h.work_order_id FROM h JOIN part_evidence USING (work_order_id)) c WHERE c.query_id = q.query_id), '') AS linked,
          (SELECT count(*) FROM cut c WHERE c.query_id = q.query_id)::INT AS order_hits, 0 AS warnings FROM asked q""",
    "threshold_events": f"""{_CUT}, r AS (SELECT query_id, count(*) AS returned_count FROM cut GROUP BY 1)
        SELECT query_id, candidate_count, coalesce(returned_count, 0) AS returned_count, 50 AS candidate_top_k, round(top, 6) AS top_score, round(top * 0.45, 6) AS score_threshold, 10 AS max_hits FROM (SELECT query_id, count(*) AS candidate_count, max(score) AS top FROM bmt GROUP BY 1) LEFT JOIN r USING (query_id)""",
    "part_channel": f"{_CUT}, {_PARTS} SELECT query_id, doc_id, rank, title, body_preview, part_code FROM ph",
    "missing_embeddings": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)",
    "resume_filter": """WITH s AS (SELECT *, sha256(coalesce(raw_text, '')) AS content_hash FROM work_orders)
        SELECT source_path, content_hash FROM s WHERE NOT (record_id % 3 <> 0 AND record_id % 5 <> 0 AND record_id % 7 <> 0)""",
    "upsert_orders": "SELECT record_id, source_path, CASE WHEN record_id % 4 = 0 THEN 'new' ELSE encoding END AS encoding FROM work_orders WHERE record_id % 2 <> 0 OR record_id % 4 = 0",
    "last_documents": "SELECT 'wo:' || coalesce(work_order_id, substr(sha1(source_path), 1, 12)) AS doc_id, arg_max(record_id, source_path) AS record_id, max(source_path) AS source_path FROM work_orders GROUP BY 1",
    "duplicate_ids": """SELECT id || CASE WHEN n > 1 THEN ':dup' || n ELSE '' END AS doc_id, record_id, CASE WHEN n > 1 THEN id END AS duplicate_of
        FROM (SELECT coalesce(upper(work_order_id), 'none') AS id, record_id, row_number() OVER (PARTITION BY coalesce(upper(work_order_id), 'none') ORDER BY record_id) AS n FROM work_orders)""",
    "numbered_documents": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS document_id FROM index_documents",
    "source_manifest": """SELECT 'log' AS source_kind, md5(line) AS source_path, arg_max(CASE WHEN raw_id % 3 = 0 THEN 'failed' ELSE 'completed' END, (received_at, CASE WHEN raw_id % 3 = 0 THEN 'failed' ELSE 'completed' END)) AS status, max(received_at) AS updated_at
        FROM parse_log WHERE line IS NOT NULL GROUP BY ALL""",
    "work_order_documents": f"""SELECT 'wo:' || {_WO_ID} AS doc_id, 'work_order' AS doc_type, {_FIRST('reported_issue', 'work_order_id', 'source_path')} AS title, {_CLEAN('solution')} AS solution, {_CLEAN('work_order_id')} AS work_order_id, source_path FROM work_orders
        UNION ALL SELECT 'part:' || {_WO_ID} || ':' || i, 'part_evidence', {_FIRST('p.part_name', 'p.part_number_name', 'p.part_code', 'p.raw_text', 'work_order_id')}, {_CLEAN('solution')}, {_CLEAN('work_order_id')}, source_path
        FROM (SELECT *, unnest(parts) AS p, unnest(range(1, len(parts) + 1)) AS i FROM work_orders)""",
    "exploded_parts": "SELECT record_id, i::INT AS part_ord, p.part_name, p.part_code, p.quantity FROM (SELECT record_id, unnest(parts) AS p, unnest(range(1, len(parts) + 1)) AS i FROM work_orders)",
}
