"""Queries over single records and views of them (values, secrets, shares, retries, hits, verdicts), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text as T
from fieldloom.operators import evaluate, evidence, index, retrieval, tasks, workorder
from fieldloom.plans import search
from fieldloom.plans import sqltext as S
from fieldloom.plans.search import _BASE, _CUT, _FIRST, _WO_ID
from fieldloom.session import spread, table

_BLANK = r"[\s\x{A0}\x{3000}\x{2000}-\x{200A}\x{202F}\x{205F}\x{85}\x{2028}\x{2029}]"
_EVAL = lambda c: f"lower(regexp_replace(coalesce({c}, ''), '{_BLANK}+', '', 'g'))"


def clean_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "work_orders").where("solution is not null").select("record_id", T.clean_value(F.concat(F.lit(" ;"), "solution", F.lit("\n \t x  y ："))).alias("value"))


def redacted_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses with a password or a secret in the query, made of titles."""
    n = table(spark, d, "documents").where("fault_code is not null")
    url = F.concat(F.lit("postgresql://user:"), "fault_code", F.lit("@host:5432/db?Token="), "fault_code", F.lit("&x=1"))
    return n.select("doc_id", T.redact_database_url(url).alias("database"), T.redact_query_secrets(url).alias("query"))


def _evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Review verdicts as evaluation tasks with a share id in their result; some ids aren't valid."""
    r = table(spark, d, "review_labels")
    share = F.concat(F.when(F.col("label_id") % 5 == 0, "api").otherwise("sh_"), F.lpad(F.col("label_id").cast("string"), 8, "0"), F.when(F.col("label_id") % 7 == 0, "!").otherwise(""))
    result = F.to_json(F.struct(F.col("reviewer").alias("file_name"), share.alias("share_id"), F.struct(F.col("doc_id").alias("done")).alias("counts")))
    return r.select(F.col("label_id").alias("id"), F.when(F.col("label") == "none", "search").otherwise("batch_eval").alias("task_type"), F.lit("completed").alias("status"), F.col("label").alias("summary"), F.col("reviewed_at").alias("updated_at"), result.alias("result"))


def evaluation_listing(spark: SparkSession, d: str) -> DataFrame:
    e = tasks.evaluations(_evaluations(spark, d))
    return e.select("id", "summary", "file_name", "share_id", tasks.is_share_id(F.col("share_id")).alias("valid"), F.get_json_object("counts", "$.done").cast("bigint").alias("done"), tasks.iso_time(F.col("updated_at")).alias("at"))


def retry_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Failures by task: what can be read again, by kind."""
    p = table(spark, d, "part_evidence")
    stage = F.when(F.col("part_id") % 3 == 0, "work_order").when(F.col("part_id") % 3 == 1, "manual").otherwise("answer")
    f = p.select((F.col("record_id") % 20).alias("task_id"), stage.alias("stage"), F.when(F.col("part_id") % 11 == 0, " ").otherwise(F.col("source_path")).alias("input"), F.lit("x").alias("error"))
    got = tasks.retry_paths(f)
    return got.select("task_id", *(F.array_join(c, "|").alias(c) for c in ("work_order_paths", "manual_paths")))


def fields_by_document(spark: SparkSession, d: str) -> DataFrame:
    """Issue and solution of each order document as columns."""
    x = search.docs(spark, d)
    hits = x.where("doc_type = 'work_order'").select("doc_id")
    each = x.where("doc_type = 'work_order'").select("doc_id", F.explode("fields").alias("field", "field_text"))
    return retrieval.fields_wide(hits, each, ["reported_issue", "solution"])


def hits_as_returned(spark: SparkSession, d: str) -> DataFrame:
    """The best orders of each question with title, preview, order and source."""
    x = search.docs(spark, d)
    rows = retrieval.hit_rows(retrieval.bm25(search.index_for(x, search.questions(spark, d)), ["work_order"], 5), x)
    return rows.select("query_id", "rank", "doc_id", "score", "title", "body_preview", "work_order_id", "source_path", F.size("metadata").alias("facts"))


def inverted_index_by_term(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index's blocks put together again: of each term its postings, their first and last document, and occurrences."""
    ix = index.inverted_index(index.postings(index.document_fields(spread(search.docs(spark, d), spark))))
    own = ix.select("term", "df", F.size("postings").alias("n"), F.array_min(F.transform("postings", lambda p: p["doc_id"])).alias("lo"), F.array_max(F.transform("postings", lambda p: p["doc_id"])).alias("hi"), F.aggregate("postings", F.lit(0).cast("bigint"), lambda s, p: s + p["tf"]).alias("tf"))
    return own.groupBy("term").agg(F.max("df").alias("df"), F.sum("n").alias("postings"), F.min("lo").alias("first_doc"), F.max("hi").alias("last_doc"), F.sum("tf").alias("tf"))


def order_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of every file, parsed again from its text, and the warnings about them."""
    o = spread(table(spark, d, "work_orders").where("raw_text is not null").select("record_id", "raw_text"), spark)
    p = workorder.parse_orders(o, "raw_text", "record_id")
    about = F.filter("parse_warnings", lambda w: w != "parts_section_without_structured_parts")
    return p.select("record_id", "status", "work_order_id", "reported_issue", "solution", "remarks", F.array_join(about, "|").alias("warnings"))


def part_signals(spark: SparkSession, d: str) -> DataFrame:
    """Which parts say anything structured."""
    p = table(spark, d, "part_evidence")
    return p.select("part_id", workorder.is_part_signal(F.struct(*workorder.PART_KEYS)).alias("signal"))


def order_documents_whole(spark: SparkSession, d: str) -> DataFrame:
    """Documents of orders and parts with their whole text, fields and metadata."""
    o = index.work_order_documents(table(spark, d, "work_orders"))
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\x1f")
    return o.select("doc_id", "doc_type", "title", "text", flat("fields").alias("fields"), flat("metadata").alias("metadata"), "source_path")


def _verdict_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row for each order: its first coded part is expected, its parts from the second on are found; two thirds expect an order, some fail or are blank."""
    o = table(spark, d, "work_orders")
    some = lambda p: F.struct(F.coalesce(p["part_name"], F.lit("")).alias("name"), F.coalesce(p["part_code"], F.lit("")).alias("code"), F.coalesce(p["quantity"], F.lit("")).alias("quantity"))
    parts = F.transform(F.coalesce("parts", F.array()), some)
    coded = F.filter(parts, lambda p: p["code"] != "")
    r = F.col("record_id")
    return o.select(
        "record_id", r.alias("row_number"), F.when(r % 17 == 0, " ").otherwise(F.coalesce("reported_issue", F.lit("q"))).alias("question"), F.slice(coded, 1, 1).alias("expected"), F.slice(parts, F.when(r % 4 == 0, 2).otherwise(1), 1000).alias("retrieved"),
        F.when(r % 3 != 0, F.concat(F.lit("dir/"), F.lower("work_order_id"), F.lit(".txt"))).alias("expected_order"), F.array(F.concat(F.lit("wo:"), F.when(r % 5 == 0, "other").otherwise(F.col("work_order_id")))).alias("retrieved_orders"),
        F.when(r % 2 == 0, F.concat(F.lit("use "), F.coalesce(F.get(F.transform(coded, lambda p: p["code"]), F.lit(0)), F.lit("-")))).alias("answer"), F.when(r % 2 == 0, "answer").otherwise("search").alias("mode"), F.when(r % 23 == 0, "boom").alias("error"),
    )


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.judge(_verdict_rows(spark, d)).select("record_id", "status", "missing", "unexpected", "part_recall", "work_order_required", "work_order_recall", "answer_available", "answer_part_recall")


def verdict_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metric_counts(evaluate.judge(_verdict_rows(spark, d)))


def verdict_order_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.order_counts(evaluate.judge(_verdict_rows(spark, d)))


def verdict_export(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation's export, every column as text."""
    return evaluate.export_rows(evaluate.judge(_verdict_rows(spark, d))).select("row_number", "question", "mode", "status", "missing", "unexpected", "error", "expected_parts", "retrieved_orders")


def search_summaries(spark: SparkSession, d: str) -> DataFrame:
    """One line for each question's package."""
    q, config = search.questions(spark, d), retrieval.RetrievalConfig()
    found = retrieval.retrieve(search.docs(spark, d), table(spark, d, "part_evidence"), q, config)
    return tasks.search_summary(retrieval.package(found, q, config, 8), ("work_orders", "part_evidence"))


def matched_terms_json(spark: SparkSession, d: str) -> DataFrame:
    """What matched in each question's best order as JSON text, and the first term read back from it."""
    ix = search.index_for(search.docs(spark, d), search.questions(spark, d))
    best = retrieval.bm25(ix, ["work_order"], 1).select("query_id", "doc_id")
    m = retrieval.matched_terms(ix, best)
    j = m.withColumn("matched", F.to_json(F.transform("matched_terms", lambda x: F.struct(x["tf"].alias("tf"), x["term"].alias("term"), x["field"].alias("field")))))
    return j.select("query_id", "doc_id", "matched", F.get_json_object("matched", "$[0].term").alias("first_term"))


def relevance_levels(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts in several languages and spellings as levels."""
    r = table(spark, d, "review_labels")
    word = F.element_at(F.array(*map(F.lit, (" High", "中等相关", "不相关", "LOW", "?", "相关 ", "可能相关"))), (F.col("label_id") % 7 + 1).cast("int"))
    return r.select("label_id", evidence.relevance(F.when(F.col("label_id") % 11 != 0, word)).alias("level"))


QUERIES = {f.__name__: f for f in (clean_values, redacted_addresses, evaluation_listing, retry_inputs, fields_by_document, hits_as_returned, inverted_index_by_term, order_sections, part_signals, order_documents_whole, verdicts, verdict_metrics, verdict_order_counts, verdict_export, search_summaries, matched_terms_json, relevance_levels)}

_E = """e AS (SELECT label_id AS id, CASE WHEN label = 'none' THEN 'search' ELSE 'batch_eval' END AS task_type, label AS summary, reviewer, doc_id, reviewed_at,
   CASE WHEN label_id % 5 = 0 THEN 'api' ELSE 'sh_' END || lpad(label_id::VARCHAR, 8, '0') || CASE WHEN label_id % 7 = 0 THEN '!' ELSE '' END AS share_id FROM review_labels)"""
_ID = lambda c: f"regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '^.*/', ''), '\\.[^.]+$', ''), '(?i)^wo:', '')"
_V = f"""v0 AS (SELECT *, list_transform(coalesce(parts, []), lambda p: {{'name': coalesce(p.part_name, ''), 'code': coalesce(p.part_code, ''), 'quantity': coalesce(p.quantity, '')}}) AS ps FROM work_orders),
 v1 AS (SELECT *, list_filter(ps, lambda p: p.code <> '') AS coded FROM v0),
 v2 AS (SELECT record_id, CASE WHEN record_id % 17 = 0 THEN ' ' ELSE coalesce(reported_issue, 'q') END AS question, coded[1:1] AS expected, CASE WHEN record_id % 4 = 0 THEN ps[2:] ELSE ps END AS retrieved,
   CASE WHEN record_id % 3 <> 0 THEN 'dir/' || lower(work_order_id) || '.txt' END AS expected_order, 'wo:' || CASE WHEN record_id % 5 = 0 THEN 'other' ELSE work_order_id END AS retrieved_order,
   CASE WHEN record_id % 2 = 0 THEN 'use ' || coalesce(coded[1].code, '-') END AS answer, CASE WHEN record_id % 2 = 0 THEN 'answer' ELSE 'search' END AS mode, CASE WHEN record_id % 23 = 0 THEN 'boom' END AS error FROM v1),
 v3 AS (SELECT *, len(expected) = 0 OR len(list_filter(retrieved, lambda g: {_EVAL('g.code')} = {_EVAL('expected[1].code')}
      AND (trim(expected[1].name) = '' OR {_EVAL('expected[1].name')} <> '' AND {_EVAL('g.name')} <> '' AND (contains({_EVAL('g.name')}, {_EVAL('expected[1].name')}) OR contains({_EVAL('expected[1].name')}, {_EVAL('g.name')})))
      AND (trim(expected[1].quantity) = '' OR CASE WHEN try_cast(expected[1].quantity AS DOUBLE) IS NOT NULL AND (trim(g.quantity) = '' OR try_cast(g.quantity AS DOUBLE) IS NOT NULL) THEN try_cast(expected[1].quantity AS DOUBLE) = coalesce(try_cast(g.quantity AS DOUBLE), 0) ELSE {_EVAL('expected[1].quantity')} = {_EVAL('g.quantity')} END))) > 0 AS part_recall,
   {_ID('expected_order')} AS want, {_ID('retrieved_order')} AS got FROM v2),
 v4 AS (SELECT *, want <> '' AS work_order_required, want = '' OR coalesce(got <> '' AND {_EVAL('got')} = {_EVAL('want')}, false) AS work_order_recall, mode = 'answer' AS answer_available,
   mode <> 'answer' OR len(expected) = 0 OR {_EVAL('expected[1].code')} <> '' AND contains({_EVAL('answer')}, {_EVAL('expected[1].code')}) OR {_EVAL('expected[1].name')} <> '' AND contains({_EVAL('answer')}, {_EVAL('expected[1].name')}) AS answer_part_recall,
   CASE WHEN part_recall THEN 0 ELSE 1 END AS missing, len(retrieved) - CASE WHEN part_recall AND len(expected) > 0 THEN 1 ELSE 0 END AS unexpected FROM v3),
 v AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN trim(question) = '' THEN 'skipped' WHEN part_recall AND work_order_recall THEN 'pass' WHEN part_recall AND work_order_required THEN 'warn' ELSE 'fail' END AS status FROM v4)"""
_STATE = lambda m: f"CASE WHEN status IN ('error', 'skipped') THEN status WHEN {m} THEN 'pass' ELSE 'fail' END"
_PREVIEW = f"regexp_replace(regexp_replace(coalesce(d.text, ''), '{_BLANK}+', ' ', 'g'), '^ | $', '', 'g')"
_KEYS = ("part_number_name", "part_number", "part_name", "part_code", "quantity", "raw_text")
_FLAT = lambda pairs: " || chr(31) || ".join(f"'{k}=' || {v}" for k, v in sorted(pairs))
_JOIN = lambda *cs: "array_to_string(list_filter([" + ", ".join(S.CLEAN(c) for c in cs) + "], lambda x: x <> ''), chr(10))"

_SECTION_OF = {"work_order_id": "工单id", "reported_issue": "用户报修内容", "solution": "人员落实及解决方法", "remarks": "备注"}
_LABELS = "(工单ID|用户报修内容|人员落实及解决方法|备件信息|备注)"
_TIDY = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '\\n{_BLANK}*', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '^[ \\t\\n:：,，;；]+|[ \\t\\n:：,，;；]+$', '', 'g')"

SQL = {
    "clean_values": f"""SELECT record_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ;' || solution || chr(10) || ' ' || chr(9) || ' x  y ：', '^{_BLANK}+|{_BLANK}+$', '', 'g'), '\\n\\s*', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '^[ \\t\\n:：,，;；]+|[ \\t\\n:：,，;；]+$', '', 'g') AS value FROM work_orders WHERE solution IS NOT NULL""",
    "redacted_addresses": """SELECT doc_id, 'postgresql://user:***@host:5432/db?Token=' || fault_code || '&x=1' AS database, 'postgresql://user:' || fault_code || '@host:5432/db?Token=***&x=1' AS query FROM documents WHERE fault_code IS NOT NULL""",
    "evaluation_listing": f"WITH {_E} SELECT id, summary, reviewer AS file_name, share_id, share_id NOT LIKE 'api%' AND share_id NOT LIKE '%!' AS valid, doc_id AS done, strftime(reviewed_at, '%Y-%m-%dT%H:%M:%S') AS at FROM e WHERE task_type = 'batch_eval'",
    "retry_inputs": """WITH f AS (SELECT record_id % 20 AS task_id, CASE part_id % 3 WHEN 0 THEN 'work_order' WHEN 1 THEN 'manual' ELSE 'answer' END AS stage, CASE WHEN part_id % 11 = 0 THEN ' ' ELSE source_path END AS input FROM part_evidence),
        g AS (SELECT * FROM f WHERE stage <> 'answer' AND trim(coalesce(input, '')) <> '')
        SELECT task_id, coalesce(string_agg(DISTINCT input, '|' ORDER BY input) FILTER (stage = 'work_order'), '') AS work_order_paths, coalesce(string_agg(DISTINCT input, '|' ORDER BY input) FILTER (stage = 'manual'), '') AS manual_paths FROM g GROUP BY 1""",
    "fields_by_document": "SELECT doc_id, fields['reported_issue'] AS reported_issue, fields['solution'] AS solution FROM index_documents WHERE doc_type = 'work_order'",
    "hits_as_returned": f"""{_BASE}, {S.top_ctes('bm', 'r', 5)} SELECT query_id, rank, r.doc_id, score, {S.CLEAN('d.title')} AS title, CASE WHEN length({_PREVIEW}) <= 420 THEN {_PREVIEW} ELSE rtrim(substr({_PREVIEW}, 1, 417)) || '...' END AS body_preview,
        nullif(d.metadata['work_order_id'], '') AS work_order_id, nullif(d.source_path, '') AS source_path, cardinality(coalesce(d.metadata, MAP {{}}))::INT AS facts FROM r JOIN index_documents d ON d.doc_id = r.doc_id""",
    "inverted_index_by_term": f"WITH {S.field_ctes()} SELECT term, count(*) AS df, count(*) AS postings, min(doc_id) AS first_doc, max(doc_id) AS last_doc, sum(tf)::BIGINT AS tf FROM post GROUP BY term",
    "order_sections": f"""WITH n AS (SELECT record_id, regexp_replace(regexp_replace(translate(replace(replace(replace(raw_text, '﻿', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '：', ':'), '[ \\t　]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM work_orders WHERE raw_text IS NOT NULL),
        s AS (SELECT record_id, regexp_extract_all(t, '(?i){_LABELS}\\s*:', 1) AS l, regexp_split_to_array(t, '(?i){_LABELS}\\s*:\\s*') AS v FROM n),
        x AS (SELECT record_id, lower(unnest(l)) AS label, unnest(range(1, len(l) + 1)) AS i, unnest(list_transform(v[2:], lambda y: {_TIDY('y')})) AS value FROM s),
        y AS (SELECT record_id, label, arg_max(value, i) AS value FROM x WHERE value <> '' GROUP BY ALL),
        z AS (SELECT n.record_id, {', '.join(f"max(value) FILTER (label = '{label}') AS {key}" for key, label in _SECTION_OF.items())} FROM n LEFT JOIN y ON y.record_id = n.record_id GROUP BY n.record_id)
        SELECT record_id, 'parsed' AS status, work_order_id, reported_issue, solution, remarks, concat_ws('|', CASE WHEN reported_issue IS NULL THEN 'missing_reported_issue' END, CASE WHEN solution IS NULL THEN 'missing_solution' END, CASE WHEN work_order_id IS NULL THEN 'missing_work_order_id' END) AS warnings FROM z""",
    "part_signals": "SELECT part_id, coalesce(part_number_name, '') || coalesce(part_number, '') || coalesce(part_name, '') || coalesce(part_code, '') || coalesce(quantity, '') <> '' AS signal FROM part_evidence",
    "order_documents_whole": f"""SELECT 'wo:' || {_WO_ID} AS doc_id, 'work_order' AS doc_type, {_FIRST('reported_issue', 'work_order_id', 'source_path')} AS title, {_JOIN('reported_issue', 'solution', 'remarks', 'raw_text')} AS text,
          {_FLAT([(c, S.CLEAN(c)) for c in ('reported_issue', 'solution', 'remarks', 'raw_text')])} AS fields, {_FLAT([('work_order_id', S.CLEAN('work_order_id')), ('part_count', 'coalesce(len(parts), 0)')])} AS metadata, source_path FROM work_orders
        UNION ALL SELECT 'part:' || {_WO_ID} || ':' || i, 'part_evidence', {_FIRST('p.part_name', 'p.part_number_name', 'p.part_code', 'p.raw_text', 'work_order_id')}, {_JOIN(*(f'p.{k}' for k in _KEYS), 'reported_issue', 'solution')},
          {_FLAT([*((k, S.CLEAN(f'p.{k}')) for k in _KEYS), ('reported_issue', S.CLEAN('reported_issue')), ('solution', S.CLEAN('solution'))])}, {_FLAT([('work_order_id', S.CLEAN('work_order_id')), ('part_index', 'i')])}, source_path
        FROM (SELECT *, unnest(parts) AS p, unnest(range(1, len(parts) + 1)) AS i FROM work_orders)""",
    "verdicts": f"WITH {_V} SELECT record_id, status, missing, unexpected, part_recall, work_order_required, work_order_recall, answer_available, answer_part_recall FROM v",
    "verdict_metrics": f"""WITH {_V}, m AS (SELECT 'part_recall' AS metric, {_STATE('part_recall')} AS s FROM v UNION ALL SELECT 'work_order_recall', {_STATE('work_order_recall')} FROM v
          UNION ALL SELECT 'answer_part_recall', CASE WHEN status IN ('error', 'skipped') THEN status WHEN NOT answer_available THEN 'skipped' WHEN answer_part_recall THEN 'pass' ELSE 'fail' END FROM v)
        SELECT metric, count_if(s = 'pass') AS pass, count_if(s = 'fail') AS fail, count_if(s = 'error') AS error, count_if(s = 'skipped') AS skipped FROM m GROUP BY metric""",
    "verdict_order_counts": f"WITH {_V} SELECT count(*) AS done, count_if(work_order_required) AS work_order_required, count_if(work_order_required AND work_order_recall) AS work_order_pass, count_if(len(expected) = 0) AS without_expectation FROM v",
    "verdict_export": f"""WITH {_V} SELECT record_id::VARCHAR AS row_number, question, mode, status, missing::VARCHAR AS missing, unexpected::VARCHAR AS unexpected, coalesce(error, '') AS error,
        coalesce(expected[1].name || ' ' || expected[1].code || ' ' || expected[1].quantity, '') AS expected_parts, coalesce(retrieved_order, '') AS retrieved_orders FROM v""",
    "matched_terms_json": f"""{_BASE}, {S.top_ctes('bm', 'r', 1)}, j AS (SELECT m.query_id, m.doc_id, to_json(list({{'tf': tf, 'term': term, 'field': field}} ORDER BY tf, term, field))::VARCHAR AS matched FROM (SELECT DISTINCT query_id, doc_id, tf, term, field FROM bm_m) m JOIN r ON r.query_id = m.query_id AND r.doc_id = m.doc_id GROUP BY ALL)
        SELECT query_id, doc_id, matched, json_extract_string(matched, '$[0].term') AS first_term FROM j""",
    "relevance_levels": "SELECT label_id, CASE WHEN label_id % 11 = 0 THEN 'unknown' ELSE ['high', 'medium', 'unrelated', 'low', 'unknown', 'high', 'medium'][label_id % 7 + 1] END AS level FROM review_labels",
    "search_summaries": f"""{_CUT}, h AS (SELECT query_id, metadata['work_order_id'] AS work_order_id FROM cut JOIN index_documents USING (doc_id) WHERE metadata['work_order_id'] <> '' GROUP BY ALL), p AS (SELECT query_id, count(*) AS n FROM h JOIN part_evidence USING (work_order_id) GROUP BY 1)
        SELECT q.query_id, 'bm25 · work_orders ' || (SELECT count(*) FROM cut c WHERE c.query_id = q.query_id) || ' · part_evidence ' || coalesce(p.n, 0) AS summary FROM asked q LEFT JOIN p ON p.query_id = q.query_id""",
}
