"""Queries over parsing, manuals, evidence, evaluation and task history, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text as T
from fieldloom.operators import embed, evaluate, evidence, html, index, manuals, retrieval, tasks, workorder
from fieldloom.plans import search
from fieldloom.plans import sqltext as S
from fieldloom.plans.search import _ASKED, _CLEAN, _CUT
from fieldloom.session import spread, table
from fieldloom.sources import files

_BLANK = r"[\s\x{A0}\x{3000}\x{2000}-\x{200A}\x{202F}\x{205F}\x{85}\x{2028}\x{2029}]"


def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


def text_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "work_orders")
    return o.select("record_id", T.short_hash(F.col("source_path")).alias("hash"), T.normalize_eval_text(F.col("solution")).alias("eval_text"), T.normalize_work_order_id(F.col("source_path")).alias("order_id"), F.length(T.normalize_text(F.coalesce("raw_text", F.lit("")))).alias("n"))


def file_name_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes, descriptions and titles of the files that documents come from."""
    m = table(spark, d, "index_documents").where(F.col("source_path").isNotNull()).select("doc_id", F.regexp_replace("source_path", r"\Amanual_md/", "").alias("path"))
    return m.select("doc_id", *manuals.path_metadata(F.col("path"))).select("doc_id", "machine_type", "manual_section", "fault_code", "fault_description", "doc_type", "file_name")


def fault_codes_in_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(T.fault_codes(F.col("text"))).alias("code")).groupBy("code").agg(F.count("*").alias("documents"))


def trigram_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each fault's description to its directory name."""
    return table(spark, d, "fault_codes").select("fault_code", F.round(T.trigram_similarity(F.col("fault_description"), F.col("system_dir")), 6).alias("similarity"))


def part_cells(spark: SparkSession, d: str) -> DataFrame:
    """Comma-separated part names, a row for each value."""
    return table(spark, d, "part_evidence").where("part_number_name is not null").select("part_id", F.posexplode(T.split_cell(F.col("part_number_name"))).alias("pos", "value")).select("part_id", F.col("pos").cast("int").alias("pos"), "value")


def parsed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Every file parsed again from its text."""
    p = workorder.parse_orders(spread(table(spark, d, "work_orders").select("record_id", "raw_text"), spark), "raw_text", "record_id")
    return p.select("record_id", "status", "work_order_id", "reported_issue", "solution", "remarks", F.size("parts").alias("parts"), F.array_join("parse_warnings", "|").alias("parse_warnings"))


def parse_report(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "work_orders").select("parts", "parse_warnings", F.when(F.col("raw_text").isNull(), "failed").otherwise("parsed").alias("status"))
    return workorder.batch_report(o)


def export_parts(spark: SparkSession, d: str) -> DataFrame:
    return files.part_table(table(spark, d, "work_orders"))


def markdown_pages(spark: SparkSession, d: str) -> DataFrame:
    """Manual texts as pages: HTML where it occurs becomes Markdown."""
    x = table(spark, d, "index_documents").where(F.col("doc_type").startswith("manual"))
    return x.select("doc_id", T.table_count(F.col("text")).alias("tables"), html.markdown(F.col("text")).alias("markdown"))


def table_counts_in_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_documents").select("doc_id", T.table_count(F.col("text")).cast("bigint").alias("tables"))


def manual_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The documents table's texts as manual pages, in chunks of 400 characters."""
    p = table(spark, d, "documents").select(F.concat(F.coalesce("machine_type", F.lit("X")), F.lit("/典型故障解析/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    m = manuals.manual_documents(p, "path", "text", 400)
    return m.select("doc_id", "doc_type", "title", F.length(F.col("fields")["chunk_text"]).alias("n"), F.col("metadata")["chunk_count"].alias("chunk_count"))


def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents, from an empty store on, by a deterministic provider."""
    docs = table(spark, d, "index_documents").select("doc_id", "text")
    have = docs.where(F.lit(False)).select("doc_id", F.lit("hash").alias("provider"), F.lit("hash-64").alias("model"))
    return embed.backfill(docs, have, embed.hash_provider(), "hash", "hash-64").select("doc_id", "provider", "model", "dimensions", F.element_at("embedding", 1).alias("first"))


# --- evidence ------------------------------------------------------------------------------------


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part_evidence").select(F.lit(1).alias("query_id"), "part_id", "work_order_id", "part_number_name", "part_name", "part_code", "part_number", "quantity")


def part_dedup(spark: SparkSession, d: str) -> DataFrame:
    return evidence.distinct_parts(_parts(spark, d), ("part_id",)).select("work_order_id", "name", "code", "quantity", "part_id")


def coded_parts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.coded_parts(_parts(spark, d), ("part_id",)).select("work_order_id", "name", "code", "quantity", "part_id")


def accepted_orders(spark: SparkSession, d: str) -> DataFrame:
    """Review verdicts as judgements of relevance."""
    j = table(spark, d, "review_labels").select("label_id", F.when(F.col("label") == "abusive", "High ").when(F.col("label") == "none", "可能相关").otherwise("low").alias("level"), F.when(F.col("doc_id") % 3 == 0, False).alias("related"))
    return evidence.accepted(j).select("label_id", evidence.relevance(F.col("level")).alias("level"))


def merged_parts(spark: SparkSession, d: str) -> DataFrame:
    """Coded parts of the orders before those of the catalog; position tells which row won."""
    p = _parts(spark, d).withColumnRenamed("part_id", "position")
    c = table(spark, d, "part_catalog").select(F.lit(1).alias("query_id"), F.conv(F.substring(F.md5("part_code"), 1, 8), 16, 10).cast("bigint").alias("position"), "part_name", "part_code", "part_number")
    return evidence.merge_coded(p, c).select("work_order_id", "name", "code", "quantity", "position")


# --- evaluation ----------------------------------------------------------------------------------


def _expected(parts: DataFrame) -> DataFrame:
    """(query_id, expected): every coded part of the order, in its order."""
    part = F.struct(F.coalesce("part_name", F.lit("")).alias("name"), F.col("part_code").alias("code"), F.lit("").alias("quantity")).alias("p")
    own = parts.where("part_code is not null").groupBy(F.col("record_id").alias("query_id")).agg(F.sort_array(F.collect_list(F.struct("part_ord", part))).alias("x"))
    return own.select("query_id", F.transform("x", lambda s: s["p"]).alias("expected"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Each question expects all coded parts of its own order, and that order.

    Of the parts that come with the found orders only those of an expected code can be matched, so only these are gathered, at most as
    many of each (name, code, quantity) as are expected; the others are counted.
    """
    q = search.questions(spark, d)
    found = retrieval.retrieve(search.docs(spark, d), table(spark, d, "part_evidence"), q, channels=("work_orders",))
    own = _expected(table(spark, d, "part_evidence").join(q.select(F.col("query_id").alias("record_id")), "record_id", "left_semi"))
    key = lambda c: T.normalize_eval_text(F.coalesce(c, F.lit("")))
    codes = own.select("query_id", F.explode("expected").alias("e")).select("query_id", key(F.col("e.code")).alias("k")).groupBy("query_id", "k").agg(F.count("*").alias("most"))
    text = lambda *cs: F.coalesce(*(F.col(c) for c in cs), F.lit(""))
    got = found["part_evidence"].groupBy("query_id", text("part_name", "part_number_name").alias("name"), text("part_code").alias("code"), text("quantity").alias("quantity")).agg(F.min(F.struct("order_rank", "part_id")).alias("at"), F.count("*").alias("n"))
    total = got.groupBy("query_id").agg(F.sum("n").alias("total"))
    able = got.withColumn("k", key(F.col("code"))).join(codes, ["query_id", "k"]).withColumn("p", F.explode(F.array_repeat(F.struct("name", "code", "quantity"), F.least("n", "most").cast("int"))))
    lists = able.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("retrieved"))
    ids = search.docs(spark, d).where("doc_type = 'work_order'").select("doc_id", F.col("metadata")["work_order_id"].alias("wid"))
    orders = found["work_orders"].join(ids, "doc_id").groupBy("query_id").agg(F.collect_set("wid").alias("retrieved_orders"))
    wo = table(spark, d, "work_orders").select(F.col("record_id").alias("query_id"), F.col("work_order_id").alias("expected_order"))
    rows = q.join(wo, "query_id")
    for side in (own, lists, orders, total):
        rows = rows.join(side, "query_id", "left")
    j = evaluate.judge(rows.select("*", F.col("query").alias("question"), F.lit("search").alias("mode"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error"), F.col("query_id").alias("row_number")))
    return j.withColumn("unexpected", (F.coalesce("total", F.lit(0)) - F.size(F.filter("picked", lambda i: i >= 0))).cast("int"))


def batch_recall(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("query_id", "status", "part_recall", "work_order_recall", "missing", "unexpected")


def batch_order_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether each question's own order is among those found."""
    return _judged(spark, d).select("query_id", "work_order_required", "work_order_recall")


def batch_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metric_counts(_judged(spark, d))


def part_matching(spark: SparkSession, d: str) -> DataFrame:
    """Parts against the catalog's entry of the same code: name, code and quantity rules."""
    p = table(spark, d, "part_evidence").where("part_code is not null").select("part_id", "part_code", F.struct(F.coalesce("part_name", F.lit("")).alias("name"), F.col("part_code").alias("code"), F.coalesce("quantity", F.lit("")).alias("quantity")).alias("want"))
    c = table(spark, d, "part_catalog").select("part_code", F.struct(F.col("part_name").alias("name"), F.col("part_code").alias("code"), F.lit("1").alias("quantity")).alias("got"))
    return p.join(c, "part_code").select("part_id", evaluate.part_matches(F.col("want"), F.col("got")).alias("matches"))


# --- tasks ---------------------------------------------------------------------------------------


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """The events table as task events: a user's events of a day are one task."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return e.select((F.col("user_id") * 1000 + F.dayofyear("ts")).alias("id"), F.col("event_id").alias("seq"), F.col("ts").alias("updated_at"), F.when(F.col("user_id") % 2 == 0, "search").otherwise("answer").alias("task_type"), status.alias("status"), F.concat(F.lit("question  "), (F.col("user_id") % 40).cast("string")).alias("query"), F.col("event_type").alias("summary"))


def task_states(spark: SparkSession, d: str) -> DataFrame:
    return tasks.latest(_tasks(spark, d)).select("id", "task_type", "status", "summary", "created_at", "updated_at")


def task_listing(spark: SparkSession, d: str) -> DataFrame:
    return tasks.listing(tasks.latest(_tasks(spark, d)), 50).select("id", "status", "updated_at")


def question_tabs(spark: SparkSession, d: str) -> DataFrame:
    t = tasks.latest(_tasks(spark, d))
    return tasks.question_tabs(t).select("id", "query", "title", "search_task_id", "answer_task_id", "status", "summary", "updated_at")


def _failures(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part_evidence")
    return p.select(F.lit(1).alias("task_id"), F.when(F.col("part_id") % 2 == 0, "work_order").otherwise("manual").alias("stage"), F.concat("source_path", F.lit("#"), F.col("part_id").cast("string")).alias("input"), F.lit("x").alias("error"), "part_id")


def failure_resolution(spark: SparkSession, d: str) -> DataFrame:
    f = _failures(spark, d)
    return tasks.unresolved(f, f.where("part_id % 3 = 0"), f.where("part_id % 6 = 0")).select("stage", "input")


def failure_report(spark: SparkSession, d: str) -> DataFrame:
    f = _failures(spark, d)
    return tasks.resolution(f, f.where("part_id % 3 = 0"), f.where("part_id % 6 = 0"))


_ALL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "work_orders", "part_evidence", "index_documents", "parse_log", "review_labels", "part_catalog", "fault_codes", "mix_targets")


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in _ALL:
        one = table(spark, d, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (text_preview, text_normal_forms, file_name_codes, fault_codes_in_text, trigram_pairs, part_cells, parsed_orders, parse_report, export_parts, markdown_pages, table_counts_in_pages, manual_chunks, hash_embeddings, part_dedup, coded_parts, accepted_orders, merged_parts, batch_recall, batch_order_recall, batch_metrics, part_matching, task_states, task_listing, question_tabs, failure_resolution, failure_report, table_counts)}

_EVAL = lambda c: f"lower(regexp_replace(coalesce({c}, ''), '{_BLANK}+', '', 'g'))"
_GRAMS = lambda c: f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::INT, 3)))))"
_PART = f"""ap AS (SELECT part_id, {_CLEAN('work_order_id')} AS work_order_id, coalesce(nullif({_CLEAN('part_name')}, ''), nullif({_CLEAN('part_number_name')}, ''), '') AS name,
   coalesce(nullif({_CLEAN('part_code')}, ''), nullif({_CLEAN('part_number')}, ''), '') AS code, {_CLEAN('quantity')} AS quantity FROM part_evidence)"""
_TASKS = """ev AS (SELECT user_id * 1000 + dayofyear(ts) AS id, event_id AS seq, ts AS updated_at, CASE WHEN user_id % 2 = 0 THEN 'search' ELSE 'answer' END AS task_type,
   CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, 'question ' || (user_id % 40) AS query, event_type AS summary FROM events),
 t AS (SELECT id, arg_max(task_type, (updated_at, seq)) AS task_type, arg_max(status, (updated_at, seq)) AS status, arg_max(query, (updated_at, seq)) AS query, arg_max(summary, (updated_at, seq)) AS summary,
   min(updated_at) AS created_at, max(updated_at) AS updated_at FROM ev GROUP BY id)"""
_DONE = lambda s, w: f"CASE WHEN {s} = 'completed' THEN '{w}' ELSE {s} END"
_FAIL = "f AS (SELECT part_id, CASE WHEN part_id % 2 = 0 THEN 'work_order' ELSE 'manual' END AS stage, source_path || '#' || part_id AS input FROM part_evidence)"

#: expected parts are taken one after the other, each by the first part found that is free and matches
_BATCH = f"""{_CUT.replace('WITH ', 'WITH RECURSIVE ', 1)}, h AS (SELECT query_id, metadata['work_order_id'] AS w, min(rank) AS r FROM cut JOIN index_documents USING (doc_id) WHERE metadata['work_order_id'] <> '' GROUP BY ALL),
 ex AS (SELECT record_id AS query_id, list({{'n': coalesce(part_name, ''), 'c': part_code}} ORDER BY part_ord) AS e FROM part_evidence WHERE part_code IS NOT NULL AND record_id % 50 = 0 GROUP BY 1),
 re AS (SELECT query_id, list({{'n': coalesce(part_name, part_number_name, ''), 'c': coalesce(part_code, '')}} ORDER BY r, part_id) AS g FROM h JOIN part_evidence p ON p.work_order_id = h.w GROUP BY 1),
 st AS (SELECT q.query_id, coalesce(e, []) AS e, coalesce(g, []) AS g, 0 AS i, []::BIGINT[] AS used FROM asked q LEFT JOIN ex USING (query_id) LEFT JOIN re USING (query_id)
   UNION ALL SELECT query_id, e, g, i + 1, list_append(used, coalesce(list_filter(range(1, len(g) + 1), lambda j: NOT list_contains(used, j) AND {_EVAL('g[j].c')} = {_EVAL('e[i + 1].c')}
     AND (trim(e[i + 1].n) = '' OR {_EVAL('e[i + 1].n')} <> '' AND {_EVAL('g[j].n')} <> '' AND (contains({_EVAL('g[j].n')}, {_EVAL('e[i + 1].n')}) OR contains({_EVAL('e[i + 1].n')}, {_EVAL('g[j].n')}))))[1], -1)) FROM st WHERE i < len(e)),
 fin AS (SELECT query_id, len(list_filter(used, lambda x: x = -1))::INT AS missing, (len(g) - len(list_filter(used, lambda x: x > 0)))::INT AS unexpected FROM st WHERE i = len(e)),
 judged AS (SELECT f.query_id, missing, unexpected, coalesce(o.work_order_id, '') <> '' AS work_order_required, coalesce(o.work_order_id, '') = '' OR EXISTS (SELECT 1 FROM cut c JOIN index_documents d ON d.doc_id = c.doc_id WHERE c.query_id = f.query_id AND lower(d.metadata['work_order_id']) = lower(o.work_order_id)) AS work_order_recall
   FROM fin f JOIN work_orders o ON o.record_id = f.query_id)"""

SQL = {
    "text_preview": f"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{_BLANK}+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)
        SELECT doc_id, CASE WHEN length(t) <= 420 THEN t ELSE rtrim(substr(t, 1, 417)) || '...' END AS preview FROM p""",
    "part_cells": f"""SELECT part_id, (row_number() OVER (PARTITION BY part_id ORDER BY i) - 1)::INT AS pos, v AS value FROM (SELECT part_id, i, {_CLEAN('v')} AS v FROM (SELECT part_id, unnest(regexp_split_to_array(part_number_name, '[，,]')) AS v, unnest(range(1, len(regexp_split_to_array(part_number_name, '[，,]')) + 1)) AS i
        FROM part_evidence WHERE part_number_name IS NOT NULL)) WHERE v <> ''""",
    "parse_report": """SELECT count(*) AS files, count_if(raw_text IS NOT NULL) AS parsed, count_if(raw_text IS NULL) AS failed, coalesce(sum(coalesce(len(parts), 0)), 0)::BIGINT AS parts, count_if(len(parts) > 0) AS with_parts, count_if(len(parse_warnings) > 0) AS with_warnings, count_if(list_contains(parse_warnings, 'missing_reported_issue')) AS missing_reported_issue, count_if(list_contains(parse_warnings, 'missing_solution')) AS missing_solution FROM work_orders""",
    "export_parts": """SELECT work_order_id, reported_issue, solution, remarks, p.part_number_name, p.part_number, p.part_name, p.part_code, p.quantity, p.raw_text, source_path, array_to_string(parse_warnings, '|') AS parse_warnings
        FROM (SELECT *, unnest(parts) AS p FROM work_orders)""",
    "table_counts_in_pages": "SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '<\\s*table\\b')) AS tables FROM index_documents",
    "part_dedup": f"WITH {_PART} SELECT work_order_id, name, code, quantity, min(part_id) AS part_id FROM ap WHERE work_order_id <> '' OR name <> '' OR code <> '' OR quantity <> '' GROUP BY ALL",
    "coded_parts": f"WITH {_PART} SELECT work_order_id, name, code, quantity, min(part_id) AS part_id FROM ap WHERE code <> '' GROUP BY ALL",
    "merged_parts": f"""WITH {_PART}, b AS (SELECT work_order_id, name, code, quantity, 0 AS side, part_id AS position FROM ap WHERE code <> '' UNION ALL SELECT '', part_name, part_code, '', 1, ('0x' || substr(md5(part_code), 1, 8))::BIGINT FROM part_catalog)
        SELECT work_order_id, name, code, quantity, arg_min(position, (side, position)) AS position FROM b GROUP BY ALL""",
    "fault_codes_in_text": f"WITH c AS ({S.codes_of('doc_id', 'text', 'documents')}) SELECT code, count(*) AS documents FROM c GROUP BY code",
    "accepted_orders": "SELECT label_id, CASE WHEN label = 'abusive' THEN 'high' ELSE 'medium' END AS level FROM review_labels WHERE label IN ('abusive', 'none') AND doc_id % 3 <> 0",
    "batch_order_recall": f"""{_CUT}, h AS (SELECT query_id, metadata['work_order_id'] AS w FROM cut JOIN index_documents USING (doc_id))
        SELECT q.query_id, coalesce(o.work_order_id, '') <> '' AS work_order_required, coalesce(o.work_order_id, '') = '' OR count_if(lower(h.w) = lower(o.work_order_id)) > 0 AS work_order_recall
        FROM asked q JOIN work_orders o ON o.record_id = q.query_id LEFT JOIN h ON h.query_id = q.query_id GROUP BY q.query_id, o.work_order_id""",
    "batch_recall": f"{_BATCH} SELECT query_id, CASE WHEN missing = 0 AND work_order_recall THEN 'pass' WHEN missing = 0 AND work_order_required THEN 'warn' ELSE 'fail' END AS status, missing = 0 AS part_recall, work_order_recall, missing, unexpected FROM judged",
    "batch_metrics": f"""{_BATCH} SELECT 'part_recall' AS metric, count_if(missing = 0) AS pass, count_if(missing > 0) AS fail, 0 AS error, 0 AS skipped FROM judged UNION ALL SELECT 'work_order_recall', count_if(work_order_recall), count_if(NOT work_order_recall), 0, 0 FROM judged
        UNION ALL SELECT 'answer_part_recall', 0, 0, 0, count(*) FROM judged""",
    "part_matching": f"""SELECT part_id, (coalesce({_CLEAN('e.part_name')}, '') = '' OR {_EVAL('e.part_name')} <> '' AND {_EVAL('c.part_name')} <> '' AND (contains({_EVAL('c.part_name')}, {_EVAL('e.part_name')}) OR contains({_EVAL('e.part_name')}, {_EVAL('c.part_name')})))
        AND (coalesce({_CLEAN('e.quantity')}, '') = '' OR CASE WHEN regexp_full_match({_CLEAN('e.quantity')}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({_CLEAN('e.quantity')} AS DOUBLE) = 1 ELSE {_EVAL('e.quantity')} = '1' END) AS matches
        FROM part_evidence e JOIN part_catalog c ON c.part_code = e.part_code""",
    "task_states": f"WITH {_TASKS} SELECT id, task_type, status, summary, created_at, updated_at FROM t",
    "task_listing": f"WITH {_TASKS} SELECT id, status, updated_at FROM t ORDER BY updated_at DESC, id DESC LIMIT 50",
    "question_tabs": f"""WITH {_TASKS}, n AS (SELECT * FROM t ORDER BY updated_at DESC, id DESC LIMIT 480),
        g AS (SELECT query, arg_max(id, (updated_at, id)) FILTER (task_type = 'search') AS search_task_id, arg_max(id, (updated_at, id)) FILTER (task_type = 'answer') AS answer_task_id, arg_max(status, (updated_at, id)) FILTER (task_type = 'search') AS ss,
          arg_max(status, (updated_at, id)) FILTER (task_type = 'answer') AS sa, arg_max(summary, (updated_at, id)) FILTER (task_type = 'search') AS ys, arg_max(summary, (updated_at, id)) FILTER (task_type = 'answer') AS ya, max(updated_at) AS updated_at FROM n GROUP BY query)
        SELECT 'q-server-' || substr(sha1(query), 1, 16) AS id, query, query AS title, search_task_id, answer_task_id, CASE WHEN answer_task_id IS NOT NULL THEN {_DONE('sa', 'answered')} ELSE {_DONE('ss', 'searched')} END AS status,
          CASE WHEN answer_task_id IS NOT NULL THEN ya ELSE ys END AS summary, updated_at FROM g""",
    "failure_resolution": f"WITH {_FAIL} SELECT stage, input FROM f WHERE NOT (part_id % 3 = 0 AND part_id % 6 <> 0)",
    "failure_report": f"WITH {_FAIL} SELECT count_if(part_id % 3 = 0) AS attempted, count_if(part_id % 3 = 0 AND part_id % 6 <> 0) AS resolved, count_if(NOT (part_id % 3 = 0 AND part_id % 6 <> 0)) AS unresolved, 'completed_with_errors' AS status FROM f",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _ALL),
    "text_normal_forms": f"""SELECT record_id, substr(sha1(source_path), 1, 12) AS hash, {_EVAL('solution')} AS eval_text, regexp_replace(regexp_replace(source_path, '^.*/', ''), '\\.[^.]+$', '') AS order_id,
        length(regexp_replace(regexp_replace(regexp_replace(translate(replace(replace(replace(coalesce(raw_text, ''), '﻿', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '：', ':'), '[ \t　]+', ' ', 'g'), '\n{{3,}}', '\n\n', 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g'))::INT AS n FROM work_orders""",
    "file_name_codes": r"""WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(source_path, '^manual_md/', ''), '/'), lambda x: x <> '') AS parts FROM index_documents WHERE source_path IS NOT NULL),
        q AS (SELECT *, parts[-1] AS file_name, trim(regexp_replace(parts[-1], '(.)[.][^.]*$', '\\1')) AS stem, list_filter(parts, lambda x: contains(x, '典型故障解析') OR contains(x, '机器故障代码解析'))[1] AS manual_section FROM p),
        r AS (SELECT *, nullif(upper(regexp_extract(stem, '^[A-Za-z][0-9]{3,}[A-Za-z0-9_-]*')), '') AS fault_code FROM q)
        SELECT doc_id, CASE WHEN len(parts) >= 2 THEN parts[1] END AS machine_type, manual_section, fault_code, CASE WHEN fault_code IS NOT NULL THEN trim(regexp_extract(stem, '^[A-Za-z][0-9]{3,}[A-Za-z0-9_-]*\\s*(.*)$', 1)) END AS fault_description,
          CASE WHEN fault_code IS NOT NULL OR coalesce(manual_section, '') = '机器故障代码解析' THEN 'manual_fault_code' ELSE 'manual_typical_fault' END AS doc_type, file_name FROM r""".replace("\\\\", "\\"),
    "trigram_pairs": f"""WITH g AS (SELECT fault_code, {_GRAMS('fault_description')} AS a, {_GRAMS('system_dir')} AS b FROM fault_codes)
        SELECT fault_code, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END, 6) AS similarity FROM g""",
}
