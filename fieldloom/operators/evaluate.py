"""Batch evaluation of retrieval: expected against retrieved parts and orders, verdicts, metrics, export.

All questions are judged in one plan. Parts are matched greedily one to one in their given order, which is a fold over a
row's arrays and not a join.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import text as T

METRICS = ("part_recall", "work_order_recall", "answer_part_recall")
#: fixed values: header words by which the columns of an evaluation table are found, in order of preference
HEADER_WORDS = {"question": ("问题", "故障", "报修", "query", "question"), "name": ("新件备件名称", "备件名称", "名称", "name"), "code": ("新件物料编码", "物料编码", "备件编码", "编码", "code"), "quantity": ("新件数量", "数量", "quantity"), "work_order": ("工单ID", "工单", "work_order")}


def guess_column(headers: list[str], kind: str) -> str | None:
    for word in HEADER_WORDS[kind]:
        for h in headers:
            if word.lower() in h.lower():
                return h
    return None


def expected_parts(name: Column, code: Column, quantity: Column) -> Column:
    """array<struct<name, code, quantity>>: the values of three cells side by side, the shorter padded with empty ones."""
    cells = [T.split_cell(c) for c in (name, code, quantity)]
    n = F.greatest(*(F.size(c) for c in cells))
    at = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
    rows = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(*(at(c, i).alias(k) for c, k in zip(cells, ("name", "code", "quantity"), strict=True))))
    return F.filter(rows, lambda p: (p["name"] != "") | (p["code"] != "") | (p["quantity"] != ""))


def _number(x: Column) -> Column:
    """A cell as a number the way a spreadsheet script reads it: empty is 0; null if it is none."""
    t = T.py_strip(x)
    return F.when(t == "", F.lit(0.0)).when(t.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), t.try_cast("double"))


def part_matches(want: Column, got: Column) -> Column:
    """Names contain one another, codes are equal, quantities are equal as numbers or text; what isn't expected matches anything."""
    blank = lambda k: T.py_strip(want[k]) == ""
    norm = lambda p, k: T.normalize_eval_text(p[k])
    wn, gn = norm(want, "name"), norm(got, "name")
    name = blank("name") | ((wn != "") & (gn != "") & (F.contains(gn, wn) | F.contains(wn, gn)))
    code = blank("code") | (norm(want, "code") == norm(got, "code"))
    a, b = _number(want["quantity"]), _number(F.coalesce(got["quantity"], F.lit("")))
    quantity = blank("quantity") | F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(norm(want, "quantity") == norm(got, "quantity"))
    return name & code & quantity


def greedy_match(expected: Column, retrieved: Column) -> Column:
    """For each expected part, in order, the index (from 0) of the first retrieved part not yet taken that matches, or -1."""
    spots = F.sequence(F.lit(0), F.greatest(F.size(retrieved) - 1, F.lit(0)))
    free = lambda want, used: F.filter(spots, lambda i: (i < F.size(retrieved)) & ~F.array_contains(used, i) & part_matches(want, F.get(retrieved, i)))
    return F.aggregate(expected, F.array().cast("array<int>"), lambda used, want: F.concat(used, F.array(F.coalesce(F.get(free(want, used), F.lit(0)), F.lit(-1)))))


def run_rows(rows: list[dict], answer: Callable[[str], dict], threads: int = 8) -> list[dict]:
    """Ask one question a row, at most RUN_MOST at a time, and keep the rows in order. For evaluations that call models; plain searches take all
    questions in one plan.

    answer returns what judge() reads: retrieved, retrieved_orders, answer, mode. A blank question is left out without a call; a row whose
    call fails carries the reason, and the others go on.
    """

    def one(row: dict) -> dict:
        if not str(row.get("question") or "").strip():
            return row | {"error": None}
        try:
            return row | answer(str(row["question"]).strip()) | {"error": None}
        except Exception as e:  # noqa: BLE001  the row carries the reason
            return row | {"error": f"{type(e).__name__}: {e}"}

    with ThreadPoolExecutor(max(1, min(threads, RUN_MOST, len(rows) or 1))) as pool:
        return list(pool.map(one, rows))


#: fixed value: questions that are asked at the same time, at most
RUN_MOST = 16


def judge(rows: DataFrame) -> DataFrame:
    """Verdicts of rows with: expected, retrieved (arrays of parts), expected_order, retrieved_orders (array), answer, mode, error, question.

    pass: all expected parts and the order, if one is expected; warn: the parts only; fail otherwise. Surplus parts never fail a row; a row
    that expects nothing passes. A blank question is skipped, an error is an error.
    """
    none = F.array().cast("array<struct<name:string,code:string,quantity:string>>")
    r = rows.withColumn("expected", F.coalesce("expected", none)).withColumn("retrieved", F.coalesce("retrieved", none))
    r = r.withColumn("picked", greedy_match(F.col("expected"), F.col("retrieved")))
    want = T.normalize_work_order_id(F.col("expected_order"))
    ids = F.filter(F.transform(F.coalesce("retrieved_orders", F.array().cast("array<string>")), T.normalize_work_order_id), lambda i: i != "")
    key = T.normalize_eval_text(F.col("answer"))
    told = lambda p: (T.normalize_eval_text(p["code"]) != "") & F.contains(key, T.normalize_eval_text(p["code"])) | (T.normalize_eval_text(p["name"]) != "") & F.contains(key, T.normalize_eval_text(p["name"])) | ((T.normalize_eval_text(p["name"]) == "") & (T.normalize_eval_text(p["code"]) == ""))
    r = (
        r.withColumn("missing", F.size(F.filter("picked", lambda i: i == -1)))
        .withColumn("unexpected", F.size("retrieved") - F.size(F.filter("picked", lambda i: i >= 0)))
        .withColumn("part_recall", F.col("missing") == 0)
        .withColumn("work_order_required", want != "")
        .withColumn("work_order_recall", (want == "") | F.exists(ids, lambda i: T.normalize_eval_text(i) == T.normalize_eval_text(want)))
        .withColumn("answer_available", F.coalesce(F.col("mode") == "answer", F.lit(False)))
        .withColumn("answer_part_recall", ~F.col("answer_available") | F.forall("expected", told))
    )
    verdict = F.when(F.col("error").isNotNull(), "error").when(T.clean_string(F.col("question")) == "", "skipped").when(F.col("part_recall") & F.col("work_order_recall"), "pass").when(F.col("part_recall") & F.col("work_order_required"), "warn").otherwise("fail")
    return r.withColumn("status", verdict)


def metric_status(metric: str) -> Column:
    ok = F.when(F.col(metric), "pass").otherwise("fail")
    if metric == "answer_part_recall":
        ok = F.when(~F.col("answer_available"), "skipped").otherwise(ok)
    return F.when(F.col("status").isin("error", "skipped"), F.col("status")).otherwise(ok)


def metric_counts(judged: DataFrame) -> DataFrame:
    """(metric, pass, fail, error, skipped): one pass over the verdicts."""
    long = judged.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), metric_status(m).alias("s")) for m in METRICS))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(*(F.count_if(F.col("s") == s).alias(s) for s in ("pass", "fail", "error", "skipped")))


def order_counts(judged: DataFrame) -> DataFrame:
    need = F.col("work_order_required")
    return judged.agg(F.count("*").alias("done"), F.count_if(need).alias("work_order_required"), F.count_if(need & F.col("work_order_recall")).alias("work_order_pass"), F.count_if(F.size("expected") == 0).alias("without_expectation"))


def export_rows(judged: DataFrame) -> DataFrame:
    """The 14 columns of the export as text, in row order."""
    names = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(" ", p["name"], p["code"], p["quantity"])), "；")
    cols = {
        "row_number": "row_number", "question": "question", "mode": "mode", "status": "status", "part_recall": "part_recall", "work_order_recall": "work_order_recall", "answer_part_recall": "answer_part_recall",
        "expected_order": "expected_order", "missing": "missing", "unexpected": "unexpected", "error": "error",
    }
    base = [F.coalesce(F.col(v).cast("string"), F.lit("")).alias(k) for k, v in cols.items()]
    return judged.orderBy("row_number").select(*base, names("expected").alias("expected_parts"), names("retrieved").alias("retrieved_parts"), F.array_join(F.coalesce("retrieved_orders", F.array().cast("array<string>")), "；").alias("retrieved_orders"))
