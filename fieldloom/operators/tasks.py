"""Task history as an append-only log of events; every view is the latest state by task."""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import text as T
from fieldloom.operators.store import Store

SHARE_ID = r"\A(?!(?i)api)[A-Za-z0-9_-]{6,64}\z"
TABS, TABS_MOST, DEEP = 120, 300, 4


def latest(events: DataFrame) -> DataFrame:
    """The current row of each task: of each column the last value that was set, by (updated_at, seq). A requested pause survives progress events."""
    rest = [c for c in events.columns if c not in ("id", "updated_at", "seq")]
    at = F.struct("updated_at", "seq")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest if c != "status"]
    hold = F.max(F.when(F.col("status") == "pause_requested", at))
    over = F.max(F.when(F.col("status").isin("completed", "completed_with_errors", "failed", "paused"), at))
    state = F.max_by("status", F.when(F.col("status").isNotNull(), at))
    status = F.when(hold.isNotNull() & (over.isNull() | (over < hold)), "pause_requested").otherwise(state).alias("status")
    return events.groupBy("id").agg(*last, status, F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def listing(tasks: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first without the large columns; the limit is kept between 1 and 200."""
    slim = [c for c in tasks.columns if c not in ("request", "result")]
    return tasks.select(*slim).orderBy(F.desc("updated_at"), F.desc("id")).limit(min(max(limit, 1), 200))


def evaluations(tasks: DataFrame) -> DataFrame:
    r = F.col("result")
    return tasks.where(F.col("task_type") == "batch_eval").select("id", "status", "summary", "updated_at", F.get_json_object(r, "$.file_name").alias("file_name"), F.get_json_object(r, "$.share_id").alias("share_id"), F.get_json_object(r, "$.counts").alias("counts"))


def by_share_id(tasks: DataFrame, share_id: str) -> DataFrame:
    return evaluations(tasks).where((F.col("share_id") == share_id) & F.lit(share_id).rlike(SHARE_ID))


def is_share_id(x: Column) -> Column:
    return F.coalesce(x.rlike(SHARE_ID), F.lit(False))


def new_share_id() -> Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)


def question_tabs(tasks: DataFrame, limit: int = TABS) -> DataFrame:
    """One tab for each question (blanks ignored) among the newest search and answer tasks.

    The newest answer and search, the answer's status and summary before the search's, the latest time; newest first.
    """
    n = min(max(limit, 1), TABS_MOST)
    key = T.py_strip(F.regexp_replace("query", r"\s+", " "))
    t = tasks.where(F.col("task_type").isin("search", "answer") & (F.coalesce(key, F.lit("")) != "")).orderBy(F.desc("updated_at"), F.desc("id")).limit(n * DEEP)
    at = F.struct("updated_at", "id")
    of = lambda kind, c: F.max_by(c, F.when(F.col("task_type") == kind, at))
    g = t.withColumn("query", key).groupBy("query").agg(
        of("search", "id").alias("search_task_id"), of("answer", "id").alias("answer_task_id"), of("answer", "status").alias("_as"), of("search", "status").alias("_ss"),
        of("answer", "summary").alias("_ay"), of("search", "summary").alias("_sy"), F.max("updated_at").alias("updated_at"), F.max_by("id", at).alias("latest_task_id"),
    )
    answered = F.col("answer_task_id").isNotNull()
    named = lambda s, done: F.when(s == "completed", done).otherwise(F.coalesce(F.nullif(s, F.lit("")), F.lit("persisted")))
    title = F.when(F.length("query") > 24, F.concat(F.substring("query", 1, 24), F.lit("..."))).otherwise(F.col("query"))
    out = g.select(
        F.concat(F.lit("q-server-"), F.substring(F.sha1("query"), 1, 16)).alias("id"), "query", title.alias("title"), "search_task_id", "answer_task_id",
        F.when(answered, named(F.col("_as"), "answered")).otherwise(named(F.col("_ss"), "searched")).alias("status"), F.when(answered, F.col("_ay")).otherwise(F.col("_sy")).alias("summary"), "updated_at", "latest_task_id",
    )
    return out.orderBy(F.desc("updated_at"), "id").limit(n)


def retryable(failed: DataFrame) -> DataFrame:
    """Failures that can be retried: of an order or a manual, with a path. failed: (task_id, stage, input, error)."""
    return failed.where(F.col("stage").isin("work_order", "manual") & (T.clean_string(F.col("input")) != ""))


def retry_paths(failed: DataFrame) -> DataFrame:
    """(task_id, work_order_paths, manual_paths): only the failed files are read again."""
    of = lambda s: F.sort_array(F.collect_set(F.when(F.col("stage") == s, F.col("input"))))
    return retryable(failed).groupBy("task_id").agg(of("work_order").alias("work_order_paths"), of("manual").alias("manual_paths"))


def unresolved(failed: DataFrame, attempted: DataFrame, failed_again: DataFrame) -> DataFrame:
    """What is left of a task's failures: without those attempted again that didn't fail again."""
    k = ["stage", "input"]
    solved = attempted.select(*k).distinct().join(failed_again.select(*k).distinct(), k, "left_anti")
    return failed.join(solved, k, "left_anti")


def resolution(failed: DataFrame, attempted: DataFrame, failed_again: DataFrame) -> DataFrame:
    """One row: attempted, resolved, unresolved, and the task's new status."""
    k = ["stage", "input"]
    solved = attempted.select(*k).distinct().join(failed_again.select(*k).distinct(), k, "left_anti")
    left = unresolved(failed, attempted, failed_again)
    counts = attempted.agg(F.count("*").alias("attempted")).crossJoin(solved.agg(F.count("*").alias("resolved"))).crossJoin(left.agg(F.count("*").alias("unresolved")))  # one row each
    return counts.withColumn("status", F.when(F.col("unresolved") == 0, "completed").otherwise("completed_with_errors"))


def compact(task_rows: DataFrame, text: str, limit: int = 500) -> DataFrame:
    return task_rows.withColumn(text, T.clip(F.col(text), limit))


def resolved(result: dict, retry: int, attempted: list[dict], failed_again: list[dict]) -> dict:
    """A task's result after a retry: its failures without those that were attempted and didn't fail again, and the retry in its history."""
    key = lambda x: (x.get("stage"), x.get("input"))
    solved = set(map(key, attempted)) - set(map(key, failed_again))
    report = dict(result.get("report") or {})
    left = [f for f in report.get("failed_items") or [] if key(f) not in solved]
    entry = {"retry_task_id": retry, "attempted_count": len(attempted), "resolved_count": len(solved), "unresolved_count": len(left), "updated_at": datetime.now(UTC).isoformat(timespec="seconds")}
    return result | {"report": report | {"failed_items": left, "retry_history": [*(report.get("retry_history") or []), entry]}}


class TaskLog:
    """Events of tasks in a store. Every call appends one row; nothing is ever updated in place."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def _add(self, task: int, **cols: object) -> int:
        row = {"id": task, "seq": time.time_ns(), "updated_at": datetime.now(UTC), **{k: json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (dict, list)) else v for k, v in cols.items()}}
        kinds = {"id": "bigint", "seq": "bigint", "updated_at": "timestamp"}
        schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in row)
        self.store.append("tasks", self.store.spark.createDataFrame([tuple(row.values())], schema))
        return task

    def create(self, task_type: str, query: str | None = None, request: dict | None = None) -> int:
        return self._add(time.time_ns() // 1000, task_type=task_type, status="running", query=query, request=request)

    def progress(self, task: int, result: dict) -> None:
        self._add(task, status="running", result=result)

    def request_pause(self, task: int) -> None:
        self._add(task, status="pause_requested")

    def finish(self, task: int, status: str, summary: str = "", result: dict | None = None) -> None:
        self._add(task, status=status, summary=summary, **({"result": result} if result is not None else {}))

    def fail(self, task: int, error: str) -> None:
        self._add(task, status="failed", error=error)

    def current(self) -> DataFrame:
        return latest(self.store.read("tasks"))

    def task(self, task: int) -> dict:
        """One task's current row; an unknown one is an error."""
        rows = self.current().where(F.col("id") == task).collect()
        if not rows:
            raise KeyError(task)
        return rows[0].asDict()

    def result(self, task: int) -> dict:
        return json.loads(self.task(task)["result"] or "{}")

    def request(self, task: int) -> dict:
        return json.loads(self.task(task)["request"] or "{}")

    def pause_requested(self, task: int) -> bool:
        return not self.current().where((F.col("id") == task) & (F.col("status") == "pause_requested")).isEmpty()


def iso_time(at: Column) -> Column:
    """A time as ISO 8601 text to the second; the texts sort as the times do."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def ingest_summary(counts: Column) -> Column:
    """One line for a run's counters (a map)."""
    of = lambda k: F.coalesce(counts[k], F.lit(0)).cast("string")
    return F.concat_ws(" · ", *(F.concat(F.lit(f"{k} "), of(k)) for k in ("work_orders", "part_records", "manual_files", "manual_chunks", "total_documents", "failed_items")))


def search_summary(package: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """(query_id, summary) of packages: the mode and how many hits each channel has."""
    return package.select("query_id", F.concat_ws(" · ", F.col("mode"), *(F.concat(F.lit(f"{c} "), F.size(c).cast("string")) for c in channels)).alias("summary"))


def summary(report: dict) -> str:
    """One line of counters."""
    return " · ".join(f"{k} {v}" for k, v in report.items())
