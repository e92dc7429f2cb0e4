"""Jobs recorded in the task log: ingest, retries of what failed, embeddings, answers; and the views of a recorded task.

A job reports progress to the log, heeds a pause that the log asks for, and ends as completed, completed_with_errors, paused or
failed, whatever happens in it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import embed
from fieldloom.operators.evidence import Paused, Pipeline
from fieldloom.operators.ingest import IngestPaused, fill_embeddings, ingest, item_states
from fieldloom.operators.store import Store
from fieldloom.operators.tasks import TaskLog, resolved, summary
from fieldloom.sources import files

#: characters of previews and texts in views
PREVIEW, TEXT = 900, 500
KINDS = ("work_order", "manual")


def run(log: TaskLog, task: int, work: Callable[[Callable[[str, dict], None]], dict]) -> dict | None:
    """Run a job's work and record how it ended. work gets a function that records progress and returns the result; its `status` and `summary` are the task's."""
    try:
        got = work(lambda stage, state: log.progress(task, {"active_stage": stage, "state": state}))
    except (IngestPaused, Paused) as e:
        log.finish(task, "paused", str(e), {"active_stage": getattr(e, "stage", "paused"), "reason": getattr(e, "reason", str(e)), "snapshot": getattr(e, "snapshot", None)})
    except Exception as e:  # noqa: BLE001  the task carries the reason
        log.fail(task, f"{type(e).__name__}: {e}")
    else:
        log.finish(task, got.get("status", "completed"), got.get("summary", ""), got)
        return got
    return None


def failures(store: Store, paths: DataFrame | None = None, most: int = 10_000) -> list[dict]:
    """Failed sources (stage, input, error) in path order; a report lists no more than `most` of them, the store has all."""
    rows = item_states(store).where("status = 'failed'").select(F.col("source_kind").alias("stage"), F.col("source_path").alias("input"), "error")
    rows = rows if paths is None else rows.join(paths.select(F.col("path").alias("input")).distinct(), "input", "left_semi").select("stage", "input", "error")
    return [r.asDict() for r in rows.orderBy("stage", "input").limit(most).collect()]


def ingest_task(log: TaskLog, store: Store, kind: str, request: Mapping, **options: object) -> int:
    """A recorded ingest of a folder or of paths (request: root, paths). Returns the task's id."""
    task = log.create("ingest", request=dict(request) | {"kind": kind})

    def work(tell: Callable[[str, dict], None]) -> dict:
        found = files.scan(store.spark, kind, request.get("root"), request.get("paths"))
        report = ingest(store, kind, found, root=request.get("root") or "", progress=tell, paused=lambda: log.pause_requested(task), **options)
        failed = failures(store, found) if report["failed"] else []
        return {"status": report["status"], "summary": summary({k: report[k] for k in ("files", "skipped", "ingested", "failed")}), "report": report | {"failed_items": failed}}

    run(log, task, work)
    return task


def retry_request(request: Mapping, failed: list[dict]) -> dict:
    """What to read again: the failed files alone, resuming. Failures of other stages, or without a path, can't be retried; none at all is an error."""
    again = [f for f in failed if f.get("stage") in KINDS and str(f.get("input") or "").strip()]
    if not again:
        raise ValueError("the task has no failure that can be retried")
    return dict(request) | {"reset": False, "resume": True} | {f"{k}_paths": [f["input"] for f in again if f["stage"] == k] for k in KINDS}


def retry_failed(log: TaskLog, store: Store, source: int) -> int:
    """Read again what failed in a task, and take what succeeds off its failures. Returns the retry's own task."""
    before = log.result(source)
    failed = before.get("report", {}).get("failed_items", [])
    wanted = retry_request(log.request(source), failed)
    attempted = [f for f in failed if f["stage"] in KINDS and f["input"] in wanted[f"{f['stage']}_paths"]]
    task = log.create("ingest_retry", request=wanted | {"source_task": source})

    def work(tell: Callable[[str, dict], None]) -> dict:
        bad: list[dict] = []
        for kind in KINDS:
            if paths := wanted[f"{kind}_paths"]:
                found = files.scan(store.spark, kind, paths=paths)
                ingest(store, kind, found, root=wanted.get("root") or "", progress=tell, paused=lambda: log.pause_requested(task))
                bad += failures(store, found)
        after = resolved(before, task, attempted, bad)
        left = after["report"]["failed_items"]
        log.finish(source, "completed" if not left else "completed_with_errors", summary({"resolved": len(failed) - len(left), "left": len(left)}), after)
        return {"status": "completed_with_errors" if bad else "completed", "summary": summary({"retried": len(attempted), "failed": len(bad)}), "report": {"failed_items": bad}, "retry_source_task_id": source}

    run(log, task, work)
    return task


def embedding_task(log: TaskLog, store: Store, provider: embed.Provider, name: str, model: str) -> int:
    task = log.create("embedding", request={"provider": name, "model": model})

    def work(tell: Callable[[str, dict], None]) -> dict:
        n = fill_embeddings(store, provider, name, model)
        bad = store.read("embeddings").where("error is not null").select("doc_id").distinct().count()
        return {"status": "completed", "summary": summary({"embeddings": n, "with_errors": bad}), "added": n}

    run(log, task, work)
    return task


def answer_task(log: TaskLog, query: str, retrieve: Callable[[], dict], pipeline: Pipeline, again: int | None = None) -> int:
    """A recorded answer. A pause or failure leaves the task to be retried with `again`, which then records its own end there."""
    task = again if again is not None else log.create("answer", query, {"query": query})

    def work(tell: Callable[[str, dict], None]) -> dict:
        pipeline.progress = lambda stage, state: tell(stage, {"stage": stage, "keys": sorted(state)})
        out = pipeline.run(query, retrieve())
        return {"status": "completed", "summary": clip(out["answer"], 120), "result": out}

    run(log, task, work)
    return task


# --- views ---------------------------------------------------------------------------------------


def clip(x: object, limit: int = TEXT) -> str:
    """A text on one line, with three dots where it is cut."""
    text = " ".join(str(x or "").split())
    return text if len(text) <= limit else text[: limit - 3].rstrip() + "..."


def iso(at: datetime | None) -> str | None:
    """A time as ISO 8601 in UTC, to the second."""
    return None if at is None else (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC).isoformat(timespec="seconds")


def status_view(task: Mapping) -> dict:
    """What polling needs, without the stored request and result."""
    got = _object(task.get("result"))
    return {k: task.get(k) for k in ("id", "task_type", "status", "query", "summary", "error")} | {"active_stage": got.get("active_stage"), "created_at": iso(task.get("created_at")), "updated_at": iso(task.get("updated_at"))}


def answer_view(task: Mapping) -> dict:
    """The status, and of an answer what its evaluation needs: the text, short hits, parts."""
    got = _object(_object(task.get("result")).get("result"))
    package = _object(got.get("package"))
    short = {"query": got.get("query") or "", "answer": {"status": "ok" if got.get("answer") else "", "text": got.get("answer") or ""}, "work_orders": hits_view(package.get("work_orders")), "part_candidates": parts_view(package.get("parts"))}
    return status_view(task) | {"result": short}


def hits_view(hits: object) -> list[dict]:
    rows = [h for h in hits if isinstance(h, Mapping)] if isinstance(hits, list) else []
    either = lambda h, k: h.get(k) or _object(h.get("metadata")).get(k)
    return [{"rank": h.get("rank") or i, "doc_id": h.get("doc_id"), "title": h.get("title"), "score": h.get("score"), "work_order_id": either(h, "work_order_id"), "source_path": either(h, "source_path"), "body_preview": clip(h.get("body_preview"), PREVIEW)} for i, h in enumerate(rows, 1)]


def parts_view(parts: object) -> list[dict]:
    keys = ("part_name", "part_number_name", "part_number", "part_code", "quantity", "work_order_id", "source_path")
    rows = [p for p in parts if isinstance(p, Mapping)] if isinstance(parts, list) else []
    return [{k: p.get(k) or _object(p.get("metadata")).get(k) for k in keys} for p in rows]


def view(task: Mapping, name: str) -> dict:
    """A task as one of its views: status, answer, or everything."""
    return status_view(task) if name == "status" else answer_view(task) if name == "answer" else dict(task)


def _object(x: object) -> dict:
    if isinstance(x, str):
        try:
            x = json.loads(x)
        except ValueError:
            return {}
    return dict(x) if isinstance(x, Mapping) else {}
