import json
from datetime import UTC, datetime

import pytest

from fieldloom.operators import embed, evidence, jobs
from fieldloom.operators.store import Store
from fieldloom.operators.tasks import TaskLog


def test_ingest_job_and_its_retry(spark, tmp_path, monkeypatch):
    src, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    src.mkdir()
    (src / "a.txt").write_text("工单ID: A\n用户报修内容: 泵")
    (src / "b.txt").write_text("工单ID: B\n用户报修内容: 阀")
    log = TaskLog(store)
    from fieldloom.operators import workorder

    real = workorder.parse_orders
    fails = lambda df, text, *keep: real(df.withColumn("text", __import__("pyspark").sql.functions.expr("case when text not like '%阀%' then text end")), text, *keep)
    monkeypatch.setattr(workorder, "parse_orders", fails)
    task = jobs.ingest_task(log, store, "work_order", {"root": str(src)})
    row = log.task(task)
    failed = json.loads(row["result"])["report"]["failed_items"]
    assert row["status"] == "completed_with_errors" and [f["input"].rpartition("/")[2] for f in failed] == ["b.txt"]
    monkeypatch.setattr(workorder, "parse_orders", real)
    again = jobs.retry_failed(log, store, task)
    assert log.task(again)["error"] is None
    assert log.task(again)["status"] == "completed" and log.task(task)["status"] == "completed"
    report = log.result(task)["report"]
    assert report["failed_items"] == [] and report["retry_history"][0]["resolved_count"] == 1 and store.read("work_orders").count() == 2
    with pytest.raises(ValueError):
        jobs.retry_failed(log, store, task)
    filled = jobs.embedding_task(log, store, embed.hash_provider(), "hash", "hash-64")
    assert log.result(filled)["added"] == 2 and jobs.status_view(log.task(filled))["status"] == "completed"


def test_jobs_end_whatever_happens(spark, tmp_path):
    log = TaskLog(Store(spark, str(tmp_path / "store")))
    package = {"work_orders": [{"work_order_id": "W1", "title": "a", "body_preview": "x " * 900}], "parts": [{"part_code": "A1", "work_order_id": "W1"}]}
    task = jobs.answer_task(log, "q", lambda: package, evidence.Pipeline())
    assert log.task(task)["status"] == "paused" and log.result(task)["reason"] == "llm_disabled"
    jobs.answer_task(log, "q", lambda: package, evidence.Pipeline(deterministic_answer=True), again=task)
    view = jobs.view(log.task(task), "answer")
    assert view["status"] == "completed" and "A1" in view["result"]["answer"]["text"] and len(view["result"]["work_orders"][0]["body_preview"]) == jobs.PREVIEW and view["result"]["part_candidates"][0]["part_code"] == "A1"
    broken = jobs.answer_task(log, "q", lambda: 1 / 0, evidence.Pipeline())
    assert log.task(broken)["status"] == "failed" and "ZeroDivisionError" in log.task(broken)["error"]
    with pytest.raises(KeyError):
        log.task(5)


def test_small_helpers():
    assert jobs.iso(datetime(2024, 1, 2, 3, 4, 5, 6, UTC)) == "2024-01-02T03:04:05+00:00" and jobs.iso(None) is None
    assert jobs.clip("a  b\nc" * 300, 20).endswith("...") and len(jobs.clip("a  b\nc" * 300, 20)) <= 20 and jobs.clip(None) == ""
    assert jobs.retry_request({"root": "r"}, [{"stage": "manual", "input": "p"}, {"stage": "x", "input": "q"}]) == {"root": "r", "reset": False, "resume": True, "work_order_paths": [], "manual_paths": ["p"]}
    assert jobs.hits_view(None) == [] and jobs.view({"id": 1}, "all") == {"id": 1}
