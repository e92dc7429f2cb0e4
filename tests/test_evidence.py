import json

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import evaluate, evidence, tasks


def test_distinct_and_merged_parts(spark):
    p = spark.createDataFrame([(1, 3, "W", "泵", "A1", "1"), (1, 1, "W", " 泵", "A1", "1"), (1, 2, "W", "阀", None, ""), (1, 4, None, None, None, None), (2, 1, "W", "泵", "A1", "1")], "query_id int, position int, work_order_id string, part_name string, part_code string, quantity string")
    got = evidence.distinct_parts(p, ("position",)).orderBy("query_id", "position").collect()
    assert [(r.query_id, r.position, r.name, r.code) for r in got] == [(1, 1, "泵", "A1"), (1, 2, "阀", ""), (2, 1, "泵", "A1")]
    assert evidence.coded_parts(p, ("position",)).count() == 2
    assert evidence.merge_coded(p, p).count() == 2
    assert evidence.distinct_parts(p.limit(0), ("position",)).count() == 0


def test_replies():
    assert evidence.parse_object('```json\n{"a": 1}\n```') == {"a": 1}
    for bad in ("[1]", "no", ""):
        with pytest.raises(ValueError):
            evidence.parse_object(bad)
    assert evidence.level("高度相关") == "high" and evidence.level(None) == "unknown"


PACKAGE = {"work_orders": [{"work_order_id": "W1", "title": "a"}, {"work_order_id": "W2", "title": "b"}], "manuals": [{"doc_id": "m1", "title": "t"}], "fault_codes": [], "parts": [{"work_order_id": "W1", "part_name": "泵", "part_code": "A1", "quantity": "1"}, {"work_order_id": "W2", "part_code": "B2"}]}


def client(task, payload):
    if task == "work_order_filter":
        return '{"relevance_level": "high", "related": true}' if payload["hit"]["work_order_id"] == "W1" else "not json"
    if task == "manual_filter":
        return '{"selected": [{"doc_id": "m1", "relevance_level": "medium"}]}'
    return "{}" if task == "fact_extraction" else "answer: " + json.dumps(payload)[:20]


def test_pipeline():
    seen = []
    out = evidence.Pipeline(client, progress=lambda s, _: seen.append(s)).run("q", PACKAGE)
    assert seen == list(evidence.STAGES)
    assert [o["work_order_id"] for o in out["orders"]] == ["W1"] and out["rejected_orders"][0]["level"] == "unknown"
    assert out["facts"]["coded_parts"] == [{"name": "泵", "code": "A1", "quantity": "1", "work_order_id": "W1"}]
    assert "W2" not in json.dumps(out["context"]) and len(out["manuals"]) == 1


def test_manual_verdicts_are_kept():
    manuals = [{"doc_id": x, "title": x} for x in "abcd"]
    reply = '{"selected": [{"doc_id": "a"}, {"doc_id": "b", "relevance_level": "low"}, {"doc_id": "?"}], "rejected": [{"doc_id": "c", "reason": "other machine"}]}'
    pick = lambda text: evidence.Pipeline(lambda task, payload: text if task == "manual_filter" else client(task, payload)).run("q", PACKAGE | {"manuals": manuals})
    out = pick(reply)
    assert [(m["doc_id"], m["level"]) for m in out["manuals"]] == [("a", "medium")]
    assert [(m["doc_id"], m["reason"]) for m in out["rejected_manuals"]] == [("b", "not graded as relevant"), ("c", "other machine"), ("d", "not named by the model")]
    bad = pick("I can't say")
    assert [m["doc_id"] for m in bad["manuals"]] == list("abcd") and bad["rejected_manuals"] == [] and {m["level"] for m in bad["manuals"]} == {"medium"}
    assert next(t for t in bad["trace"] if t["stage"] == "manual_filter")["status"] == "fallback"


def test_reranking():
    hits = [{"work_order_id": x} for x in "abc"]
    assert [h["work_order_id"] for h in evidence.reordered(hits, [0.1, 0.9, 0.9], 2)] == ["b", "c"]

    def broken(query, found):
        raise RuntimeError("away")

    out = evidence.Pipeline(deterministic_answer=True, rerank=broken).run("q", PACKAGE)
    assert len(out["orders"]) == 2 and out["trace"][0]["rerank"] == "fallback"
    assert evidence.rerank_text({"title": "t", "body_preview": "b", "channel": None}, 9) == "title: t\n"[:9] + ""
    text = evidence.render_plain("q", [{"doc_type": "manual_typical_fault", "title": "T", "doc_id": "m", "body_preview": "p"}], [])
    assert "- T" in text and "- 参考 m: p" in text and "未召回" in text


def test_rows_are_run_apart():
    def answer(question):
        if question == "bad":
            raise RuntimeError("boom")
        return {"retrieved": [question]}

    got = evaluate.run_rows([{"question": " a "}, {"question": "bad"}, {"question": " "}, {"question": None}], answer, threads=99)
    assert [g.get("error") for g in got] == [None, "RuntimeError: boom", None, None] and got[0]["retrieved"] == ["a"] and "retrieved" not in got[2]


def test_pipeline_pauses():
    def broken(task, payload):
        raise evidence.ProviderError("down")

    with pytest.raises(evidence.Paused) as e:
        evidence.Pipeline(broken).run("q", PACKAGE)
    assert e.value.stage == "work_order_filter"
    with pytest.raises(evidence.Paused) as e:
        evidence.Pipeline().run("q", PACKAGE)
    assert e.value.reason == "llm_disabled" and len(e.value.snapshot["orders"]) == 2
    text = evidence.Pipeline(deterministic_answer=True).run("q", PACKAGE)["answer"]
    assert "A1" in text and "W2" in text


PARTS = "array<struct<name:string,code:string,quantity:string>>"


def judged(spark, rows):
    cols = f"row_number int, question string, expected {PARTS}, retrieved {PARTS}, expected_order string, retrieved_orders array<string>, answer string, mode string, error string"
    return evaluate.judge(spark.createDataFrame(rows, cols)).orderBy("row_number").collect()


def test_verdicts(spark):
    a, b = ("泵", "A1", "1"), ("", "B2", "")
    got = judged(spark, [
        (1, "q", [a, b], [("液压泵 ", "a1", "1.0"), ("x", "B2", "9"), ("y", "C", "")], "dir/w1.txt", ["wo:W1"], None, "search", None),
        (2, "q", [a], [("泵", "A1", "1")], "W1", ["W2"], "用 A1", "answer", None),
        (3, "q", [a, a], [("泵", "A1", "1")], "", None, "none", "answer", None),
        (4, "q", None, None, None, None, None, "search", None),
        (5, " ", [], [], None, None, None, "search", None),
        (6, "q", [], [], None, None, None, "search", "boom"),
        (7, "q", [("", "", "0")], [("", "", "")], None, None, None, "search", None),
    ])
    assert [r.status for r in got] == ["pass", "warn", "fail", "pass", "skipped", "error", "pass"]
    assert (got[0].unexpected, got[2].missing, got[1].answer_part_recall, got[2].answer_part_recall) == (1, 1, True, False)


def test_all_coded_parts_are_expected(spark):
    from fieldloom.plans import upkeep

    rows = [(1, 1, "a", "A"), (1, 4, "d", "D"), (1, 3, None, "C"), (1, 2, "b", None), (2, 3, "x", "X"), (2, 4, "y", "Y"), (3, 1, "z", None)]
    got = {r.query_id: [tuple(p) for p in r.expected] for r in upkeep._expected(spark.createDataFrame(rows, "record_id long, part_ord int, part_name string, part_code string")).collect()}
    assert got == {1: [("a", "A", ""), ("", "C", ""), ("d", "D", "")], 2: [("x", "X", ""), ("y", "Y", "")]}


def test_metrics_and_cells(spark):
    df = spark.createDataFrame([("a，b", "1", "")], "n string, c string, q string")
    assert [tuple(x) for x in df.select(evaluate.expected_parts(F.col("n"), F.col("c"), F.col("q"))).head()[0]] == [("a", "1", ""), ("b", "", "")]
    rows = spark.createDataFrame([(1, "q", None, None, "W", None, None, "search", None)], f"row_number int, question string, expected {PARTS}, retrieved {PARTS}, expected_order string, retrieved_orders array<string>, answer string, mode string, error string")
    j = evaluate.judge(rows)
    m = {r.metric: tuple(r)[1:] for r in evaluate.metric_counts(j).collect()}
    assert m == {"part_recall": (1, 0, 0, 0), "work_order_recall": (0, 1, 0, 0), "answer_part_recall": (0, 0, 0, 1)}
    assert len(evaluate.export_rows(j).columns) == 14
    assert evaluate.guess_column(["x", "新件物料编码"], "code") == "新件物料编码"


def test_tasks(spark):
    ev = spark.createDataFrame([(1, 1, "2024-01-01", "running", "answer", " q  1 ", None), (1, 2, "2024-01-02", "completed", None, None, "s"), (2, 3, "2024-01-03", "failed", "search", "q 1", None), (3, 4, "2024-01-01", "pause_requested", "search", "z", None), (3, 5, "2024-01-02", "running", None, None, None)], "id long, seq long, updated_at string, status string, task_type string, query string, summary string")
    t = tasks.latest(ev)
    assert {r.id: r.status for r in t.collect()} == {1: "completed", 2: "failed", 3: "pause_requested"}
    tab = tasks.question_tabs(t).collect()
    assert [(r.query, r.status, r.search_task_id, r.answer_task_id) for r in tab] == [("q 1", "answered", 2, 1), ("z", "pause_requested", 3, None)]
    f = spark.createDataFrame([(1, "work_order", "a", ""), (1, "manual", "b", ""), (1, "x", "c", ""), (1, "manual", " ", "")], "task_id int, stage string, input string, error string")
    assert tasks.retry_paths(f).collect()[0][1:] == (["a"], ["b"])
    assert tasks.resolution(f, f.where("input = 'a'"), f.limit(0)).collect()[0].asDict() == {"attempted": 1, "resolved": 1, "unresolved": 3, "status": "completed_with_errors"}
    ids = spark.createDataFrame([("abc_12",), ("api-12",), ("a.b123",), ("short",)], "x string")
    assert [r[0] for r in ids.select(tasks.is_share_id(F.col("x"))).collect()] == [True, False, False, False]
