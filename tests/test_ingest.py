import pytest

from fieldloom.operators import embed
from fieldloom.operators.ingest import COUNTERS, IngestPaused, ingest, item_states, latest_runs
from fieldloom.operators.store import Change, Store
from fieldloom.operators.tasks import TaskLog, summary
from fieldloom.sources import files
from fieldloom.streaming.ingest import event_rates, ingest_stream


def write(d, name, text):
    (d / name).parent.mkdir(parents=True, exist_ok=True)
    (d / name).write_text(text)


def size_of(d):
    return sum(f.stat().st_size for f in d.rglob("*.parquet"))


def test_resumable_ingest(spark, tmp_path):
    src, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    write(src, "a.txt", "工单ID: A\n用户报修内容: 泵\n备件信息:\n备件名称: 泵; 备件编码: P1")
    write(src, "b.txt", "工单ID: B\n用户报修内容: 阀")
    scan = lambda: files.scan(spark, "work_order", str(src))
    told = []
    got = ingest(store, "work_order", scan(), progress=lambda stage, x: told.append((stage, x["percent"])))
    assert {k: got[k] for k in ("files", "skipped", "ingested", "failed", "documents", "status")} == {"files": 2, "skipped": 0, "ingested": 2, "failed": 0, "documents": 3, "status": "completed"}
    assert set(got["counts"]) == set(COUNTERS) and (got["counts"]["work_orders"], got["counts"]["part_records"], got["counts"]["work_order_files"]) == (2, 1, 2) and got["counts"]["term_rows"] > 5
    assert told == [("scanned", 0.0), ("committed", 100.0)] and {"scan", "parse", "commit"} <= set(got["timings"])
    assert ingest(store, "work_order", scan())["skipped"] == 2
    write(src, "a.txt", "工单ID: A\n用户报修内容: 换泵")
    assert ingest(store, "work_order", scan())["ingested"] == 1
    assert sorted(r.doc_id for r in store.read("documents").collect()) == ["wo:A", "wo:B"]
    assert {r.status for r in item_states(store).collect()} == {"completed"} and {r.status for r in store.read("ingest_items").collect()} == {"running", "completed"}
    assert {r.term for r in store.read("postings").collect()} >= {"换泵", "阀"} and not store.read("postings").where("term = 'p1'").collect()
    runs = latest_runs(store).collect()
    assert len(runs) == 3 and {r.status for r in runs} == {"completed"} and all(r.completed_at and r.counts["failed_items"] == 0 for r in runs)
    write(src, "c.txt", "x")
    with pytest.raises(IngestPaused):
        ingest(store, "work_order", scan(), paused=lambda: True)
    assert {r.status for r in latest_runs(store).collect()} == {"completed", "paused"}
    store.clear(tasks=False)
    assert {r.table: r.rows for r in store.counts().collect()}["documents"] == 0


def test_groups_are_committed_one_by_one(spark, tmp_path):
    src, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    for i in range(12):
        write(src, f"{i}.txt", f"工单ID: W{i}\n用户报修内容: 泵{i}")
    scan = lambda: files.scan(spark, "work_order", str(src))
    calls = []
    with pytest.raises(IngestPaused):
        ingest(store, "work_order", scan(), group=4, paused=lambda: calls.append(1) or len(calls) > 1)
    done = item_states(store).where("status = 'completed'").count()
    assert 0 < done < 12 and store.read("work_orders").count() == done
    assert ingest(store, "work_order", scan(), group=4)["skipped"] == done and store.read("work_orders").count() == 12


def test_a_change_costs_what_it_changes(spark, tmp_path):
    src, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    for i in range(300):
        write(src, f"{i}.txt", f"工单ID: W{i}\n用户报修内容: " + "".join(chr(0x4E00 + (i * 37 + k * k) % 5000) for k in range(400)))
    scan = lambda: files.scan(spark, "work_order", str(src))
    ingest(store, "work_order", scan())
    whole = size_of(tmp_path / "store" / "data")
    write(src, "7.txt", "工单ID: W7\n用户报修内容: 阀")
    ingest(store, "work_order", scan())
    assert size_of(tmp_path / "store" / "data") - whole < whole / 10
    assert store.read("documents").count() == 300 and store.read("documents").where("doc_id = 'wo:W7'").head().fields["reported_issue"] == "阀"


def test_a_crash_leaves_the_commit_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    row = lambda d, s: spark.createDataFrame([(d, s)], "doc_id string, source_path string")
    store.append("documents", row("a", "1"))
    before = store.read("documents")
    (tmp_path / "store" / "log" / "000000000002.json").write_text('{"schema": 2, "nu')  # a commit that was cut off
    assert [r.doc_id for r in store.read("documents").collect()] == ["a"]

    class Stop(Exception):
        pass

    def fail(*_):
        raise Stop

    publish, store._publish = store._publish, fail
    with pytest.raises(Stop):
        store.commit(Change("documents", row("b", "1"), row("b", "1")))
    store._publish = publish
    assert [r.doc_id for r in store.read("documents").collect()] == ["a"]
    store.commit(Change("documents", row("c", "1"), row("c", "1")), Change("tasks", spark.createDataFrame([(1,)], "id long")))
    assert [r.doc_id for r in store.read("documents").collect()] == ["c"] and [r.doc_id for r in before.collect()] == ["a"] and store.state()["number"] == 3


def test_fold_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    row = lambda d, s: spark.createDataFrame([(d, s)], "doc_id string, source_path string")
    for i in range(5):
        store.commit(Change("documents", row(f"d{i}", str(i % 3)), row("", str(i % 3))))
    rows = sorted(r.doc_id for r in store.read("documents").collect())
    assert rows == ["d2", "d3", "d4"]
    store.compact("documents")
    assert sorted(r.doc_id for r in store.read("documents").collect()) == rows and len(store.state()["tables"]["documents"]) == 1
    assert store.vacuum(keep=1) == 10 and sorted(r.doc_id for r in store.read("documents").collect()) == rows
    store.commit(Change("documents", row("d9", "1"), row("", "1")))
    assert sorted(r.doc_id for r in store.read("documents").collect()) == ["d2", "d3", "d9"]


def test_writers_at_once_both_count(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    state = a.state
    a.state = lambda: b.append("tasks", spark.createDataFrame([(2,)], "id long")) or setattr(a, "state", state) or {"schema": 2, "number": 0, "tables": {}}
    a.append("tasks", spark.createDataFrame([(1,)], "id long"))
    assert sorted(r.id for r in a.read("tasks").collect()) == [1, 2]


def test_store_of_a_later_schema_is_refused(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "000000000001.json").write_text('{"schema": 99, "number": 1, "tables": {}}')
    with pytest.raises(ValueError, match="schema 99"):
        Store(spark, str(tmp_path)).read("tasks")


def test_manual_ingest(spark, tmp_path):
    src, store = tmp_path / "m", Store(spark, str(tmp_path / "store"))
    write(src, "QF/机器故障代码解析/E00131 泵.html", "<h1>泵</h1><p>漏油</p>")
    write(src, "QF/典型故障解析/x.md", "# 阀\n卡滞")
    run = lambda: ingest(store, "manual", files.scan(spark, "manual", str(src)), root=str(src), provider=embed.hash_provider())
    first = run()
    assert first["documents"] == 2 and (first["counts"]["manual_files"], first["counts"]["manual_chunks"], first["counts"]["html_converted_in_memory"], first["counts"]["embeddings"]) == (2, 2, 1, 2)
    got = {r.doc_type: r.fields["chunk_text"] for r in store.read("documents").collect()}
    assert got == {"manual_fault_code": "# 泵\n\n漏油", "manual_typical_fault": "# 阀\n卡滞"}
    write(src, "QF/典型故障解析/x.md", " ")
    assert run()["counts"]["embeddings"] == 0
    assert [r.doc_type for r in store.read("documents").collect()] == ["manual_fault_code"] and store.read("embeddings").count() == 1


def test_stream(spark, tmp_path):
    src, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    write(src, "a.txt", "工单ID: A\n用户报修内容: 泵")
    for _ in range(2):
        ingest_stream(spark, str(src), store, str(tmp_path / "cp")).awaitTermination()
        write(src, "b.txt", "工单ID: B")
    assert store.read("work_orders").count() == 2


def test_event_rates(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value")
    assert [(r.n, r.value) for r in event_rates(e).collect()] == [(2, 3.0)]


def test_task_log(spark, tmp_path):
    log = TaskLog(Store(spark, str(tmp_path / "store")))
    a, b = log.create("ingest", request={"dir": "x"}), log.create("search", "q")
    log.progress(a, {"done": 1})
    log.request_pause(a)
    log.progress(a, {"done": 2})
    assert log.pause_requested(a) and not log.pause_requested(b)
    log.finish(a, "completed", summary({"files": 2}))
    log.fail(b, "boom")
    got = {r.id: (r.status, r.summary, r.result, r.error) for r in log.current().collect()}
    assert got == {a: ("completed", "files 2", '{"done": 2}', None), b: ("failed", None, None, "boom")}
