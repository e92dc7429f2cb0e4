import json
import sys

import pytest
from pyspark.sql import functions as F

from fieldloom.__main__ import main
from fieldloom.operators import models


def test_request_log_hides_secrets(tmp_path):
    p = tmp_path / "d" / "log.jsonl"
    models.log_request(p, "chat", "https://u:pw@h/x?api_key=abc&q=1", {"Authorization": "Bearer x", "A": "b"}, {"api_key": "s", "text": "t" * 900}, {"embeddings": [[0.1] * 64]})
    row = json.loads(p.read_text())
    assert "pw" not in row["url"] and "abc" not in row["url"] and row["headers"] == {"Authorization": "***", "A": "b"}
    assert row["request"]["api_key"] == "***" and len(row["request"]["text"]) == 503 and row["reply"]["embeddings"] == ["vector of 64"]


def test_rerank_shapes():
    assert models.rerank_scores({"output": {"results": [{"index": 1, "relevance_score": 0.5}, {"index": 9, "score": 1}]}}, 2) == [0.0, 0.5]
    assert models.rerank_scores({"data": [{"index": 0, "score": 2}]}, 1) == [2.0] and models.rerank_scores({}, 1) == [0.0]
    assert models.reranker(lambda q, t: {"results": [{"index": 0, "score": len(t[0])}]}, lambda h: h["t"], 3)("q", [{"t": "abcdef"}]) == [3.0]


def test_command_provider():
    code = "import json,sys; d=json.load(sys.stdin); json.dump({'embeddings': [[float(len(t))] for t in d['texts']]}, sys.stdout)"
    run = models.command_provider(f'{sys.executable} -c "{code}"')
    assert run(["a", "bcd"]) == [[1.0], [3.0]]
    with pytest.raises(RuntimeError):
        models.command_provider(f'{sys.executable} -c "raise SystemExit(3)"')(["a"])


def test_rerank_results_are_sorted():
    reply = {"results": [{"index": 2, "score": 0.5}, {"index": 0, "score": 0.5}, {"index": 1, "score": 0.9}, {"index": "x"}]}
    assert models.rerank_results(reply, 3) == [(1, 0.9), (0, 0.5), (2, 0.5)] and models.rerank_results(reply, 3, 1) == [(1, 0.9)]


def test_http_provider_checks_what_it_gets():
    sent = []

    def post(url, headers, body, timeout):
        sent.append((headers, body["input"]))
        return {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}

    run = models.http_provider("http://x", "m", "key", batch=2, post=post)
    assert run(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]] and [b for _, b in sent] == [["a", "bb"], ["ccc"]] and sent[0][0] == {"Authorization": "Bearer key"}
    with pytest.raises(ValueError):
        models.http_provider("http://x", "m", post=lambda *_: {"data": []})(["a"])


def test_vector_literals(spark):
    from fieldloom.functions import vector

    df = spark.createDataFrame([([1.0, 0.5, -0.1],), ([1e-7, 123456.789],), ([],), ([float("nan")],), (None,), ([3.0, 1.23456789012345],)], "v array<double>")
    got = [r[0] for r in df.select(vector.literal(F.col("v"))).collect()]
    assert got[2:5] == [None] * 3
    for text, want in zip([got[0], got[1], got[5]], [[1.0, 0.5, -0.1], [1e-7, 123456.789], [3.0, 1.23456789012345]], strict=True):
        assert [float(x) for x in text[1:-1].split(",")] == [float(f"{x:.12g}") for x in want]


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("工单ID: W1\n用户报修内容: 风扇皮带断裂\n人员落实及解决方法: 更换\n备件信息:\n备件名称: 风扇皮带; 备件编码: 310900001; 数量: 1")
    (src / "b.txt").write_text("工单ID: W2\n用户报修内容: 行走无力")
    (src / "p.html").write_text("<h1>泵</h1>")
    run = lambda *a: main(list(a)) or json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert run("parse-workorders", str(src), str(tmp_path / "out"))["parts"] == 1
    assert run("html-to-md", str(src), str(tmp_path / "md")) == {"pages": 1, "found": 1, "converted": 1, "failed": 0, "skipped": 0, "tables": 0}
    assert run("html-to-md", str(src), str(tmp_path / "md"))["skipped"] == 1 and json.loads((tmp_path / "md.report.json").read_text())["pages"] == 1
    assert json.loads((tmp_path / "out" / "report.json").read_text())["missing_solution"] == 1
    assert run("ingest", str(src), str(tmp_path / "store"), "--hash-vectors")["counts"]["embeddings"] == 3
    got = run("search", str(tmp_path / "store"), "风扇皮带断了")
    assert got["work_orders"][0]["work_order_id"] == "W1" and got["parts"][0]["part_code"] == "310900001"
    hybrid = run("search", str(tmp_path / "store"), "风扇皮带断了", "--hash-vectors", "--debug")
    assert hybrid["mode"] == "hybrid" and hybrid["work_orders"][0]["mode"] == "hybrid" and hybrid["warnings"] == [] and hybrid["debug"]["retrieval_events"][0]["stage"] == "threshold_filter"
    down = run("search", str(tmp_path / "store"), "风扇皮带断了", "--provider-command", "false")
    assert down["work_orders"][0]["mode"] == "bm25" and "query_embedding" in down["warnings"][0]
    manifest = run("export-index", str(tmp_path / "store"), str(tmp_path / "index"))
    assert manifest["counts"]["documents"] == 3 and json.loads((tmp_path / "index" / "manifest.json").read_text())["tokenizer"]["chinese_ngrams"] == [2, 3]
    assert "310900001" in run("ask", str(tmp_path / "store"), "风扇皮带断了")["answer"]


def test_all_documents_are_embedded(spark, tmp_path):
    from pyspark.sql import functions as F

    from fieldloom.operators import embed
    from fieldloom.plans import upkeep

    docs = spark.createDataFrame([(str(i), f"text {i}") for i in range(20)], "doc_id string, text string")
    docs.write.parquet(f"{tmp_path}/index_documents.parquet")
    assert {r.doc_id for r in upkeep.hash_embeddings(spark, str(tmp_path)).collect()} == {str(i) for i in range(20)}
    have = docs.where("doc_id < '5'").select("doc_id", F.lit("hash").alias("provider"), F.lit("hash-64").alias("model"))
    got = embed.backfill(docs, have, embed.hash_provider(), "hash", "hash-64").collect()
    assert {r.doc_id for r in got} == {str(i) for i in range(5, 10)}
