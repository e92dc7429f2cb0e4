import numpy as np
import pyarrow as pa
import pytest

from fieldloom.operators import retrieval, scoring

DOCS = "doc_id string, doc_type string, fields map<string,string>, metadata map<string,string>"


@pytest.mark.parametrize("block", [1, 40, 10**6])
def test_blocks_keep_the_best_and_ties_by_id(monkeypatch, block):
    monkeypatch.setattr(scoring, "BLOCK", block)
    monkeypatch.setattr(scoring, "SLICE", 7)
    words = pa.array([f"w{i}" for i in range(6)])
    rng = np.random.default_rng(1)
    texts = {f"d{i:02}": [f"w{j}" for j in rng.integers(0, 9, rng.integers(0, 6))] for i in range(60)}
    ids = [str(x) for x in rng.permutation(list(texts))]
    made = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(["a"] * 60), pa.array([["solution"]] * 60), pa.array([[texts[i]] for i in ids], pa.list_(pa.list_(pa.string())))], ["doc_id", "doc_type", "names", "tokens"])
    rows = [r for b in scoring.pack(words)(iter([made])) for r in b.to_pylist()]
    told = rows[-1]
    df = np.zeros((1, 6))
    df[0, told["seen"][0]] = told["dfs"][0]
    assert told["names"] is None and [int(x) for x in df[0]] == [sum(w in t for t in texts.values()) for w in words.to_pylist()]
    assert told["fields"] == ["solution"] and told["rows"] == [60] and told["totals"] == [sum(max(len(t), 1) for t in texts.values())]
    packed = pa.RecordBatch.from_pylist(rows[:-1], pa.schema([("doc_id", pa.string()), ("doc_type", pa.string()), ("names", pa.list_(pa.string())), ("lens", pa.list_(pa.int32())), ("terms", pa.list_(pa.list_(pa.int32()))), ("tfs", pa.list_(pa.list_(pa.int32())))]))
    asks = [[0, 3], [5], [1, 2, 4]]
    avg, idf = told["totals"][0] / 60, np.log(1 + (60 - df + 0.5) / (df + 0.5))
    run = scoring.best(pa.array([10, 20, 30]), np.array([0, 2, 3, 6]), np.array(sum(asks, [])), {"a": 0}, ["x"], [5], idf, {"solution": avg})
    got = [r for b in run(iter([packed])) for r in b.to_pylist()]
    for q, own in zip((10, 20, 30), asks, strict=True):
        tf = lambda i, t: texts[i].count(f"w{t}")  # noqa: E731, B023
        score = {i: sum(2.0 * idf[0, t] * tf(i, t) * 2.5 / (tf(i, t) + 1.5 * (0.25 + 0.75 * max(len(texts[i]), 1) / avg)) for t in own) for i in texts}
        want = sorted((i for i in texts if score[i] > 0), key=lambda i: (-round(score[i], 9), i))[:5]
        mine = sorted((r for r in got if r["asked"] == q), key=lambda r: (-round(r["raw"], 9), r["doc_id"]))[:5]
        assert [r["doc_id"] for r in mine] == want and all(abs(r["raw"] - score[r["doc_id"]]) < 1e-9 and r["channel"] == "x" for r in mine)


def test_questions_of_the_same_terms_share_their_hits(spark, monkeypatch):
    d = spark.createDataFrame([(x, "work_order", {"solution": f"pump {x}"}, {}) for x in "cab"], DOCS)
    q = spark.createDataFrame([(3, "pump a"), (1, "A pump"), (2, "c"), (4, "nothing")], "query_id long, query string")
    rows = lambda: sorted((r.query_id, r.rank, r.doc_id) for r in retrieval.bm25(retrieval.asked_index(d, retrieval.query_terms(q)), ["work_order"], 2).collect())
    want = [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "a"), (3, 2, "b")]
    assert rows() == want
    monkeypatch.setattr(retrieval, "TERMS_A_PASS", 1)
    assert rows() == want


def test_a_set_without_questions_has_no_hits(spark):
    d = spark.createDataFrame([("a", "work_order", {"solution": "pump"}, {})], DOCS)
    q = spark.createDataFrame([], "query_id long, query string")
    assert retrieval.bm25(retrieval.asked_index(d, retrieval.query_terms(q)), ["work_order"], 2).collect() == []
