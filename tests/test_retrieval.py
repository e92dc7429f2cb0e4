import math

from pyspark.sql import functions as F

from fieldloom.config import RetrievalConfig, load, redact
from fieldloom.operators import embed, index, retrieval

def ix(d, q):
    return retrieval.asked_index(d, retrieval.query_terms(q))


DOCS = "doc_id string, doc_type string, fields map<string,string>, metadata map<string,string>"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, f, {}) for i, t, f in rows], DOCS)


def test_bm25_by_hand(spark):
    d = docs(spark, [("a", "work_order", {"solution": "pump pump leak", "remarks": ""}), ("b", "work_order", {"solution": "pump"}), ("c", "manual", {"solution": "x y z w"})])
    q = spark.createDataFrame([(1, "Pump pump")], "query_id long, query string")
    got = {r.doc_id: r.score for r in retrieval.bm25(ix(d, q), ["work_order"], 5).collect()}
    avg = (3 + 1 + 4) / 3  # lengths over every type
    idf = math.log(1 + 0.5 / 2.5)
    part = lambda tf, n: 2.0 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg))
    assert got == {"a": round(part(2, 3), 6), "b": round(part(1, 1), 6)}


def test_empty_fields_count_as_one(spark):
    d = docs(spark, [("a", "t", {"f": ""}), ("b", "t", {"f": "x y z"})])
    assert [(r.field, r.avg_len) for r in index.average_lengths(index.document_fields(d)).collect()] == [("f", 2.0)]


def test_ties_are_ordered_by_id(spark):
    d = docs(spark, [(x, "work_order", {"solution": "pump"}) for x in "dbca"])
    q = spark.createDataFrame([(1, "pump")], "query_id long, query string")
    assert [r.doc_id for r in retrieval.bm25(ix(d, q), ["work_order"], 3).orderBy("rank").collect()] == ["a", "b", "c"]


def test_relative_cut(spark):
    h = lambda *s: spark.createDataFrame([(1, f"d{i}", x) for i, x in enumerate(s)], "query_id long, doc_id string, score double")
    cut = lambda df, r, m: [x.doc_id for x in retrieval.relative_cut(df, r, m).orderBy("rank").collect()]
    assert cut(h(10.0, 4.5, 4.4), 0.45, 10) == ["d0", "d1"]
    assert cut(h(8.0, 3.5), 0.55, 5) == ["d0"]
    assert cut(h(0.0), 0.4, 5) == cut(h(1.0), 0.4, 0) == []


def test_fusion_divides_by_the_best(spark):
    b = spark.createDataFrame([(1, "a", 4.0), (1, "b", 2.0)], "query_id long, doc_id string, score double")
    v = spark.createDataFrame([(1, "b", 0.5, 0.1), (1, "c", 0.25, 0.2)], "query_id long, doc_id string, score double, distance double")
    got = [(r.doc_id, r.score) for r in retrieval.fuse(b, v, 5, 0.75).orderBy("rank").collect()]
    assert got == [("a", 0.75), ("b", 0.625), ("c", 0.125)]


def test_vector_order(spark):
    e = spark.createDataFrame([("same", [1.0, 0.0, 0.0]), ("close", [0.9, 0.1, 0.0]), ("far", [0.0, 1.0, 0.0]), ("bad", [float("nan")] * 3), ("null", None)], "doc_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, vector array<double>")
    assert [r.doc_id for r in retrieval.vector_search(q, e, 9).orderBy("rank").collect()] == ["same", "close", "far"]


def test_vector_blocks_give_the_same(spark, monkeypatch):
    e = spark.range(60).selectExpr("cast(id as string) doc_id", "array(cast(id as double), 7d, cast(id % 5 as double)) embedding")
    q = spark.range(9).selectExpr("id query_id", "array(1d, cast(id as double), 2d) vector")
    rows = lambda: sorted(map(tuple, retrieval.vector_search(q, e, 3).collect()))
    one = rows()
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 2)
    assert rows() == one and len(one) == 27


def test_fault_codes_exact_then_bm25(spark):
    d = docs(spark, [("m1", "manual_fault_code", {"fault_code": "E00131", "chunk_text": "pump"}), ("m2", "manual_fault_code", {"fault_code": "E00999", "chunk_text": "about E00555"})])
    q = spark.createDataFrame([(1, "error e00131"), (2, "error E00555"), (3, "pump")], "query_id long, query string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.search_fault_codes(d, ix(d, q), q, RetrievalConfig()).collect()}
    assert got[(1, "m1")] == 100.0 and (2, "m2") in got and not any(k[0] == 3 for k in got)


def test_retrieve_keeps_order_of_parts(spark):
    d = spark.createDataFrame([("wo:1", "work_order", {"reported_issue": "pump leak leak"}, {"work_order_id": "W1"}), ("wo:2", "work_order", {"reported_issue": "leak pump oil oil oil"}, {"work_order_id": "W2"})], DOCS)
    p = spark.createDataFrame([(1, "W2"), (2, "W1"), (3, "W1"), (4, "W3")], "part_id long, work_order_id string")
    q = spark.createDataFrame([(1, "leak pump"), (2, " "), (3, None)], "query_id long, query string")
    got = retrieval.retrieve(d, p, q)["part_evidence"].orderBy("query_id", "order_rank", "part_id").collect()
    assert [(r.query_id, r.part_id) for r in got] == [(1, 2), (1, 3), (1, 1)]


def test_index_upkeep(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "source_path string, v int")
    new = spark.createDataFrame([("b", 9)], "source_path string, v int")
    touched = spark.createDataFrame([("b",), ("c",)], "source_path string")
    assert sorted(map(tuple, index.upsert_by_source(old, new, touched=touched).collect())) == [("a", 1), ("b", 9)]
    d = spark.createDataFrame([("x", 1, None), ("x", 2, {"k": "v"}), ("y", 3, {})], "doc_id string, o int, metadata map<string,string>")
    got = {r.o: (r.doc_id, r.metadata) for r in index.unique_doc_ids(d, "o").collect()}
    assert got[2] == ("x:dup2", {"k": "v", "duplicate_of": "x", "duplicate_index": "2"}) and got[1][0] == "x"
    hot = spark.range(3000).selectExpr("'z' doc_id", "id o", "cast(map() as map<string,string>) metadata")
    ids = [r.doc_id for r in index.unique_doc_ids(hot, "o").orderBy("o").collect()]
    assert ids == ["z"] + [f"z:dup{i}" for i in range(2, 3001)]
    n = index.number_documents(spark.createDataFrame([(c,) for c in "qwertyuiop"], "doc_id string"))
    assert [r.document_id for r in n.orderBy("doc_id").collect()] == list(range(1, 11))


def test_embeddings_fall_back_to_singles(spark):
    def flaky(texts):
        if len(texts) > 1 or texts[0] == "bad":
            raise RuntimeError("no")
        return [[1.0, 2.0]]

    d = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", None)], "doc_id string, text string")
    got = {r.doc_id: (r.embedding, r.error) for r in embed.embed(d, flaky, "p", "m").collect()}
    assert got["a"] == ([1.0, 2.0], None) and got["b"][0] is None and "no" in got["b"][1] and got["c"][0]


def test_config():
    assert RetrievalConfig(mode="hybrid").resolve("auto") == "bm25"
    assert RetrievalConfig(embeddings=True).mode_for("work_orders") == "hybrid"
    assert RetrievalConfig(work_order_min_relative_score=1.8).cut("work_orders") == (1.0, 10)
    assert RetrievalConfig(manual_min_relative_score=-0.3).cut("manual_typical_faults") == (0.0, 5)
    assert load({"bm25_top_k": 7}, {"FIELDLOOM_BM25_TOP_K": "5", "FIELDLOOM_EMBEDDINGS": "yes"}).bm25_top_k == 7
    assert redact({"api_key": "x", "a": [{"token": ""}], "api_key_env": "E"}) == {"api_key": "***", "a": [{"token": ""}], "api_key_env": "E"}


def test_inverted_index_blocks(spark):
    d = docs(spark, [(f"d{i:03}", "t", {"f": "x x y"}) for i in range(40)])
    rows = index.inverted_index(index.postings(index.document_fields(d)), block=10).where(F.col("term") == "x").collect()
    assert len(rows) > 1 and {r.df for r in rows} == {40}
    assert sorted(p.doc_id for r in rows for p in r.postings) == [f"d{i:03}" for i in range(40)] and all(p.tf == 2 for r in rows for p in r.postings)


def test_hybrid_search_end_to_end(spark):
    d = docs(spark, [("a", "work_order", {"solution": "pump leak"}), ("b", "work_order", {"solution": "fan"}), ("m", "manual_typical_fault", {"solution": "pump"})])
    q = spark.createDataFrame([(1, "pump")], "query_id long, query string")
    e = embed.embed(spark.createDataFrame([("a", "x"), ("b", "pump"), ("m", "pump")], "doc_id string, text string"), embed.hash_provider(), "hash", "hash-64")
    v = spark.createDataFrame([(1, embed.hash_provider()(["pump"])[0])], "query_id long, vector array<double>")
    cfg = RetrievalConfig(embeddings=True, hybrid_alpha=0.5, work_order_min_relative_score=0.0)
    got = retrieval.search(d, ix(d, q), cfg, embeddings=e, vectors=v)
    rows = {r.doc_id: r.score for r in got["work_orders"].collect()}
    assert set(rows) == {"a", "b"} and rows["b"] == 0.5 and {r.mode for r in got["work_orders"].collect()} == {"hybrid"}
    events = []
    plain = retrieval.search(d, ix(d, q), cfg, events=events)["work_orders"].collect()
    assert [(r.doc_id, r.mode) for r in plain] == [("a", "bm25")] and {e["status"] for e in events} == {"fallback"}

    def broken():
        raise RuntimeError("provider is away")

    events = []
    down = retrieval.search(d, ix(d, q), cfg, ("work_orders",), embeddings=e, vectors=broken, events=events)["work_orders"].collect()
    assert [(r.doc_id, r.mode) for r in down] == [("a", "bm25")] and events == [{"channel": "work_orders", "stage": "query_embedding", "status": "fallback", "reason": "RuntimeError: provider is away"}]
    live = retrieval.search(d, ix(d, q), cfg, ("work_orders",), embeddings=e, vectors=lambda: v)["work_orders"].collect()
    assert {r.doc_id: r.score for r in live} == rows


def test_package_and_evidence_have_parts(spark):
    d = spark.createDataFrame([("wo:1", "work_order", {"reported_issue": "pump leak"}, {"work_order_id": "W1"}), ("m", "manual_fault_code", {"fault_code": "E00131"}, {})], DOCS)
    p = spark.createDataFrame([(2, "W1", "seal", "C2", "2", "leak"), (1, "W1", None, "C1", None, None), (3, "W9", "x", "y", "1", "")], "part_id long, work_order_id string, part_name string, part_code string, quantity string, reported_issue string")
    q = spark.createDataFrame([(1, "pump E00131"), (2, "")], "query_id long, query string")
    events = [{"channel": "work_orders", "stage": "vector_search", "status": "fallback", "reason": "no vectors"}]
    found = retrieval.retrieve(d, p, q)
    rows = {r.query_id: r for r in retrieval.package(found, q, RetrievalConfig(), 8, events, debug=True).collect()}
    assert [x.doc_id for x in rows[1].part_evidence] == ["part:W1:1", "part:W1:2"] and [x.title for x in rows[1].part_evidence] == ["C1", "seal"]
    assert rows[1].linked_work_order_ids == ["W1"] and rows[1].warnings == ["work_orders:vector_search:no vectors"] and rows[1].debug.query_terms == ["pump", "e00131"]
    assert rows[1].part_candidate_source.work_order_hit_count == 1 and rows[2].part_evidence == [] and rows[1].channel_modes["work_orders"] == "bm25"
    flat = retrieval.flatten({"part_evidence": retrieval.part_hits(found["part_evidence"])} | {c: found[c] for c in retrieval.CHANNELS}, 3).orderBy("rank").collect()
    assert [(r.channel, r.doc_id) for r in flat] == [("work_orders", "wo:1"), ("part_evidence", "part:W1:1"), ("part_evidence", "part:W1:2")]
    assert "新件数量: 2" in flat[2].body_preview and flat[2].metadata["part_code"] == "C2" and flat[0].title is None


def test_stored_statistics_score_the_same(spark):
    d = docs(spark, [("a", "work_order", {"solution": "pump pump leak", "remarks": ""}), ("b", "work_order", {"solution": "pump"}), ("c", "manual", {"solution": "x y z w"})])
    q = spark.createDataFrame([(1, "Pump leak")], "query_id long, query string")
    f = index.document_fields(d)
    stored = retrieval.stored_index(index.postings(f), index.statistics(d, f), retrieval.query_terms(q))
    rows = lambda i: sorted(map(tuple, retrieval.bm25(i, ["work_order"], 5).collect()))
    assert rows(stored) == rows(ix(d, q)) != []
