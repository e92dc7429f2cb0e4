"""Searches shuffle what they found, not the postings they read."""

import pytest

from fieldloom.plans import catalog

TERMS, DOCS = 150, 200
ISSUE = " ".join(f"t{i}" for i in range(TERMS))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    o = "record_id long, work_order_id string, reported_issue string"
    spark.createDataFrame([(i, f"W{i}", f"{ISSUE} q{i}" if i % 50 == 0 else "") for i in range(1, 201)], o).write.parquet(f"{d}/work_orders.parquet")
    x = "doc_id string, doc_type string, title string, text string, fields map<string,string>, metadata map<string,string>, source_path string"
    kinds = ("work_order", "work_order", "manual_typical_fault", "manual_fault_code")
    spark.createDataFrame([(f"d{i:03}", kinds[i % 4], f"n{i}", ISSUE, {"solution": f"{ISSUE} n{i}"}, {"work_order_id": f"W{i}"}, f"p{i}") for i in range(DOCS)], x).repartition(4).write.parquet(f"{d}/index_documents.parquet")
    p = "part_id long, record_id long, work_order_id string, part_ord int, reported_issue string, part_number_name string, part_number string, part_name string, part_code string, quantity string, source_path string"
    spark.createDataFrame([(i, i, f"W{i}", 1, None, None, None, f"part {i}", f"C{i}", "1", f"p{i}") for i in range(1, 201)], p).write.parquet(f"{d}/part_evidence.parquet")
    return d


def shuffled(spark, run):
    """Rows that the stages of a run write for others to read, and its result."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        every = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(every.apply, range(every.size()))}

    before = stages()
    rows = run().collect()
    return sum(n for k, n in stages().items() if k not in before), rows


@pytest.mark.parametrize("name", ["bm25_topk", "batch_metrics", "bm25_matched_terms", "evidence_package", "rank_ordered_parts", "threshold_events", "batch_order_recall", "hits_as_returned", "matched_terms_json", "relative_threshold", "typical_fault_search", "batch_recall", "evidence_flatten", "part_channel", "search_summaries"])
def test_postings_stay_in_their_task(spark, tables, name):
    n, rows = shuffled(spark, lambda: catalog.QUERIES[name](spark, tables))
    assert rows and n < TERMS * DOCS / 3, n
