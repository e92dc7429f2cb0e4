from pyspark.sql import functions as F

from fieldloom.plans import catalog


def test_export_of_orders_with_ids_beyond_32_bits(spark, tmp_path):
    part = "struct<part_number_name:string,part_number:string,part_name:string,part_code:string,quantity:string,raw_text:string>"
    o = spark.createDataFrame([(3_000_000_001, "W1", "leak", None), (7, "W2", "noise", [(None, None, "seal", "C1", "2", None)])], f"record_id long, work_order_id string, reported_issue string, parts array<{part}>")
    o.write.parquet(f"{tmp_path}/work_orders.parquet")
    rows = catalog.QUERIES["verdict_export"](spark, str(tmp_path)).orderBy(F.length("row_number")).collect()
    assert [r.row_number for r in rows] == ["7", "3000000001"]
