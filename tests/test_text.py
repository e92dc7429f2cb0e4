from pyspark.sql import functions as F

from fieldloom.functions import text as T
from fieldloom.functions import vector as V


def one(spark, expr, **cols):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())) if cols else spark.range(1)
    return df.select(expr).head()[0]


def toks(spark, s):
    return spark.createDataFrame([(s,)], "x string").select(T.tokens(F.col("x"))).head()[0]


def test_tokens(spark):
    assert toks(spark, "单") == ["单"]
    assert toks(spark, "行走") == ["行走", "行走"]
    assert toks(spark, "行走单") == ["行走单", "行走", "走单", "行走单"]
    assert "零" * 13 not in toks(spark, "零" * 13)
    got = toks(spark, "行走单边 E00131 GPS_. 310705565")
    assert {"行走", "单边", "行走单", "e00131", "gps", "310705565"} <= set(got)
    assert got[:3] == ["e00131", "gps", "310705565"]
    assert toks(spark, None) == toks(spark, "") == []


def test_unique_terms(spark):
    df = spark.createDataFrame([(["行走", " ", "马达", "行走", "MOTOR "],), ([f"t{i}" for i in range(300)],)], "x array<string>")
    a, b = (r[0] for r in df.select(T.unique_terms(F.col("x"))).collect())
    assert a == ["行走", "马达", "motor"] and len(b) == 200


def test_preview_and_ids(spark):
    df = spark.createDataFrame([("a \n　b",), ("x" * 500,), (None,)], "x string")
    a, b, c = (r[0] for r in df.select(T.preview(F.col("x"))).collect())
    assert (a, len(b), b[-3:], c) == ("a b", 420, "...", "")
    ids = spark.createDataFrame([("dir/WO-1.txt?x#y",), ("wo:AB ",), (r"c:\d\E.2.txt",), (None,)], "x string")
    assert [r[0] for r in ids.select(T.normalize_work_order_id(F.col("x"))).collect()] == ["WO-1", "AB", "E.2", ""]


def test_fault_codes(spark):
    df = spark.createDataFrame([("报E00131故障 x e002 E003a,E003A",), (None,)], "x string")
    assert [r[0] for r in df.select(T.fault_codes(F.col("x"))).collect()] == [["E002", "E003A"], []]
    stems = spark.createDataFrame([("e00131-1 泵 漏油",), ("故障现象：泵",), ("泵",)], "x string")
    got = [tuple(r) for r in stems.select(T.fault_code_of_stem(F.col("x")), T.fault_description_of_stem(F.col("x")), T.fault_title_of_stem(F.col("x"))).collect()]
    assert got == [("E00131-1", "泵 漏油", "泵 漏油"), (None, None, "泵"), (None, None, "泵")]


def test_cells_strip_and_json(spark):
    df = spark.createDataFrame([(" a，b ,, c ",), (None,)], "x string")
    assert [r[0] for r in df.select(T.split_cell(F.col("x"))).collect()] == [["a", "b", "c"], []]
    j = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('so: {"a": 1} end',), ("[1]",)], "x string")
    assert [r[0] for r in j.select(T.strip_json_fence(F.col("x"))).collect()] == ['{"a": 1}', '{"a": 1}', None]
    assert one(spark, T.redact_database_url(F.lit("postgresql://u:p@h/db"))) == "postgresql://u:***@h/db"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine_distance(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, None, None, None]
    v = spark.createDataFrame([([1.0],), ([],), ([float("nan")],), ([float("inf")],), ([None],), (None,)], "v array<double>")
    assert [r[0] for r in v.select(V.is_valid(F.col("v"))).collect()] == [True] + [False] * 5
