import pytest

from fieldloom.operators import quarantine as Q

GOOD = 'a.txt,parsed,,ID,3,missing_solution|missing_work_order_id,gbk,2024-02-29 23:59:59'
CASES = {
    GOOD: None,
    '"a, ""b"".txt",failed,"x\ny",,0,,,2024-01-01 00:00:00': None,
    ",parsed,,,0,,,2024-01-01 00:00:00": None,
    "": "column_count",
    "a,b": "column_count",
    GOOD + ",": "column_count",
    'a,parsed,"open,,0,,,2024-01-01 00:00:00': "quoting",
    'a,parsed,bad "x" y,,0,,,2024-01-01 00:00:00': "quoting",
    'a,parsed,"x"y,,0,,,2024-01-01 00:00:00': "quoting",
    'a,b "c"': "quoting",
    "a,Parsed,,,0,,,2024-01-01 00:00:00": "invalid_value",
    "a,parsed,,,,,,2024-01-01 00:00:00": "invalid_value",
    "a,parsed,,,０,,,2024-01-01 00:00:00": "invalid_value",
    "a,parsed,,,1,missing_solution|,,2024-01-01 00:00:00": "invalid_value",
    "a,parsed,,,1,,,2023-02-29 00:00:00": "invalid_value",
    "a,parsed,,,1,,,2024-01-01 24:00:00": "invalid_value",
    "a,parsed,,,1,,,2024-1-1 0:00:00": "invalid_value",
    "input_path,status,error,work_order_id,part_count,parse_warnings,encoding,finished_at": "invalid_value",
    None: "column_count",
}


def test_reasons(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "raw_id long, line string")
    got = {r.raw_id: r.reason for r in Q.bad_rows(Q.parse_lines(df), "raw_id").collect()}
    assert got == {i: r for i, (_, r) in enumerate(CASES.items()) if r}


def test_valid_rows_are_typed(spark):
    df = spark.createDataFrame([(1, GOOD)], "raw_id long, line string")
    r = Q.good_rows(Q.parse_lines(df)).collect()[0]
    assert (r.part_count, r.parse_warnings, r.error, str(r.finished_at)) == (3, ["missing_solution", "missing_work_order_id"], None, "2024-02-29 23:59:59")


@pytest.mark.parametrize("n", [100_000])
def test_very_long_fields_and_many_columns(spark, n):
    long_ = GOOD.replace("a.txt", '"' + 'x""' * n + '"')
    rows = [(1, long_), (2, "," * n), (3, '"' + "y" * n), (3, '"' + "y" * n)]
    df = spark.createDataFrame(rows, "raw_id long, line string")
    assert sorted((r.raw_id, r.reason) for r in Q.bad_rows(Q.parse_lines(df), "raw_id").collect()) == [(2, "column_count"), (3, "quoting"), (3, "quoting")]


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, GOOD, "s", "e")], "raw_id long, line string, status string, errors string")
    r = Q.parse_lines(df).collect()[0]
    assert (r.status, r.status_in, r.errors, r.errors_in) == ("parsed", "s", [], "e")
    assert Q.parse_lines(df.limit(0)).count() == 0


def test_huge_counts_and_missing_paths(spark):
    from pyspark.sql import functions as F

    from fieldloom.operators import manuals

    df = spark.createDataFrame([(1, GOOD.replace(",3,", "," + "9" * 30 + ",")), (2, GOOD.replace(",3,", "," + "9" * 60 + ","))], "raw_id long, line string")
    rows = Q.good_rows(Q.parse_lines(df)).orderBy("raw_id").select(F.col("part_count").cast("string"), F.col("part_count").try_cast("bigint")).collect()
    assert [tuple(r) for r in rows] == [("9" * 30, None), (None, None)]
    paths = spark.createDataFrame([("",), (None,), ("/",)], "p string").select(*manuals.path_metadata(F.col("p"))).collect()
    assert [(r.file_name, r.doc_type) for r in paths] == [(None, "manual_typical_fault")] * 3


def test_counts_of_any_length(spark):
    digits = "9" * 60
    df = spark.createDataFrame([(1, f"p,parsed,,,{digits},,utf-8,2024-01-01 00:00:00")], "raw_id long, line string")
    r = Q.parse_lines(df).collect()[0]
    assert (r.errors, r.part_count, r.part_count_text) == ([], None, digits)
