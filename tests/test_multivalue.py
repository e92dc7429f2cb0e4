import random

from hypothesis import given
from hypothesis import strategies as st

from fieldloom.operators import multivalue as M


def test_delimiters_and_quotes():
    assert M.entries('KD75U.08.8A 软管, "M1234, 加厚"；H5678 "x') == ["KD75U.08.8A 软管", "M1234, 加厚", 'H5678 "x']
    assert M.entries("HAC-1 12.2/4 泵 1/2 / KMH-22 + TPE-33 | 4444") == ["HAC-1 12.2/4 泵 1/2", "KMH-22", "TPE-33", "4444"]
    assert M.entries('"A1234 泵 1/2""";B5678、') == ['A1234 泵 1/2"', "B5678"]
    assert M.entries("C1234(左,右)，D5678") == ["C1234(左,右)", "D5678"]


def test_intro_notes_and_repeats():
    assert M.entries("历史故障: E00123 泵漏油、E00123") == ["E00123 泵漏油", "E00123"]
    assert M.entries("仪表代码=E00123;U1234-5") == ["E00123", "U1234-5"]
    assert M.entries("故障码 E00123\nK654C") == ["E00123", "K654C"]
    assert M.entries("477813601 6件, 含密封、H3770C87") == ["477813601 6件, 含密封", "H3770C87"]


def test_introductions_of_any_length():
    two = ["A1234", "B2345"]
    for intro in ("更换件: ", "本次维修中更换的全部零部件清单: ", "The following parts were replaced during this visit: ", "本次维修中更换的全部零部件清单 ", "x" * 500 + ": "):
        assert M.entries(intro + "A1234、B2345") == two


def test_empty():
    assert M.entries(None) == M.entries("") == M.entries(" \n") == []
    assert M.entries(";;，") == []


@given(st.text(alphabet='ab1234;,"()/+| \n', max_size=60))
def test_pieces_are_disjoint_and_in_order(text):
    spans = M.tokenize(text)
    assert all(a < b for a, b, _ in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_round_trip_of_quoted_values():
    rnd = random.Random(1)
    for _ in range(500):
        values = ["X12345" + "".join(rnd.choice('a;,|"泵 ') for _ in range(rnd.randint(0, 8))).strip() for _ in range(rnd.randint(1, 6))]
        packed = rnd.choice([";", "，", "、", "\n"]).join('"' + v.replace('"', '""') + '"' for v in values)
        assert M.entries(packed) == values


def test_rows(spark):
    df = spark.createDataFrame([(1, "A1234;B5678"), (2, None), (3, "A1234"), (4, ""), (1, "A1234;B5678"), (5, "A1234;" * 50_000)], "id long, v string")
    got = [tuple(r) for r in M.split_values(df, "id", "v").collect()]
    assert got[:4] == [(1, 1, "A1234"), (1, 2, "B5678")] * 2
    assert len(got) == 50_004
    assert M.split_values(df.limit(0), "id", "v").count() == 0


def test_remarks_section(spark):
    raw = "工单ID: 1\n备注: 报码: E00123\nE00456\n\n备件信息:\n1"
    df = spark.createDataFrame([(raw,), ("备注：a\n工单ID: 2",), ("x",), (None,)], "raw string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(M.remarks(F.col("raw"))).collect()] == [" 报码: E00123\nE00456", "a", None, None]
