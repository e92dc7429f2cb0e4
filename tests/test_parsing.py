import pytest
from pyspark.sql import functions as F

from fieldloom.operators import html, manuals, workorder
from fieldloom.sources import files, xlsx

ORDER = """工单ID：WO-1
用户报修内容: 皮带断
人员落实及解决方法: 换皮带, 单号 9876
备件信息:
1. 旧件备件名称: 旧皮带
新件备件名称: 皮带
新件数量: 1.0
旧件物料编码: 310000000
新件物料编码: 310900001
2) 旧件备件名称: 轮
旧件物料编码: 42
备注: 另见 WO-2"""


def test_order_with_old_and_new_parts():
    o = workorder.parse_order(ORDER)
    assert (o["work_order_id"], o["remarks"], o["parse_warnings"]) == ("WO-1", "另见 WO-2", [])
    assert [(p["part_name"], p["part_code"], p["quantity"]) for p in o["parts"]] == [("皮带", "310900001", "1.0"), ("轮", "42", None)]


def test_part_forms():
    names = lambda t, k="part_name": [p.get(k) for p in workorder.parse_parts(t)]
    assert names("备件名称: 泵; 备件编码: A1; 数量: 2; 备件名称: 阀; 备件编码: B2") == ["泵", "阀"]
    assert names("备件名称 | 备件编码 | 数量\n左 泵 | A1 | 2\n无\n阀 | B2 | 1") == ["左 泵", "阀"]
    assert workorder.parse_parts("换了一个泵") == [{"raw_text": "换了一个泵"}]
    assert workorder.parse_parts("无") == workorder.parse_parts("") == []
    assert workorder.parse_parts("1. 旧件备件名称:\n新件备件名称:\n新件数量:") == []


def test_order_warnings_and_labels():
    o = workorder.parse_order("工单id: X\n备注: a\n备注: b\n备注:")
    assert (o["work_order_id"], o["remarks"]) == ("X", "b")
    assert o["parse_warnings"] == ["missing_reported_issue", "missing_solution"]


def test_single_section_and_values():
    assert workorder.section("备注:\n备注: b", "remarks") == "" and workorder.section("x", "remarks") is None
    assert workorder.labelled_values("新件数量: \n 2;名称: 泵 数量") == {("new", "quantity"): "2", ("", "part_name"): "泵"}
    assert workorder.labelled_values("大名称: x 编码: y,备件名称: z") == {("", "part_code"): "y", ("", "part_name"): "z"}
    text = "工单ID：A; 备注, x\n"
    assert "".join(e.value if e.kind != "label" else text[e.start : e.end] for e in workorder.events(text, workorder.SECTIONS)) == text


def test_orders_in_bulk(spark):
    df = spark.createDataFrame([(1, ORDER, "s"), (2, None, None), (3, "", ""), (1, ORDER, "s"), (4, "备注: " + "x" * 200_000, "")], "id long, t string, status string")
    rows = workorder.parse_orders(df, "t", "id").collect()
    assert [r.status for r in rows] == ["parsed", "failed", "parsed", "parsed", "parsed"]
    assert rows[1].error == "ValueError: no text" and rows[2].parse_warnings == ["missing_reported_issue", "missing_solution", "missing_work_order_id"]
    assert len(rows[4].remarks) == 200_000
    rep = workorder.batch_report(workorder.parse_orders(df.limit(0), "t", "id")).collect()[0]
    assert (rep.files, rep.parts) == (0, 0)


def test_html_inline_and_lists():
    md = html.to_markdown('<html><body><nav>n</nav><main><h2>A_b</h2><p>x <b>y</b> <a href="u" title="t">l</a><br>z <code>a`b</code></p><ul><li>a<ol><li>b</li></ol></li></ul></main></body>')
    assert md == '## A\\_b\n\nx **y** [l](u "t")\nz ``a`b``\n\n- a\n\n  1. b\n'
    assert html.to_markdown("<script>x</script><p>a</b></p>") == "a\n"
    assert html.to_markdown("") == "\n" and html.to_markdown(None) is None
    assert html.to_markdown('<a href="u">a</a><a href="u">b</a>', True) == "[a][1][b][1]\n\n[1]: u\n"


def test_html_tables():
    md = html.to_markdown('<table><caption>C</caption><tr><th align="right">h</th><th colspan="2">k</th></tr><tr><td rowspan="2">1</td><td>2|</td><td>3</td></tr><tr><td>4</td></tr></table>')
    assert md == "*C*\n\n| h | k |  |\n| ---: | --- | --- |\n| 1 | 2\\| | 3 |\n| 1 | 4 |  |\n"
    assert html.to_markdown("<table><tr><td></td></tr><tr><td>x</td></tr></table>").startswith("| Column 1 |")


def test_html_of_any_depth_and_span():
    assert html.to_markdown("<div>" * 2000 + "<ul><li>a</li><li>b</li></ul>") == "- a\n- b\n"
    assert html.to_markdown("<b>" * 2000 + "x").startswith("**" * 2000 + "x")
    head = html.to_markdown('<table><tr><td colspan="5000">x</td><td>y</td></tr></table>').split("\n")[0]
    assert head.count("|") == 5002 and head.endswith("| y |")
    tall = html.to_markdown('<table><tr><td rowspan="5000">x</td><td>1</td></tr>' + "<tr><td>2</td></tr>" * 1500 + "</table>")
    assert tall.count("| x | 2 |") == 1500
    assert html.to_markdown('<table><tr><td colspan="many">x</td><td rowspan="-3">y</td></tr></table>') == "| x | y |\n| --- | --- |\n"


def test_html_unbalanced_and_nested():
    assert html.to_markdown("<p>a<svg><b>b</svg>c</i></p></p>d") == "ac\n\nd\n"
    assert html.to_markdown("<table><tr><td><form>f</form></td><td><ul><li>a</li></ul></td></tr></table>") == "| f | - a |\n| --- | --- |\n"
    assert html.to_markdown("<div>x</div><section id='Content'>y<article>z</article></section>") == "z\n"
    assert html.to_markdown("<pre>a<code>b\n c</code></pre><blockquote>q<p>r</p></blockquote>") == "```\nb\n c\n```\n\n> q\n>\n> r\n"


def chunk(spark, t, n):
    return spark.createDataFrame([(t,)], "t string").select(manuals.chunks(F.col("t"), n)).head()[0]


def test_chunks(spark):
    a, b = "a" * 150, "b" * 120
    assert chunk(spark, "x" * 200, 200) == ["x" * 200]
    assert chunk(spark, "x" * 201, 200) == ["x" * 200, "x"]
    assert chunk(spark, f"{a}\n\n{b}", 200) == [a, b]
    assert chunk(spark, f"{a}\n\n{b}\n\nc", 300) == [f"{a}\n\n{b}\n\nc"]
    assert chunk(spark, f"{a}\n# h\n{b}", 200) == [a, f"# h\n{b}"]
    assert chunk(spark, f"{a}\n\n{'y' * 450}\n\n{b}", 200) == [a, "y" * 200, "y" * 200, "y" * 50, b]
    assert chunk(spark, None, 200) == chunk(spark, " \n", 200) == []


def test_path_metadata(spark):
    df = spark.createDataFrame([("QF/典型故障解析/液压/故障现象：泵.md",), ("QF/机器故障代码解析/E00131 泵漏油.md",), ("x.md",)], "p string")
    got = [tuple(r) for r in df.select(*manuals.path_metadata(F.col("p"))).collect()]
    assert got[0] == ("QF", "典型故障解析", "液压", "故障现象：泵.md", "泵", None, None, "manual_typical_fault")
    assert got[1] == ("QF", "机器故障代码解析", None, "E00131 泵漏油.md", "泵漏油", "E00131", "泵漏油", "manual_fault_code")
    assert got[2] == (None, None, None, "x.md", "x", None, None, "manual_typical_fault")


def test_encodings():
    assert files.decode("abc工单".encode("utf-16-le"))[1] in ("utf-16-le", "utf-8") and files.decode(("工单 order text" * 9).encode("utf-16-le"))[1] == "utf-16-le"
    assert files.decode(b'<meta charset="gb2312">' + "泵".encode("gb18030")) == ('<meta charset="gb2312">泵', "gb18030")
    text, name = files.decode(b"\xae")
    assert name == "gb18030-replace" and "�" in text
    assert files.decode(b"") == ("", "utf-8") and files.decode(None) == (None, None)


def test_scan_and_tables(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.TXT").write_text("b")
    (tmp_path / "a.txt").write_bytes("工单".encode("gb18030"))
    (tmp_path / "c.md").write_text("c")
    got = files.with_text(files.scan(spark, "work_order", str(tmp_path))).orderBy("path").collect()
    assert [(r.text, r.lossy) for r in got] == [("工单", False), ("b", False)] and len(got[0].content_hash) == 64
    assert files.scan(spark, "work_order", str(tmp_path), limit=1).count() == 1
    (tmp_path / "t.csv").write_bytes(b"\xef\xbb\xbfq,\n,,\n\"a\nb\",1,2\nc\n")
    rows = files.read_csv_table(spark, str(tmp_path / "t.csv")).collect()
    assert [tuple(r) for r in rows] == [(2, "a\nb", "1"), (3, "c", "")] and rows[0].__fields__ == ["row_number", "q", "列2"]
    same = files.scan(spark, "work_order", None, [str(tmp_path / "a.txt"), str(tmp_path / "d" / ".." / "a.txt"), str(tmp_path / "d" / "b.TXT")])
    assert same.count() == 2
    for root, paths, error in ((str(tmp_path / "no"), None, FileNotFoundError), (str(tmp_path / "a.txt"), None, NotADirectoryError), (None, [str(tmp_path / "d")], IsADirectoryError), (None, [str(tmp_path / "c.md")], ValueError), (None, None, ValueError)):
        with pytest.raises(error):
            files.scan(spark, "work_order", root, paths)
    many = tmp_path / "many"
    many.mkdir()
    (many / "x.jsonl").write_text("".join('{"a": %d}\n' % i + "\n" * (i % 2) for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    rows, bad = files.read_json_lines(spark, str(many), "a int")
    assert bad.count() == 0 and sorted((r.line_number, r.a) for r in rows.collect()) == [(1 + i + i // 2, i) for i in range(3000)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n[1]\n{"a":\n{"a": 2}\n')
    ok, bad = files.read_json_lines(spark, str(tmp_path / "r.jsonl"), "a int")
    assert sorted((r.line_number, r.a) for r in ok.collect()) == [(1, 1), (5, 2)]
    assert sorted((r.line_number, r.error) for r in bad.collect()) == [(3, "not_an_object"), (4, "invalid_json")]


def workbook(path, cells):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId9" Target="worksheets/s9.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>问题</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/s9.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    p = str(tmp_path / "t.xlsx")
    workbook(p, '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>数量</t></is></c></row><row/><row><c r="A3" t="s"><v>1</v></c><c r="B3" t="b"><v>1</v></c><c r="C3"><v>2</v></c><c r="D3"><v>9</v></c></row>')
    df = xlsx.read_xlsx_table(spark, p)
    assert df.columns == ["row_number", "问题", "列2", "数量"] and tuple(df.head()) == (2, "ab", "TRUE", "2")
    spark.dataSource.register(xlsx.XlsxSource)
    assert [r.cells for r in spark.read.format("xlsx_table").option("path", p).load().collect()][1] == ["ab", "TRUE", "2"]
    try:
        xlsx.sheet_rows(b"\xd0\xcf")
    except ValueError:
        return
    raise AssertionError


def test_kinds_of_files(spark, tmp_path):
    for name in ("a.HTML", "b.htm", "c.Md", "d.markdown", "e.txt", "f.html.bak", "g"):
        (tmp_path / name).write_text(name)
    found = lambda kind: sorted(r.path.rpartition("/")[2] for r in files.scan(spark, kind, str(tmp_path)).select("path").collect())
    assert found("html") == ["a.HTML", "b.htm"] and found("markdown") == ["c.Md", "d.markdown"] and found("work_order") == ["e.txt"] and found("manual") == ["a.HTML", "b.htm", "c.Md", "d.markdown"]
    assert [r.rel for r in files.scan(spark, "work_order", str(tmp_path)).select(files.relative_path(F.col("path"), str(tmp_path)).alias("rel")).collect()] == ["e.txt"]


def test_sinks_come_back(spark, tmp_path):
    import csv
    import json

    rows = [("a", None, 'q"x,\n'), ("b", "泵", "")]
    df = spark.createDataFrame(rows, "k string, v string, t string").coalesce(1)
    files.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(json.loads(line)["k"] for f in (tmp_path / "j").glob("*.json") for line in f.read_text().splitlines()) == ["a", "b"]
    assert '"v":null' in next((tmp_path / "j").glob("*.json")).read_text()
    files.write_csv(df, str(tmp_path / "c"))
    raw = next((tmp_path / "c").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    got = list(csv.reader(raw.decode("utf-8-sig").splitlines(keepends=True)))
    assert got == [["k", "v", "t"], ["a", "", 'q"x,\n'], ["b", "泵", ""]]
    files.write_json(spark, str(tmp_path / "deep" / "r.json"), {"b": [1], "泵": None})
    assert json.loads((tmp_path / "deep" / "r.json").read_text()) == {"b": [1], "泵": None}
    from fieldloom.operators import index

    docs = spark.createDataFrame([("d1", "t", {"f": "x y"}), ("d2", "t", {"f": "x"})], "doc_id string, doc_type string, fields map<string,string>")
    files.write_inverted_index(index.inverted_index(index.postings(index.document_fields(docs))), str(tmp_path / "ix"))
    lines = [json.loads(line) for f in sorted((tmp_path / "ix").glob("*.json")) for line in f.read_text().splitlines()]
    assert {x["term"]: [p["doc_id"] for p in x["postings"]] for x in lines} == {"x": ["d1", "d2"], "y": ["d1"]}
