"""The first sheet of a workbook, read with the standard library; also as a registered data source."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from fieldloom.sources.files import normal_table, table_frame


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _texts(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _name(x) == "t")


def sheet_rows(raw: bytes) -> list[list[str]]:
    """Cells of the first sheet as text: shared and inline strings, booleans as TRUE or FALSE, gaps as empty cells."""
    if not raw.startswith(b"PK"):
        raise ValueError("not an .xlsx workbook; the older .xls isn't supported")
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        xml = lambda p: ElementTree.fromstring(z.read(p))
        names = set(z.namelist())
        first = next((s for s in xml("xl/workbook.xml").iter() if _name(s) == "sheet"), None)
        rel = next((v for k, v in first.attrib.items() if k.endswith("}id")), None) if first is not None else None
        target = "worksheets/sheet1.xml"
        if rel and "xl/_rels/workbook.xml.rels" in names:
            target = next((r.get("Target", target) for r in xml("xl/_rels/workbook.xml.rels").iter() if r.get("Id") == rel), target)
        path = target.lstrip("/") if target.startswith("/") else "xl/" + target
        shared = [_texts(s) for s in xml("xl/sharedStrings.xml") if _name(s) == "si"] if "xl/sharedStrings.xml" in names else []
        out = []
        for row in (r for r in xml(path).iter() if _name(r) == "row"):
            cells: list[str] = []
            for c in (c for c in row if _name(c) == "c"):
                letters = re.match("[A-Z]+", c.get("r", "").upper())
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                value = next((v.text or "" for v in c if _name(v) == "v"), "")
                kind = c.get("t", "")
                text = shared[int(value)] if kind == "s" and value else _texts(c) if kind == "inlineStr" else ("TRUE" if value == "1" else "FALSE") if kind == "b" else value
                cells += [""] * (at - len(cells))
                cells.append(text)
            out.append(cells)
        return out


def read_xlsx_table(spark: SparkSession, path: str) -> DataFrame:
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
    return table_frame(spark, *normal_table(sheet_rows(raw)))


class XlsxSource(DataSource):
    """spark.read.format("xlsx_table").load(path): (row_number, cells)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_table"

    def schema(self) -> str:
        return "row_number int, cells array<string>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def read(self, partition) -> Iterator[tuple]:  # noqa: ANN001
        from pyarrow import fs

        bare = self.path.removeprefix("file://").removeprefix("file:")
        system, name = fs.FileSystem.from_uri(bare) if "://" in bare else (fs.LocalFileSystem(), bare)
        with system.open_input_stream(name) as f:
            head, rows = normal_table(sheet_rows(f.read()))
        yield from ((i, r) for i, r in enumerate([head, *rows] if head else [], 1))
