"""File sources and sinks: scans by suffix, bytes to text, JSON lines, tables, reports."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.config import FIELD_WEIGHTS
from fieldloom.functions import text as X

#: fixed values: file suffixes by kind
SUFFIXES = {"work_order": (".txt",), "html": (".html", ".htm"), "markdown": (".md", ".markdown"), "manual": (".html", ".htm", ".md", ".markdown")}
#: fixed values: encodings tried in order, byte-order marks, other names of encodings, the name of the last resort
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "gbk", "cp936", "big5", "cp950")
MARKS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
ALIASES = {"gb2312": "gb18030", "gb_2312-80": "gb18030", "gb-2312": "gb18030", "x-gbk": "gbk", "unicode": "utf-16"}
LOSSY = "gb18030-replace"
HEAD = 4096
#: fixed values: columns of the exported part table
PART_COLUMNS = ("work_order_id", "reported_issue", "solution", "remarks", "part_number_name", "part_number", "part_name", "part_code", "quantity", "raw_text", "source_path", "parse_warnings")


def scan(spark: SparkSession, kind: str, root: str | None = None, paths: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of a folder's files of a kind, case of suffixes ignored; explicit paths go before the folder.

    limit (of files in path order) applies to a folder only. Neither root nor paths is an error.
    """
    pattern = rf"(?i)({'|'.join(re.escape(s) for s in SUFFIXES[kind])})\z"
    folder, wanted = checked_inputs(spark, root, paths)
    wanted = [p for p in wanted if p.lower().endswith(SUFFIXES[kind])]
    if paths and not wanted:
        raise ValueError(f"none of the paths is a {kind} file")
    reader = spark.read.format("binaryFile")
    df = reader.load(wanted) if wanted else reader.option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike(pattern))
    return df.orderBy("path").limit(limit) if limit is not None and not wanted else df


def checked_inputs(spark: SparkSession, root: str | None, paths: list[str] | None) -> tuple[str | None, list[str]]:
    """The folder and the paths, resolved; a path that is named twice, in whatever spelling, counts once. What is missing, or of the wrong kind, is an error."""
    if not root and not paths:
        raise ValueError("give a folder or paths")
    conf, of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def resolve(path: str, folder: bool) -> str:
        where = of(os.path.realpath(path) if "://" not in path and not path.startswith("file:") else path)
        fs = where.getFileSystem(conf)
        if not fs.exists(where):
            raise FileNotFoundError(f"{path} doesn't exist")
        if fs.getFileStatus(where).isDirectory() != folder:
            raise NotADirectoryError(f"{path} isn't a folder") if folder else IsADirectoryError(f"{path} is a folder")
        return fs.makeQualified(where).toString()

    own = list(dict.fromkeys(resolve(p, False) for p in paths or []))
    return (resolve(root, True) if root and not own else root), own


def candidates(raw: bytes, encodings: tuple[str, ...] = ENCODINGS) -> list[str]:
    """Encodings to try: by mark, by zero bytes, as declared, then the given ones."""
    head = raw[:HEAD]
    found = [name for mark, name in MARKS if raw.startswith(mark)]
    if len(head) >= 4:
        even, odd = (head[i::2].count(0) / len(head[i::2]) for i in (0, 1))
        found += ["utf-16-le"] * (odd > 0.25 and even < 0.05) + ["utf-16-be"] * (even > 0.25 and odd < 0.05)
    if m := re.search(rb"charset\s*=\s*['\"]?\s*([A-Za-z0-9._:-]+)", head, re.I):
        found.append(m[1].decode("ascii"))
    names = (ALIASES.get(n := x.strip().lower(), n) for x in (*found, *encodings))
    return [n for n in dict.fromkeys(names) if n]


def decode(raw: bytes | None, encodings: tuple[str, ...] = ENCODINGS) -> tuple[str | None, str | None]:
    """(text, encoding); the last resort replaces what it can't read and says so. Null has neither."""
    if raw is None:
        return None, None
    for name in candidates(raw, encodings):
        try:
            return raw.decode(name), name
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("gb18030", "replace"), LOSSY


_DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())])


@F.pandas_udf(_DECODED)
def _decode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in parts:
        yield pd.DataFrame([decode(None if x is None else bytes(x)) for x in s], columns=["text", "encoding"])


def with_text(files: DataFrame, content: str = "content", keep_hash: bool = False) -> DataFrame:
    """Add text, encoding, lossy and content_hash, unless the rows have theirs; drop the bytes."""
    d = (files if keep_hash else files.withColumn("content_hash", F.sha2(F.col(content), 256))).withColumn("_d", _decode(content))
    return d.select(*(c for c in d.columns if c not in (content, "_d")), "_d.text", "_d.encoding", (F.col("_d.encoding") == LOSSY).alias("lossy"))


def relative_path(path: Column, root: str) -> Column:
    return F.regexp_replace(path, rf"\A.*?{re.escape(root.rstrip('/'))}/", "")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, failures): objects with their file and line; blank lines are skipped, bad ones and non-objects set apart.

    Files are read in splits. Lines are numbered within their split, in which they lie in order, and moved by the lines of the
    splits before it in the file, so no file is one row or one task.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    splits = raw.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each split
    lines = raw.join(splits.withColumn("_before", before), ["file", "_start"])
    lines = lines.select("file", "line", (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int").alias("line_number")).where(X.py_strip(F.col("line")) != "")
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    parsed = lines.withColumn("_r", F.from_json("line", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull() | ~F.col("line").rlike(r"(?s)\A\s*\{")
    rows = parsed.where(~bad).select("file", "line_number", *(F.col("_r")[f.name].alias(f.name) for f in schema.fields))
    why = F.when(F.col("line").rlike(r"(?s)\A\s*\{"), "invalid_json").otherwise("not_an_object")
    return rows, parsed.where(bad).select("file", "line_number", "line", why.alias("error"))


def read_jsonl_text(lines: DataFrame, line: str, schema: str) -> DataFrame:
    return lines.withColumn("_r", F.from_json(line, schema))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """One pretty-printed document, for reports and manifests; its folder is made where it is missing."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n").encode()))
    out.close()


def index_manifest(created_at: str, inputs: dict, outputs: dict, counts: dict) -> dict:
    """What an index was made of and how, for those who search it."""
    tokenizer = {"ascii_code_tokens": True, "chinese_ngrams": [2, 3], "whole_chinese_sequence_max_chars": X.WHOLE_RUN}
    return {"schema_version": 1, "created_at": created_at, "inputs": inputs, "outputs": outputs, "counts": counts, "field_weights": dict(FIELD_WEIGHTS), "tokenizer": tokenizer}


def write_inverted_index(blocks: DataFrame, path: str) -> None:
    """An inverted index (index.inverted_index) as JSON lines, a line for each block of a term, sorted by term within each file."""
    blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").json(path)


def part_table(parsed: DataFrame) -> DataFrame:
    """A row for each part with its order's values; the fixed columns of the export."""
    rows = parsed.select("work_order_id", "reported_issue", "solution", "remarks", "source_path", F.array_join("parse_warnings", "|").alias("parse_warnings"), F.explode("parts").alias("_p"))
    return rows.select(*(F.col(f"_p.{c}" if c in ("part_number_name", "part_number", "part_name", "part_code", "quantity", "raw_text") else c).alias(c) for c in PART_COLUMNS))


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """CSV with a header and doubled quotes; with a byte-order mark the first column's name carries it in every part, for spreadsheet programs."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, "﻿" + first) if mark else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def skip_existing(pending: DataFrame, done: DataFrame, key: str = "relative_path") -> DataFrame:
    """Inputs without an output yet, when outputs aren't to be overwritten."""
    return pending.join(done.select(key), key, "left_anti")


# --- tables for evaluation ----------------------------------------------------------------------


def normal_table(rows: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """Headers and rows of a sheet: blank rows dropped, the first row the header, blank headers numbered, rows padded or cut to its width."""
    kept = [[("" if c is None else str(c)).strip() for c in r] for r in rows]
    kept = [r for r in kept if any(r)]
    if not kept:
        return [], []
    head = [h or f"列{i}" for i, h in enumerate(kept[0], 1)]
    return head, [(r + [""] * len(head))[: len(head)] for r in kept[1:]]


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet in UTF-8 as text columns; row_number counts from 2, the header being row 1. Bounded by one sheet: read as one file."""
    import csv
    import io

    raw = bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
    try:
        sheet = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    except UnicodeDecodeError as e:
        raise ValueError("the table must be UTF-8") from e
    return table_frame(spark, *normal_table(sheet))


def table_frame(spark: SparkSession, head: list[str], rows: list[list[str]]) -> DataFrame:
    names = [h if head.index(h) == i else f"{h}_{i + 1}" for i, h in enumerate(head)]
    schema = T.StructType([T.StructField("row_number", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in names)])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 2)], schema)
