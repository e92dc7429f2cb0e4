"""Fields that pack several values: one row per value, position kept.

A finite-state tokenizer walks the text once. It knows whether it is inside double quotes
(where a doubled quote stands for one) and how deep it is nested in brackets; only a delimiter
outside both ends an entry. Entries that don't open with a code belong to the entry before them
(a note, a name, a quantity), and words before the first code introduce the list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import table

#: fixed values: characters that part entries anywhere; those that do so only between blanks
DELIMITERS = "\n\r;；、,，|"
SPACED_DELIMITERS = "/+"
#: fixed values: labels of a work-order file
REMARKS_LABEL = "备注"
OTHER_LABELS = ("工单ID", "用户报修内容", "人员落实及解决方法", "备件信息")

_OPEN, _CLOSE = "(（[【", ")）]】"
_CODE = re.compile(r"(?=[^\s一-鿿]{4})(?=(?:[^\s一-鿿]*\d){2})\w")
#: words that introduce a list, of any length: up to a colon, Chinese ones before a blank, or right before a code
_INTRO = re.compile(r"\s*[^\d\n;；、,，|\":：=]+[:：=]\s*|\s*[一-鿿]{2,}+(?:\s+(?=[\"\w])|(?=[\"A-Za-z\d]))")


def tokenize(text: str) -> list[tuple[int, int, bool]]:
    """Spans (start, end, quoted) of the pieces between delimiters; blank pieces are left out.

    A quote opens only where a piece begins and closes where a delimiter, a blank run before one, or the
    end follows; a quote that never closes is an ordinary character.
    """
    n, i, out = len(text), 0, []
    ahead: dict[str, int] = {}  # where each sought character comes next; sought again only once passed

    def upcoming(c: str, at: int) -> int:
        if ahead.get(c, -1) < at:
            found = text.find(c, at)
            ahead[c] = n if found < 0 else found
        return ahead[c]

    while i < n:
        while i < n and (text[i].isspace() or text[i] in DELIMITERS):
            i += 1
        if i >= n:
            break
        start = i
        if text[i] == '"':
            j = i + 1
            while j < n:
                if text[j] == '"':
                    if j + 1 < n and text[j + 1] == '"':
                        j += 2
                        continue
                    break
                j += 1
            k = j + 1
            while k < n and text[k] in " \t　":
                k += 1
            if j < n and (k >= n or text[k] in DELIMITERS or text[k] in SPACED_DELIMITERS):
                out.append((start, j + 1, True))
                i = k + (k < n)
                continue
        depth = 0
        while i < n:
            c = text[i]
            if c in _OPEN:
                depth += upcoming(_CLOSE[_OPEN.index(c)], i) < upcoming("\n", i)
            elif c in _CLOSE:
                depth = max(0, depth - 1)
            elif not depth and (c in DELIMITERS or c in SPACED_DELIMITERS and i > start and text[i - 1].isspace() and (i + 1 >= n or text[i + 1].isspace())):
                break
            i += 1
        if text[start:i].strip():
            out.append((start, i, False))
        i += 1
    return out


def entries(text: str | None) -> list[str]:
    """The listed entries in order. Null, empty and blank texts give none; equal entries count each."""
    if not text or text.isspace():
        return []
    if m := _INTRO.match(text):
        rest = text[m.end() :].lstrip()
        if _CODE.match(rest.lstrip('"')):
            text = rest
    out: list[list] = []
    for start, end, quoted in tokenize(text):
        plain = text[start + 1 : end - 1] if quoted else text[start:end]
        if out and not _CODE.match(plain.strip()):
            out[-1][1] = end
            out[-1][2] = False
        else:
            out.append([start, end, quoted])
    values = [text[a + 1 : b - 1].replace('""', '"').strip() if q else text[a:b].strip() for a, b, q in out]
    return [v for v in values if v]


def split_values(df: DataFrame, row_id: str, value: str, least: int = 2) -> DataFrame:
    """(row_id, pos, value) for each entry of the lists of at least `least` entries; pos counts from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pos, vals = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = entries(t)
                if len(found) >= least:
                    ids += [i] * len(found)
                    pos += range(1, len(found) + 1)
                    vals += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(vals, pa.string())], names=["row_id", "pos", "value"])

    return df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(value).alias("value")).mapInArrow(run, "row_id bigint, pos int, value string")


def remarks(raw: Column) -> Column:
    """What stands after the last remarks label up to a blank line or another label; null without one."""
    others = "|".join(OTHER_LABELS)
    return F.nullif(F.regexp_extract(raw, rf"(?s)(?:\A|\n)[ \t　]*{REMARKS_LABEL}[ \t　]*[:：](.*?)(?=\n[ \t　]*\n|\n[ \t　]*(?:{others})[ \t　]*[:：]|\z)", 1), F.lit(""))


_HAS_DELIMITER = rf"[{DELIMITERS}]|\s[/+]\s"


def _lists(df: DataFrame, field: str, row_id: str, value: Column) -> DataFrame:
    cand = df.select(F.col(row_id).alias("row_id"), value.alias("value")).where(F.col("value").rlike(_HAS_DELIMITER) & F.col("value").rlike(r"\d"))
    return split_values(cand, "row_id", "value").select(F.lit(field).alias("field"), "row_id", "pos", "value")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No shuffle: every list lives in one row; a delimiter test in the scan keeps plain rows out of Python."""
    pe = table(spark, sf_dir, "part_evidence").select("part_id", "part_number_name", "part_number", "part_name", "part_code", "quantity", "raw_text")
    only_raw = F.coalesce(*(F.col(c) for c in ("part_number_name", "part_number", "part_name", "part_code", "quantity"))).isNull()
    wo = table(spark, sf_dir, "work_orders").select("record_id", "raw_text")
    both = pe.select("part_id", F.when(only_raw, F.col("raw_text")).alias("raw_text"), "part_number_name")
    return (
        _lists(both, "part_number_name", "part_id", F.col("part_number_name"))
        .unionByName(_lists(both, "part_raw_text", "part_id", F.col("raw_text")))
        .unionByName(_lists(wo, "order_raw_text", "record_id", remarks(F.col("raw_text"))))
    )
