"""Nearest-URL page differencing: what pages share with their neighbours is template, not text.

Within a host pages are ordered by URL path; each is paired with the neighbour whose path begins most alike, their
lines are aligned by longest common subsequence, and the shared lines are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.index import number_documents
from fieldloom.session import table

#: products of line counts up to which the alignment is a full table; larger stretches with few pairs of equal lines take a longest rising part of these, others are first halved where a longest alignment passes. The length is the same in all ways
FULL, PAIRS = 4_000_000, 500_000


def _table(a: list[str], b: list[str]) -> list[int]:
    """Indexes of a's lines in a longest common subsequence, row by row over the whole table."""
    ids = {x: i for i, x in enumerate(dict.fromkeys(b))}
    bi = np.array([ids[x] for x in b])
    best = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for i in range(len(a) - 1, -1, -1):
        hit = np.where(bi == ids.get(a[i], -1), best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(hit[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b) and best[i, j]:
        if a[i] == b[j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append(i)
            i, j = i + 1, j + 1
        elif best[i + 1, j] == best[i, j]:
            i += 1
        else:
            j += 1
    return out


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a with each beginning of b, in one row."""
    best = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        best[1:] = np.maximum.accumulate(np.where(b == x, best[:-1] + 1, best[1:]))
    return best


def _split(a: list[str], b: list[str]) -> int:
    """How many of b's lines a longest alignment gives to the first half of a (Hirschberg: memory of one row)."""
    ids = {x: i for i, x in enumerate(dict.fromkeys(b))}
    x, y, mid = np.array([ids.get(v, -1) for v in a]), np.array([ids[v] for v in b]), len(a) // 2
    return int(np.argmax(_lengths(x[:mid], y) + _lengths(x[mid:][::-1], y[::-1])[::-1]))


def shared_lines(a: list[str], b: list[str]) -> list[int]:
    """Indexes of a's lines that the alignment with b shares, in order."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append(a1)
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= FULL:
            out += [a0 + i for i in _table(a[a0:a1], b[b0:b1])]
            continue
        if a1 - a0 == 1:
            out += [a0] * (a[a0] in b[b0:b1])
            continue
        where: dict[str, list[int]] = {}
        for j in range(b1 - 1, b0 - 1, -1):
            where.setdefault(b[j], []).append(j)
        if sum(len(where.get(x, ())) for x in a[a0:a1]) <= PAIRS:  # Hunt-Szymanski
            out += [i for i, _ in _rising([(i, j) for i in range(a0, a1) for j in where.get(a[i], ())])]
            continue
        mid, at = (a0 + a1) // 2, _split(a[a0:a1], b[b0:b1])
        todo += [(a0, mid, b0, b0 + at), (mid, a1, b0 + at, b1)]
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs whose second values rise."""
    from bisect import bisect_left

    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        tops[at : at + 1] = [j]
        last[at : at + 1] = [k]
        back.append(last[at - 1] if at else -1)
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _alike(x: str, y: str) -> int:
    n = min(len(x), len(y))
    return next((i for i in range(n) if x[i] != y[i]), n)


def neighbours(pages: DataFrame, page_id: str, url: str, text: str) -> DataFrame:
    """(page_id, url, text, before and after: neighbour's id, url and text or null). Positions come from range partitions, and
    neighbours meet in an equi-join on them, so a host with a third of all pages is no single task."""
    p = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"), F.col(text).alias("text")).where("url is not null and text is not null")
    host = F.regexp_extract("url", r"\A(?:[a-z]+://)?[^/]*", 0)
    n = number_documents(p.withColumn("host", host).withColumn("_key", F.concat_ws("\x00", "host", "url", "page_id")), "_key", "n").drop("_key")
    side = lambda name, by: n.select((F.col("n") + by).alias("n"), F.col("host").alias(f"{name}_host"), *(F.col(c).alias(f"{name}_{c}") for c in ("page_id", "url", "text")))
    own = lambda name, c: F.when(F.col("host") == F.col(f"{name}_host"), F.col(f"{name}_{c}")).alias(f"{name}_{c}")
    both = n.join(side("before", 1), "n", "left").join(side("after", -1), "n", "left")
    return both.select("page_id", "url", "text", *(own(s, c) for s in ("before", "after") for c in ("page_id", "url", "text")))


def difference(pages: DataFrame, page_id: str, url: str, text: str) -> DataFrame:
    """(page_id, nearest_id, lines, shared, own_text): pages without the lines they share with their nearest page.

    Of two equally near pages the one before is taken. The only page of a host keeps everything; pages without a
    URL or text are left out; an empty text has no lines. Blank lines are neither shared nor dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                rows = []
                for i, u, t, bi, bu, bt, ai, au, at_ in zip(*(c.to_pylist() for c in whole.slice(at, 500).columns), strict=True):
                    near, other = (bi, bt) if bi is not None and (ai is None or _alike(u, bu) >= _alike(u, au)) else (ai, at_)
                    lines = t.split("\n") if t else []
                    solid = [k for k, x in enumerate(lines) if x.strip()]
                    theirs = [x.strip() for x in (other or "").split("\n") if x.strip()]
                    gone = {solid[k] for k in shared_lines([lines[k].strip() for k in solid], theirs)}
                    rows.append((i, near, len(solid), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())], names=["page_id", "nearest_id", "lines", "shared", "own_text"])

    return neighbours(pages, page_id, url, text).mapInArrow(run, "page_id string, nearest_id string, lines int, shared int, own_text string")


def p3_differenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's text without what its nearest record by source path repeats."""
    return difference(table(spark, sf_dir, "index_documents"), "doc_id", "source_path", "text").withColumnRenamed("page_id", "doc_id")
