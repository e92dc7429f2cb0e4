"""Encoding a corpus with a public byte-level BPE tokenizer, by monoid tree reduction.

A text is halved until its pieces are short, the pieces are encoded, and neighbours are joined up the
tree. A join re-encodes a window at the seam and widens it until the tokens on both sides provably are
those of the whole text: on the left up to the first pre-token that the missing text could have changed,
on the right from the first position at which the window and the right part both begin a pre-token. The
splitting pattern looks ahead, never back, so from a shared beginning on all further tokens agree.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import spread, table

#: longest text in characters that is encoded in one piece
LEAF = 8192
#: characters that the splitting pattern needs to see from a pre-token's start to know it isn't a contraction
LOOK = 3
WINDOW = 64


def default_path(name: str = "byte_bpe_50k.json") -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


#: a piece: ids, the pre-token start (in characters of the piece) of each id, the piece's length
Piece = tuple[list[int], list[int], int]


def _piece(enc, length: int) -> Piece:
    starts, at, last = [], 0, None
    for word, (a, _) in zip(enc.word_ids, enc.offsets, strict=True):
        if word != last:
            at, last = a, word
        starts.append(at)
    return enc.ids, starts, length


def join(t, text: str, left: Piece, right: Piece, window: int = WINDOW) -> Piece:
    """The piece of text from those of its two halves, split at left's length."""
    (l_ids, l_at, m), (r_ids, r_at, n) = left, right
    if not m or not n:
        return (l_ids + r_ids, l_at + [a + m for a in r_at], m + n)
    # the last pre-token, a blank run before it and anything that could grow to a contraction may change
    s = l_at[-1]
    while s > 0 and (m - s < LOOK or text[s].isspace()):
        k = bisect_left(l_at, s)
        if k == 0:
            break
        s = l_at[k - 1]
    keep = bisect_left(l_at, s)
    begins = set(r_at)
    while True:
        end = min(m + window, m + n)
        ids, at, _ = _piece(t.encode(text[s:end], add_special_tokens=False), end - s)
        if end == m + n:
            return (l_ids[:keep] + ids, l_at[:keep] + [a + s for a in at], m + n)
        stable = at[-1] if at else 0
        for k, a in enumerate(at):
            p = a + s - m
            if p >= 0 and a < stable and end - s - a >= LOOK + 1 and p in begins and (k == 0 or at[k - 1] != a):
                j = bisect_left(r_at, p)
                return (l_ids[:keep] + ids[:k] + r_ids[j:], l_at[:keep] + [x + s for x in at[:k]] + [x + m for x in r_at[j:]], m + n)
        window *= 2


def encode_texts(texts: list[str | None], path: str, leaf: int = LEAF, window: int = WINDOW, counts: bool = False) -> list:
    """ids of each text, or how many; null and empty texts have none. Texts of one leaf need no joins, so they are encoded without positions."""
    t = load(path)

    def halves(a: int, b: int) -> list[int]:
        return [a] if b - a <= leaf else halves(a, (a + b) // 2) + halves((a + b) // 2, b)

    out: list = [0 if counts else [] for _ in texts]
    short = [i for i, x in enumerate(texts) if x and len(x) <= leaf]
    for i, e in zip(short, t.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
        out[i] = len(e) if counts else e.ids
    for i, x in enumerate(texts):
        if x and len(x) > leaf:
            c = [*halves(0, len(x)), len(x)]
            pieces = t.encode_batch([x[a:b] for a, b in zip(c, c[1:], strict=False)], add_special_tokens=False)
            level = [(a, b, _piece(e, b - a)) for a, b, e in zip(c, c[1:], pieces, strict=False)]
            while len(level) > 1:  # neighbours join, level by level
                up = [(l[0], r[1], join(t, x[l[0] : r[1]], l[2], r[2], window)) for l, r in zip(level[::2], level[1::2], strict=False)]
                level = up + level[len(up) * 2 :]
            ids = level[0][2][0]
            out[i] = len(ids) if counts else ids
    return out


def decode_ids(ids: list[int], path: str) -> str:
    """The text of the ids; bytes concatenate, so a round trip gives the text back exactly."""
    return load(path).decode(ids, skip_special_tokens=False)


def encode(df: DataFrame, row_id: str, text: str, path: str | None = None, carry: tuple[str, ...] = (), count_only: bool = False) -> DataFrame:
    """(row_id, *carry, ids), or n_tokens instead of ids. One pass, without a shuffle unless there are fewer files than cores; texts go to Python in Arrow batches."""
    where = path or default_path()
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kept = df.select(row_id, *carry, F.col(text).alias("_text"))
    last = "n_tokens bigint" if count_only else "ids array<int>"
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [last]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                found = encode_texts(b.column(b.num_columns - 1).to_pylist(), where, counts=count_only)
                col = pa.array(found, pa.int64() if count_only else pa.list_(pa.int32()))
                names = [*b.schema.names[:-1], "n_tokens" if count_only else "ids"]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], col], names=names)

    return spread(kept, df.sparkSession).mapInArrow(run, ", ".join(fields))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")
