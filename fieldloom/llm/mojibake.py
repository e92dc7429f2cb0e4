"""Text decoded with the wrong character encoding: find the garbled stretches and restore them.

Characters are mapped back to the bytes of a legacy codec, an automaton over the byte structure of the
supposed true encoding finds the maximal well-formed multibyte spans, and only those spans are decoded.
A span counts if it decodes to common characters while its own characters are uncommon ones. Stretches whose true or
supposed codec is a further single-byte one are read as a whole in each pair of codecs, and the best reading is scored against
the stretch as it is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import spread, table

#: fixed values: (codec it was read with, encoding it was written in)
SINGLE_BYTE = ("cp1252", "cp1251")
DOUBLE_BYTE = ("gb18030", "cp932", "big5", "cp949")
#: fixed values: further single-byte codecs that UTF-8 and GB may have been read with; Cyrillic codecs, both as written and as read with
FURTHER = ("cp850", "cp437", "cp866", "koi8-r", "cp1250", "mac_roman", "mac_cyrillic")
CYRILLIC = ("cp1251", "koi8-r", "cp866")
READ_AS = ("cp1252", "cp1251", "koi8-r", "cp866", "cp850", "cp437", "cp1250", "mac_roman")


@lru_cache(maxsize=1)
def _levels() -> tuple[frozenset, frozenset]:
    """Chinese characters of the first level (the common ones) and of both levels, by the rows of the national standard."""
    row = lambda r: "".join(bytes((0xA0 + r, 0xA0 + c)).decode("gb2312", "ignore") for c in range(1, 95))
    first = frozenset("".join(row(r) for r in range(16, 56)))
    return first, first | frozenset("".join(row(r) for r in range(56, 88)))


#: fixed values: punctuation and symbols of ordinary Chinese text, letters of the foreign names and words in it
_PUNCT = "，。、；：？！（）《》【】“”‘’…—·　℃°±×÷ΦΩμ½¼¾"
_FOREIGN = "".join(map(chr, [*range(0xC0, 0x100), *range(0x410, 0x450), 0x401, 0x451]))
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))


@lru_cache(maxsize=1)
def _good() -> frozenset:
    return _levels()[0] | frozenset(_PUNCT + _FULL)


def _good_text(s: str, share: float = 1.0) -> bool:
    both, good = _levels()[1], _good()
    if any(c not in both and c not in good and not " " <= c <= "~" for c in s):
        return False
    n = sum(not c.isascii() for c in s)
    return n > 0 and sum(c in good for c in s if not c.isascii()) >= share * n


@lru_cache(maxsize=1)
def _odd() -> re.Pattern:
    """A character that garbled text can't do without and ordinary text seldom has."""
    plain = "".join(sorted(_levels()[0] | set(_PUNCT + _FULL)))
    return re.compile(rf"[^\n\r\t -~{re.escape(plain)}]")


@lru_cache(maxsize=16)
def _byte_table(codec: str) -> dict[str, int]:
    """Every character of a single-byte codec to its byte; bytes it leaves open stand for themselves."""
    out = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        out[bytes((b,)).decode(codec, "ignore") or chr(b)] = b
    if codec == "cp1252":
        out |= {chr(b): b for b in range(0xA0, 0x100)}
    return out


#: byte-structure automata as patterns over bytes: maximal runs of well-formed multibyte sequences
_UTF8 = rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})"
UTF8_RUN = re.compile(_UTF8 + rb"+")
GB_RUN = re.compile(rb"(?:[\xa1-\xf7][\xa1-\xfe])+")

_CHUNK = re.compile(r"[^\x00-\x7f]+(?:[ -~\n]{1,3}[^\x00-\x7f]+)*")
_LATIN_JOINED = re.compile(r"[A-Za-z][㐀-鿿][a-z]|(?<![㐀-鿿])[㐀-鿿][a-z]{3}")
_KUN = re.compile("锟斤|斤拷|锟")
_KANA_HALF = re.compile("[ｦ-ﾟ]")


class _Bytes(dict):
    """Bytes of each character in a codec, worked out once; byte 0, which no automaton takes, for those it can't hold."""

    def __init__(self, codec: str) -> None:
        super().__init__()
        self.codec = codec
        if codec not in DOUBLE_BYTE:
            self.update({c: bytes((b,)) for c, b in _byte_table(codec).items()})

    def __missing__(self, c: str) -> bytes:
        b = b"\0"
        if c < "\x80":
            b = c.encode()
        elif self.codec in DOUBLE_BYTE and (self.codec == "gb18030" or not 0x370 <= ord(c) < 0x530):
            try:  # letters of other alphabets are letters, whatever bytes an East Asian codec has for them
                b = c.encode(self.codec)
            except UnicodeEncodeError:
                pass
        self[c] = b
        return b


@lru_cache(maxsize=16)
def _char_bytes(codec: str) -> _Bytes:
    return _Bytes(codec)


def _bytes_of(chunk: str, codec: str) -> tuple[bytes, list[int]]:
    """Bytes of a chunk and for each byte its character's index."""
    of = _char_bytes(codec)
    parts = [of[c] for c in chunk]
    return b"".join(parts), [i for i, p in enumerate(parts) for _ in p]


def _utf8_spans(chunk: str, codec: str) -> Iterator[tuple[int, int, str]]:
    raw, at = _bytes_of(chunk, codec)
    for m in UTF8_RUN.finditer(raw):
        s = m.group().decode("utf-8", "ignore")
        yield at[m.start()], at[m.end() - 1] + 1, s


@lru_cache(maxsize=1)
def _readable() -> frozenset:
    return _levels()[1] | frozenset(_PUNCT + _FULL + _FOREIGN + "�")


def _plausible_spans(chunk: str, codec: str) -> Iterator[tuple[int, int, str]]:
    """The parts of well-formed spans that read as text: next to a garbled stretch, sound bytes may happen to form a character too."""
    raw, at = _bytes_of(chunk, codec)
    ok = _readable()
    for m in UTF8_RUN.finditer(raw):
        pos, run, first = m.start(), "", m.start()
        for c in [*m.group().decode("utf-8", "ignore"), ""]:
            if c and c in ok:
                first, run = (pos, c) if not run else (first, run + c)
            elif run:
                yield at[first], at[pos - 1] + 1, run
                run = ""
            pos += len(c.encode())


def _gb_spans(chunk: str, codec: str) -> Iterator[tuple[int, int, str]]:
    raw, at = _bytes_of(chunk, codec)
    for m in GB_RUN.finditer(raw):
        a, b = m.span()
        yield at[a], at[b - 1] + 1, raw[a:b].decode("gb2312", "replace")


def _chunk_spans(chunk: str, before: str, after: str, known: frozenset = frozenset()) -> list[tuple[int, int, str | None]]:
    """Garbled spans of one stretch of non-ASCII text; restored is None where the text can't be had back.

    known: codecs that longer spans of the same text were read with; of these, single characters count too.
    """
    first, both = _levels()
    found: list[tuple[int, int, str | None]] = [(m.start(), m.end(), None) for m in re.finditer("�+", chunk)]
    found += [(m.start(), m.end(), None) for m in _KUN.finditer(chunk)]
    for codec in SINGLE_BYTE:
        table_ = _byte_table(codec)
        if sum(c in table_ for c in chunk) < 2:
            continue
        for a, b, s in _utf8_spans(chunk, codec):
            src = chunk[a:b]
            good = all(c in both or c in _PUNCT or c in _FOREIGN or c in _FULL or 0x80 <= ord(c) < 0x100 or 0x2000 <= ord(c) < 0x2070 or c in "€™œŒšŠžŸƒ†‡•‰" or 0x370 <= ord(c) < 0x400 or 0x2e80 <= ord(c) < 0x2fe0 or c in "​‌‍⁠﻿�" for c in s)
            if codec == "cp1252" and (good or len(s) > 2) or codec == "cp1251" and good and (any(c in both for c in s) or len(s) > 1 and not src.isalpha()):
                found.append((a, b, s if good else None))
        for a, b, s in _gb_spans(chunk, codec):
            src = chunk[a:b]
            if "�" in s or not _good_text(s, 0.7):
                continue
            if codec == "cp1251":
                letters = sum(c.isalpha() and "А" <= c <= "я" for c in src)
                word = letters == len(src) and (src.islower() or src.isupper() or src[1:].islower())
                if (len(s) >= 2 or codec in known) and not word or codec in known and _good_text(s) or len(s) >= 5 and _good_text(s, 1.0) and not (src.islower() or src.isupper()):
                    found.append((a, b, s))
            elif len(s) >= 2 or codec in known or not re.search(r"[A-Za-z]", before[-1:] + after[:1]) and s in first and not (src[0] in "±×÷°·½¼¾"):
                found.append((a, b, s))
    if _odd().search(chunk) or _LATIN_JOINED.search(before[-1:] + chunk + after[:3]):
        for a, b, s in _plausible_spans(chunk, "gb18030"):
            src = chunk[a:b]
            odd = sum(c not in first for c in src)
            han = sum(c in both or c in _PUNCT for c in s)
            cyr = sum(0x400 <= ord(c) < 0x460 for c in s)
            if "�" in s or han >= 2 and han == len(s) and odd >= 1 and sum(c in first or c in _PUNCT for c in s) >= 0.6 * len(s):
                found.append((a, b, None if "�" in s else s))
            elif cyr >= 3 and cyr == len(s) and odd:
                found.append((a, b, s))
            elif len(s) <= 2 and all(c in _FOREIGN for c in s) and s.isalpha():
                left, right = (before + chunk[:a])[-1:], (chunk[b:] + after)[:3]
                if re.match(r"[A-Za-z]", left) and re.match(r"[a-z]", right) or not re.match(r"\w", left or " ") and re.match(r"[a-z]{3}", right):
                    found.append((a, b, s))
    if _KANA_HALF.search(chunk) or any(c not in both for c in chunk):
        for a, b, s in _plausible_spans(chunk, "cp932"):
            if len(s) >= 2 and _good_text(s, 0.6) and sum(c not in first and c not in _PUNCT for c in chunk[a:b]) >= 1 and any(c in both for c in s):
                found.append((a, b, s))
    for a, b, s in [*_gb_spans(chunk, "big5"), *(_gb_spans(chunk, "cp949") if re.search("[가-힣]", chunk) else ())]:
        src = chunk[a:b]
        if "�" not in s and len(s) >= 2 and _good_text(s, 0.85) and sum(c not in first and c not in _PUNCT for c in src) >= max(2, 0.5 * len(src)):
            found.append((a, b, s))
    return found


#: fixed values: how often the letters of Russian are used, in thousandths
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 17, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 0.4, 0.4), strict=True))
_RATE = {c: math.log(n / 1000) for c, n in RUSSIAN.items()}
_RU_WORD = re.compile("[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+")
#: words of one stretch that was decoded together, with what may stand between them; Chinese text parts stretches
_FOREIGN_RUN = "[^\x00-\x7f\u2e80-\ua4cf\uf900-\ufaff\uff00-\uffef]+"
_JOINED = re.compile(f"{_FOREIGN_RUN}(?:[ ,.!?;:()-]{{1,2}}{_FOREIGN_RUN})*")
_WORD = re.compile(r"[^\x00-\x7f]+")
_BETWEEN = re.compile(r"[ ,.!?;:()-]{1,2}")


def russian_rate(text: str) -> float:
    """How much a text reads like Russian: the mean logarithm of its letters' frequencies, characters outside well-formed words counting as rarer than any letter."""
    n = total = 0.0
    for word in re.findall(r"[^\x00-\x7f]+", text):
        whole = _RU_WORD.fullmatch(word) is not None
        for c in word.lower():
            n += 1
            total += _RATE.get(c, -12.0) - (0.0 if whole else 3.0)
    return total / n if n else 0.0


def _cyrillic_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Stretches of eight characters or more that read like Russian in another pair of codecs and like nothing as they are."""
    for m in _JOINED.finditer(text):
        src = m[0]
        dense = re.sub(r"[\x00-\x7f]", "", src)
        if len(dense) < 8 or (now := russian_rate(src)) > -4.0:
            continue
        best: tuple[float, str] | None = None
        for read in READ_AS:
            table_ = _byte_table(read)
            if not all(c in table_ for c in dense):
                continue
            raw = bytes(ord(c) if c < "\x80" else table_[c] for c in src)
            for true in CYRILLIC:
                s = raw.decode(true, "replace")
                if true != read and (rate := russian_rate(s)) > -3.7 and rate > now + 1.0 and (best is None or rate > best[0]):
                    best = (rate, s)
        if best:
            yield m.start(), m.end(), best[1]


def _utf8_words(text: str, codec: str) -> Iterator[tuple[int, int, str]]:
    """Runs of words that each are UTF-8 throughout in a codec, decoded together; so words of one letter come back with the others."""
    of, run = _char_bytes(codec), []
    for m in [*_WORD.finditer(text), None]:
        s = None
        if m is not None and (len(m[0]) > 1 or codec == "gb18030"):
            raw = b"".join(of[c] for c in m[0])
            try:
                s = None if b"\0" in raw else raw.decode("utf-8")
            except UnicodeDecodeError:
                s = None
        if run and (s is None or not _BETWEEN.fullmatch(text[run[-1][1] : m.start()])):
            a, z = run[0][0], run[-1][1]
            yield a, z, "".join(w + text[e:n] for (_, e, w), n in zip(run, [x[0] for x in run[1:]] + [z], strict=True))
            run = []
        if s is not None:
            run.append((m.start(), m.end(), s))


def _whole_readings(text: str) -> Iterator[tuple[int, int, str]]:
    """Stretches that are UTF-8 throughout in one of the codecs, or two-byte GB throughout in a further one."""
    seen: list[tuple[int, int]] = []
    for codec in (*SINGLE_BYTE, *FURTHER, "gb18030"):
        for a, b, s in _utf8_words(text, codec):
            if any(x < b and a < y for x, y in seen):
                continue
            bare = re.sub(r"[\x00-\x7f]", "", s)
            seen += [(a, b)] * (codec != "gb18030")
            if len(bare) >= 3 and all(c in _readable() for c in bare) and (codec != "gb18030" and _level_share(s) > 0 or russian_rate(s) > max(-4.0, russian_rate(text[a:b]) + 1)):
                seen.append((a, b))
                yield a, b, s
    for m in _JOINED.finditer(text):
        a, b = m.span()
        if b - a < 6 or any(x < b and a < y for x, y in seen) or russian_rate(m[0]) > -5.0:  # a Russian word is one
            continue
        latin = all(c in _byte_table("cp1252") or c < "\x80" for c in m[0])
        for codec in (*FURTHER, *SINGLE_BYTE):
            of = _char_bytes(codec)
            raw = b"".join(of[c] for c in m[0])
            s = raw.decode("gb2312", "replace")
            bare = re.sub(r"[\x00-\x7f]", "", s)
            chinese = codec in FURTHER and not latin and len(bare) >= 3 and all(c in _good() for c in bare)
            if b"\0" not in raw and (chinese or len(bare) >= 4 and russian_rate(s) > -3.7 and all("Ѐ" <= c <= "ӿ" for c in bare)):
                yield a, b, s
                break


def _level_share(s: str) -> float:
    first = _levels()[0]
    return sum(c in first for c in s) / len(s) if s else 0.0


def garbled_spans(text: str | None) -> list[tuple[int, int, str | None]]:
    """(start, end, restored) of every stretch that was decoded wrongly, in order, without overlaps.

    Null and empty texts have none. Where readings overlap the longest wins, then one that restores.
    """
    if not text or text.isascii():
        return []
    kept = _scan(text, frozenset())
    single = [text[a:b] for a, b, s in kept if s and b - a >= 4]
    known = frozenset(c for c in SINGLE_BYTE if any(all(x in _byte_table(c) for x in t) for t in single))
    return _scan(text, known) if known else kept


#: a letter that is neither Chinese nor Russian, a box, a sign of a legacy codec, or Russian letters in an order of cases that no word has
_UNUSUAL = re.compile("[\u0080-\u036f\u2190-\u25ff\u0402-\u040f\u0452-\u045f\u2018-\u203a\u2260-\u2265\uf8ff]{2}|[\u0400-\u045f\u2013\u2014][\u00a0-\u00ff\u2190-\u25ff]|[а-яё][А-ЯЁ]{2}|[\u0400-\u045f]{8}|[\u0400-\u045f]{4}[ ,.][\u0400-\u045f]{4}")


def _scan(text: str, known: frozenset) -> list[tuple[int, int, str | None]]:
    out: list[tuple[int, int, str | None]] = []
    for m in _CHUNK.finditer(text):
        chunk, base = m.group(), m.start()
        if not (_odd().search(chunk) or _LATIN_JOINED.search(text[max(0, base - 1) : m.end() + 3])):
            continue
        whole = [(base + x, base + y, s) for x, y, s in (*_whole_readings(chunk), *_cyrillic_spans(chunk))] if _UNUSUAL.search(chunk) else []
        for part in re.finditer(r"[^\x00-\x7f]+", chunk):
            a, b = base + part.start(), base + part.end()
            if not any(p <= a and b <= q for p, q, _ in whole):  # a reading of more text is the surer one
                out += [(a + x, a + y, s) for x, y, s in _chunk_spans(part.group(), text[max(0, a - 4) : a], text[b : b + 4], known)]
        out += whole
    kept: list[tuple[int, int, str | None]] = []
    end = -1
    for a, b, s in sorted(out, key=lambda x: (x[0], -(x[1] - x[0]), x[2] is None)):
        if a >= end:
            kept.append((a, b, s))
            end = b
    return kept


def restore(text: str | None) -> str | None:
    """The text with every restorable stretch decoded, again until nothing is left to decode. No round lengthens a text, and none is made twice, so the rounds end."""
    seen = set()
    while text not in seen:
        seen.add(text)
        out, at = [], 0
        for a, b, s in garbled_spans(text):
            if s is not None:
                out += [text[at:a], s]
                at = b
        if not out:
            break
        text = "".join(out) + text[at:]
    return text


def repair(df: DataFrame, row_id: str, text: str, with_text: bool = True) -> DataFrame:
    """(row_id, spans, lost, restored) of the affected rows; whole texts, one Arrow pass, no shuffle unless there are fewer files than cores.

    lost counts the stretches that can't be restored; in `restored` they stand as they were.
    """
    schema = "row_id bigint, spans int, lost int, restored string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if spans := garbled_spans(t):
                    rows.append((i, len(spans), sum(s is None for _, _, s in spans), restore(t) if with_text else None))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["row_id", "spans", "lost", "restored"])

    rows = df.select(F.col(row_id).cast("bigint"), F.col(text)).where(F.col(text).rlike(r"[^\x00-\x7f]"))
    return spread(rows, df.sparkSession).mapInArrow(run, schema)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "work_orders"), "record_id", "raw_text", with_text=False).select(F.col("row_id").alias("record_id"))


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "work_orders"), "record_id", "raw_text").withColumnRenamed("row_id", "record_id")
