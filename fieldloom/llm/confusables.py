"""Visually identical text: plain forms, and a skeleton by which equal-looking values group.

Skeleton: decompose, replace every character by its prototype from the look-alike table, decompose again.
The table is the public Unicode confusables data, read from the copy that Spark's own Unicode library has. The plain
form is the readable counterpart: look-alikes are replaced only where the run of letters they stand in is not a word of
their own script, so whole Russian words and Greek unit symbols stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.session import table

#: fixed values: Cyrillic and Greek letters, and the Latin letters they can't be told from
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХЗЬҮаеѕіјорсухԁһӏԛԝ", "ABESIJKMHOPCTYX3bYaesijopcyxdhlqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲ", "ABEZHIKMNOPTYXovc", strict=True))
#: fixed values: other look-alikes
OTHER = {"µ": "μ", "ı": "i", "ɑ": "a", "ɡ": "g", "∕": "/", "⁄": "/", "∶": ":", "ℓ": "l"}
#: fixed values: hyphens that differ from the ASCII one
HYPHENS = "‐‑‒–−－﹣˗⁃"
#: fixed values: CJK radicals in short forms without a normal form in the character database
RADICALS = dict(zip("⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻥⻦⻩⻬⻮⻰⻳", "西见角贝车长门青韦页风飞食马鱼鸟黄齐齿龙龟", strict=True))

_LATIN_BACK = {v: k for k, v in CYRILLIC.items() if v.isalpha() and k not in "ЅІЈҮѕіјԁһӏԛԝЗЬ"}
_PLAIN = r"\x20-\x7e一-鿿À-ÖØ-öø-ÿ，。、；：？！（）《》【】“”‘’…—·ΦΩμ"
#: no look-alike can hide in a value that this doesn't find
SUSPECT = rf"[^{_PLAIN}]"
#: values that are their own plain form and skeleton
SIMPLE = r"\A[\x20-\x7e一-鿿，。、；：（）]*\z"
_RUN = re.compile(r"(?:[^\W_]|(?<=[^\W_])[\u0300-\u036f])+")


@lru_cache(maxsize=65536)
def _script(c: str) -> str:
    """The first word of a character's name, which is its script's."""
    return "LATIN" if c.isascii() else unicodedata.name(c, "").partition(" ")[0]


def _ascii_kind(c: str, proto: str) -> str:
    """The prototype of a class that holds a digit and letters, in the member of the character's own kind: digits of 1 and 0, capitals I and O, small letters l and o. Small capitals are the capital."""
    if (small := unicodedata.name(c, "").removeprefix("LATIN LETTER SMALL CAPITAL ")) and len(small) == 1:
        return small
    if proto == "l":
        return "1" if c.isdigit() else "I" if c.isupper() else "l" if c.isalpha() else "|"
    if proto == "O" and c.isdigit():
        return "0"
    return "m" if proto == "rn" and c.isalpha() and len(unicodedata.normalize("NFKC", c)) == 1 else proto


def prototypes(spark: SparkSession) -> dict[str, str]:
    """Characters to their prototypes: one call over all assigned characters, so the table is as large as the standard, whatever the data.

    ASCII characters and ordinary Chinese ones stand for themselves: 0 and O, 1 and l, 士 and 土 differ.
    """
    chars = [c for o in range(0x80, 0x20000) if not 0xD800 <= o < 0xE000 and not 0x4E00 <= o <= 0x9FFF and not 0xAC00 <= o < 0xD7A4 and unicodedata.category(c := chr(o)) not in ("Cn", "Co", "Cc", "Cf")]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    found = zip(chars, checker.getSkeleton("\n".join(chars)).split("\n"), strict=True)
    table = ((c, _ascii_kind(c, p)) for c, p in found)
    return {c: p for c, p in table if p and p != unicodedata.normalize("NFD", c)}


class Lookalikes:
    """Plain forms and skeletons by a table of prototypes. Results for characters are kept, so a text costs a look-up each."""

    def __init__(self, table: Mapping[str, str]) -> None:
        self.table = table
        self.singles: dict[str, str] = {}
        self.protos: dict[str, str] = {}

    def _single(self, c: str) -> str:
        """One character by itself: invisible ones vanish, spaces, hyphens, full-width, styled and radical forms turn plain."""
        if (out := self.singles.get(c)) is None:
            out = self.singles[c] = _single(c)
        return out

    def _prototype(self, c: str) -> str:
        if (out := self.protos.get(c)) is None:
            own = CYRILLIC.get(c) or GREEK.get(c) or self._single(c)
            out = self.protos[c] = self.table.get(own, own) if len(own) == 1 else own
        return out

    def _latin(self, c: str) -> str | None:
        """The ASCII letters or digits that a letter of another script, or an unusual Latin one, can't be told from."""
        if c in CYRILLIC or c in GREEK:
            return CYRILLIC.get(c) or GREEK[c]
        if c.isascii() or c in "ΦΩμ" or "А" <= c <= "ё" or "À" <= c <= "\u024f" or _script(c) in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL") or _script(c) == "GREEK" and not c.isupper():
            return None
        p = self.table.get(c, "")
        return p if p.isascii() and p.isalnum() else None

    def _word(self, m: re.Match) -> str:
        """A run of letters and digits in one spelling; Chinese characters part runs."""
        return "".join(x if _script(x[0]) == "CJK" else self._spelling(x) for x in re.findall(r"[㐀-鿿豈-﫿]+|[^㐀-鿿豈-﫿]+", m[0]))

    def _spelling(self, run: str) -> str:
        """A run by its scripts: a word of another script, which holds a letter that is no look-alike, stays, and Latin letters in a Russian word are the look-alikes."""
        if run.isascii():
            return run
        scripts = {_script(c) for c in run if c.isalpha()}
        own = {_script(c) for c in run if c.isalpha() and not c.isascii() and self._latin(c) is None and c not in "ΦΩμ"} - {"LATIN"}
        if "CYRILLIC" in own and not own - {"CYRILLIC"}:
            return "".join(_LATIN_BACK.get(GREEK.get(c, c), c) for c in run) if scripts - {"CYRILLIC"} else run
        return "".join(c if _script(c) in own else self._latin(c) or c for c in run)

    def plain(self, text: str | None) -> str | None:
        """The consistent spelling of a value. Null stays null, empty stays empty; plain values come back unchanged."""
        if text is None:
            return None
        return _RUN.sub(self._word, unicodedata.normalize("NFC", "".join(map(self._single, text))))

    def skeleton(self, text: str | None) -> str | None:
        """Equal for values that look equal. Unlike the plain form it is not meant to be read."""
        if text is None:
            return None
        bare = unicodedata.normalize("NFC", "".join(map(self._single, text)))
        return unicodedata.normalize("NFD", "".join(map(self._prototype, unicodedata.normalize("NFD", bare))))

    def disguised(self, text: str | None) -> bool:
        """Whether a value differs from a plain one that has the same skeleton: it stands in one group with its plain form."""
        plain = self.plain(text)
        return plain != text and self.skeleton(plain) == self.skeleton(text)


def _single(c: str) -> str:
    o, kind = ord(c), unicodedata.category(c)
    if c == " " or "!" <= c <= "~":
        return c
    if kind in ("Cf", "Cc") or c in "͏ᅟᅠㅤﾠ" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
        return "" if c not in "\t\n\r" else " "
    if kind == "Zs":
        return " "
    if c in HYPHENS:
        return "-"
    if c in RADICALS:
        return RADICALS[c]
    if c in OTHER:
        return OTHER[c]
    if 0xFF01 <= o <= 0xFF5E:  # full-width ASCII: letters and digits; its punctuation is Chinese punctuation
        half = chr(o - 0xFEE0)
        return half if half.isalnum() else c
    if 0x2E80 <= o <= 0x2FDF or 0xF900 <= o <= 0xFAFF or 0x2F800 <= o <= 0x2FA1F or 0x2160 <= o <= 0x217F or 0x1D400 <= o <= 0x1D7FF:
        return unicodedata.normalize("NFKC", c)
    return c


def lookalikes(spark: SparkSession) -> Broadcast:
    """The table on its way to the executors, sent once for an application."""
    key = spark.sparkContext.applicationId
    if key not in _sent:
        _sent.clear()
        _sent[key] = spark.sparkContext.broadcast(prototypes(spark))
    return _sent[key]


_sent: dict[str, Broadcast] = {}


def _ready(sent: Broadcast) -> Lookalikes:
    """The table as this process uses it."""
    if sent.value is not _built.get("table"):
        _built.update(table=sent.value, use=Lookalikes(sent.value))
    return _built["use"]


_built: dict = {}


def _udf(spark: SparkSession, of: str, kind: T.DataType):  # noqa: ANN202
    sent = lookalikes(spark)

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(getattr(_ready(sent), of))

    return run


def plain_form(spark: SparkSession):  # noqa: ANN201
    """A function of a column: its plain form."""
    return _udf(spark, "plain", T.StringType())


def skeleton(spark: SparkSession):  # noqa: ANN201
    return _udf(spark, "skeleton", T.StringType())


def disguised(spark: SparkSession):  # noqa: ANN201
    return _udf(spark, "disguised", T.BooleanType())


def with_plain_form(df: DataFrame, col: str, plain: str = "plain") -> DataFrame:
    """Add the plain form. Only values with a suspect character go to Python."""
    suspect = df.where(F.col(col).rlike(SUSPECT)).withColumn(plain, plain_form(df.sparkSession)(col))
    rest = df.where(~F.coalesce(F.col(col).rlike(SUSPECT), F.lit(False))).withColumn(plain, F.col(col))
    return suspect.unionByName(rest)


def groups(values: DataFrame, value: str, *by: str) -> DataFrame:
    """Distinct values that need a consistent form, within equal `by`: (*by, value, canonical, rows, spellings, group_rows).

    Values with equal skeleton are a group. All values of a group with more than one spelling come out, and every
    other value whose plain form differs. Counts are summed per distinct value first, so a hot value is one row before
    anything is shuffled by skeleton. The canonical spelling of a group is the plain form of its commonest value;
    nulls are left out.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("rows"))
    simple = F.col("value").rlike(SIMPLE)
    own = counted.where(simple).select("*", F.col("value").alias("plain"), F.col("value").alias("skeleton"))
    keyed = own.unionByName(counted.where(~simple).select("*", plain_form(values.sparkSession)("value").alias("plain"), skeleton(values.sparkSession)("value").alias("skeleton")))
    sums = keyed.groupBy(*by, "skeleton").agg(F.count("*").alias("spellings"), F.sum("rows").alias("group_rows"), F.max_by("plain", F.struct("rows", "plain")).alias("canonical"))
    return keyed.join(sums, [*by, "skeleton"]).where("spellings > 1 or canonical <> value").select(*by, "value", "canonical", "rows", "spellings", "group_rows")


def _stacked(parts: DataFrame, *fields: str) -> DataFrame:
    """(part_id, field, value): the fields one below the other."""
    stacked = parts.select("part_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x"))
    return stacked.select("part_id", "x.field", "x.value")


def found(values: DataFrame, value: str) -> DataFrame:
    """The rows whose value is disguised: its skeleton is that of a plain spelling, which it is not itself. Values without a suspect character don't go to Python; no shuffle."""
    return values.where(F.col(value).rlike(SUSPECT)).where(disguised(values.sparkSession)(value))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wo = table(spark, sf_dir, "work_orders").select(F.lit("reported_issue").alias("field"), F.col("record_id").cast("bigint").alias("row_id"), F.col("reported_issue").alias("value"))
    parts = _stacked(table(spark, sf_dir, "part_evidence"), "part_code", "part_name").select("field", F.col("part_id").cast("bigint").alias("row_id"), "value")
    return found(wo, "value").unionByName(found(parts, "value")).select("field", "row_id")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the three fields that look equal but are spelt differently, and other disguised ones, with their one consistent form."""
    wo = table(spark, sf_dir, "work_orders").select(F.lit("reported_issue").alias("field"), F.col("reported_issue").alias("value"))
    pe = table(spark, sf_dir, "part_evidence")
    return groups(wo.unionByName(_stacked(pe, "part_code", "part_name").select("field", "value")), "value", "field")
