"""Text functions as column expressions: tokens, normal forms, previews, hashes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: tokens of a query are capped at this many
QUERY_TERMS = 200
#: fixed values: runs of Chinese characters up to this length are a token as a whole
WHOLE_RUN = 12
PREVIEW = 420
_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f]"


def py_strip(x: Column, chars: str = _WS) -> Column:
    """Trim by a character class; the built-in trim takes blanks only."""
    return F.regexp_replace(x, rf"\A{chars}+|{chars}+\z", "")


def normalize_index_text(x: Column) -> Column:
    """Byte-order marks gone, line ends unified, full-width colons plain, blank runs single, trimmed, lower case."""
    t = F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("﻿"), F.lit("")), "\r\n?", "\n")
    return F.lower(py_strip(F.regexp_replace(F.translate(t, "：", ":"), "[ \t　]+", " ")))


def normalize_text(x: Column) -> Column:
    """As for the index but with three or more line ends made two, and the case kept."""
    t = F.regexp_replace(F.replace(x, F.lit("﻿"), F.lit("")), "\r\n?", "\n")
    t = F.regexp_replace(F.translate(t, "：", ":"), "[ \t　]+", " ")
    return py_strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def clean_value(x: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(py_strip(x), r"\n\s*", "\n"), "[ \t]+", " ")
    return py_strip(t, "[ \t\n:：,，;；]")


def clean_string(x: Column) -> Column:
    """Trimmed text, empty for null."""
    return F.coalesce(py_strip(x.cast("string")), F.lit(""))


def first_non_empty(*xs: Column) -> Column:
    return F.coalesce(*(F.nullif(clean_string(x), F.lit("")) for x in xs))


def join_text(*xs: Column) -> Column:
    """The non-empty values, a line each."""
    return F.array_join(F.filter(F.array(*map(clean_string, xs)), lambda v: v != ""), "\n")


def _grams(run: Column, n: int) -> Column:
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - (n - 1), F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def tokens(x: Column) -> Column:
    """Tokens of a text, repeats included: ASCII runs first, then of every CJK run the run itself (one character, or
    up to twelve), its 2-grams and its 3-grams. Null and empty texts have none."""
    t = normalize_index_text(x)
    ascii_ = F.filter(F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z0-9][A-Za-z0-9_.-]*"), F.lit(0)), lambda w: F.regexp_replace(w, r"\A[._-]+|[._-]+\z", "")), lambda w: w != "")
    runs = F.regexp_extract_all(t, F.lit("[一-鿿]+"), F.lit(0))
    none = F.array().cast("array<string>")
    of_run = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.concat(F.when(F.length(r) <= WHOLE_RUN, F.array(r)).otherwise(none), _grams(r, 2), _grams(r, 3)))
    return F.concat(ascii_, F.flatten(F.transform(runs, of_run)))


def unique_terms(terms: Column) -> Column:
    """Query terms: trimmed, lower case, first occurrences in order, at most QUERY_TERMS."""
    kept = F.filter(F.transform(terms, lambda w: F.lower(py_strip(w))), lambda w: w != "")
    return F.slice(F.array_distinct(kept), 1, QUERY_TERMS)


def preview(x: Column) -> Column:
    """White space made single blanks; over the limit, three dots end it."""
    t = py_strip(F.regexp_replace(F.coalesce(x, F.lit("")), f"{_WS}+", " "))
    return F.when(F.length(t) <= PREVIEW, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, PREVIEW - 3), rf"{_WS}+\z", ""), F.lit("...")))


def short_hash(x: Column) -> Column:
    return F.substring(F.sha1(x), 1, 12)


def normalize_eval_text(x: Column) -> Column:
    """Lower case without any white space; null counts as empty."""
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), f"{_WS}+", ""))


def normalize_work_order_id(x: Column) -> Column:
    """The bare id of a path or link: without query, folders, prefix and extension; empty for null."""
    t = F.regexp_replace(py_strip(F.coalesce(x, F.lit(""))), r"(?s)[?#].*\z", "")
    t = py_strip(F.regexp_replace(F.regexp_replace(t, r"[/\\]+\z", ""), r"(?s)\A.*[/\\]", ""))
    return py_strip(F.regexp_replace(F.regexp_replace(t, r"\.[^.]+\z", ""), r"(?i)\Awo:", ""))


def split_cell(x: Column) -> Column:
    """Values of a comma-separated cell, either comma, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "[，,]"), lambda v: py_strip(v)), lambda v: v != "")


#: fixed value: a fault code in running text; letters of any script next to it rule it out
FAULT_CODE = r"(?<![\p{L}\p{N}_])[A-Za-z]\d{3,}[A-Za-z0-9_-]*(?![\p{L}\p{N}_])"


def fault_codes(x: Column) -> Column:
    """Fault codes named in a query, upper case, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(FAULT_CODE), F.lit(0)), F.upper))


_STEM = r"(?s)\A([A-Za-z][0-9]{3,}[A-Za-z0-9_-]*)\s*(.*)\z"


def fault_code_of_stem(stem: Column) -> Column:
    """The fault code a file name begins with, upper case; null without one."""
    return F.nullif(F.upper(F.regexp_extract(py_strip(stem), _STEM, 1)), F.lit(""))


def fault_description_of_stem(stem: Column) -> Column:
    return F.when(fault_code_of_stem(stem).isNotNull(), py_strip(F.regexp_extract(py_strip(stem), _STEM, 2)))


def fault_title_of_stem(stem: Column) -> Column:
    """The name without its marker; of a name with a code and no marker the description, where there is one."""
    bare = py_strip(stem)
    title = py_strip(F.regexp_replace(bare, r"\A故障现象\s*[:：]\s*", ""))
    about = F.nullif(fault_description_of_stem(stem), F.lit(""))
    return F.when(title == bare, F.coalesce(about, title)).otherwise(title)


def table_count(html: Column) -> Column:
    return F.regexp_count(F.coalesce(html, F.lit("")), F.lit(r"(?i)<\s*table\b"))


def redact_database_url(x: Column) -> Column:
    """The password of a database address as three asterisks."""
    return F.regexp_replace(x, r"(//[^:/@\s]+:)[^@\s]+@", "$1***@")


def redact_query_secrets(x: Column) -> Column:
    return F.regexp_replace(x, r"(?i)([?&](?:key|api_?key|token|access_token|secret|signature|sig|password)=)[^&#\s]+", "$1***")


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared share of the padded word trigrams of two texts; 0 where neither has one."""

    def grams(x: Column) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        pad = lambda w: F.concat(F.lit("  "), w, F.lit(" "))
        return F.array_distinct(F.flatten(F.transform(words, lambda w: _grams(pad(w), 3))))

    union = F.size(F.array_union(grams(a), grams(b)))
    return F.when(union > 0, F.size(F.array_intersect(grams(a), grams(b))) / union).otherwise(F.lit(0.0))


def strip_json_fence(x: Column) -> Column:
    """The object of a model's reply as JSON text: one fence taken off, else from the first to the last brace; null if there is none."""
    bare = py_strip(F.regexp_replace(py_strip(x), r"(?s)\A```[A-Za-z]*\s*|\s*```\z", ""))
    return F.when(bare.rlike(r"(?s)\A\{.*\}\z"), bare).otherwise(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")))


def clip(x: Column, limit: int) -> Column:
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, limit), F.lit("...")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
