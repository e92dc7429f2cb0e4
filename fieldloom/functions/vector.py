"""Vectors as arrays; arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; null where a vector is null, empty, of another length or zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), 1 - dot(a, b) / n)


def is_valid(v: Column) -> Column:
    """A non-empty vector of finite numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def literal(v: Column) -> Column:
    """A vector as text, `[1,0.5]`, its numbers as 64-bit floats in at most twelve significant digits; null where it isn't a valid one."""

    def number(x: Column) -> Column:
        d = x.cast("double")
        exponent = F.when(d == 0, 0).otherwise(F.floor(F.log10(F.abs(d))))
        tidy = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+\z", "$1"), r"\.\z", "")
        plain = tidy(F.format_string("%.11f", d))
        return F.when(d == F.floor(d), F.when(F.abs(d) < 1e12, d.cast("bigint").cast("string"))).otherwise(F.when(exponent == 0, plain))

    shown = F.transform(v, lambda x: F.coalesce(number(x), _significant(x.cast("double"))))
    return F.when(is_valid(v), F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]")))


def _significant(d: Column) -> Column:
    """A number in scientific form with twelve significant digits, without trailing zeros."""
    t = F.format_string("%.11e", d)
    return F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+e", "$1e"), r"\.e", "e")
