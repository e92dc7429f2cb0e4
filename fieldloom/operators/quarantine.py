"""Loading delimited lines: valid rows typed, bad rows apart with their reasons.

Every field stays nullable text until vectorised cast and constraint rules have filled
an error array; a row is good if and only if that array is empty. All of it is one
projection of built-in expressions: no shuffle, no Python, one pass over the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import table

#: fixed values: the columns of an exported parse report, in order
FIELDS = ("input_path", "status", "error", "work_order_id", "part_count", "parse_warnings", "encoding", "finished_at")
#: fixed values: what status and parse_warnings may hold
STATUSES = ("parsed", "failed")
WARNINGS = ("missing_reported_issue", "missing_solution", "parts_section_without_structured_parts", "missing_work_order_id")

# Possessive throughout: java.util.regex walks these in a loop, so a very long field can't overflow the stack.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_FIELD = rf'(?:{_QUOTED}|[^",]*+)'
_WELL_FORMED = rf'\A{_FIELD}(?:,{_FIELD})*+\z'
#: one match for each field of a line that got a comma in front
_EACH = rf',({_FIELD})'


def _unquote(x: Column) -> Column:
    return F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)


def split_line(line: Column) -> Column:
    """The fields of one line as text; null where quoting is broken. An empty line is one empty field."""
    return F.when(line.rlike(_WELL_FORMED), F.transform(F.regexp_extract_all(F.concat(F.lit(','), line), F.lit(_EACH), F.lit(1)), _unquote))


def _timestamp(x: Column) -> Column:
    """`YYYY-MM-DD hh:mm:ss` as a timestamp without zone; null unless that time exists."""
    well = x.rlike(r'\A[0-9]{4}-[0-9]{2}-[0-9]{2} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z')
    return F.when(well, x).try_cast("timestamp_ntz")


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add `errors` (array of reasons, empty for a good row) and the typed fields.

    Reasons: quoting, column_count, invalid_value (with every failing column named in
    `error_columns`). A null line counts as a line that has no columns: column_count. Fields are
    null in a bad row unless they could be read. part_count holds 38 digits; a longer count, which is as valid, is null there
    and whole in part_count_text, which has the digits of every count. Columns of the input are kept; should the input
    have a column of a field's name, the field wins and the input's is renamed `<name>_in`.
    """
    for f in (*FIELDS, "part_count_text", "errors", "error_columns"):
        if f in lines.columns and f != line:
            lines = lines.withColumnRenamed(f, f"{f}_in")
    raw = lines.withColumn("__fields", split_line(F.col(line)))
    text = raw.select("*", *(F.get("__fields", F.lit(i)).alias(f"__text{i}") for i in range(len(FIELDS))))
    t = {name: F.col(f"__text{i}") for i, name in enumerate(FIELDS)}
    warned = F.when(t["parse_warnings"] == "", F.array().cast("array<string>")).otherwise(F.split(t["parse_warnings"], r"\|", -1))
    typed = text.select(
        "*",
        F.when(t["part_count"].rlike(r"\A[0-9]+\z"), t["part_count"]).alias("__count"),
        _timestamp(t["finished_at"]).alias("__at"),
        warned.alias("__warned"),
    )
    rules = {
        "status": ~t["status"].isin(*STATUSES),
        "part_count": F.col("__count").isNull(),
        "parse_warnings": F.exists("__warned", lambda w: ~w.isin(*WARNINGS)),
        "finished_at": F.col("__at").isNull(),
    }
    bad = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    whole = F.size("__fields") == len(FIELDS)
    errors = (
        F.when(F.col(line).isNull(), F.array(F.lit("column_count")))
        .when(F.col("__fields").isNull(), F.array(F.lit("quoting")))
        .when(~whole, F.array(F.lit("column_count")))
        .when(F.size(bad) > 0, F.array(F.lit("invalid_value")))
        .otherwise(F.array().cast("array<string>"))
    )
    blank = lambda c: F.when(c != "", c)
    values = {
        "input_path": t["input_path"], "status": t["status"], "error": blank(t["error"]), "work_order_id": blank(t["work_order_id"]),
        "part_count": F.col("__count").try_cast("decimal(38,0)"), "parse_warnings": F.col("__warned"), "encoding": blank(t["encoding"]), "finished_at": F.col("__at"),
        "part_count_text": F.col("__count"),
    }
    read = F.col("__fields").isNotNull() & whole
    return typed.select(*lines.columns, errors.alias("errors"), F.when(read, bad).alias("error_columns"), *(F.when(read, v).alias(n) for n, v in values.items()))


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("errors") == 0).drop("errors", "error_columns")


def bad_rows(parsed: DataFrame, *keep: str) -> DataFrame:
    """Quarantined rows: the kept columns and the first reason that applies."""
    return parsed.where(F.size("errors") > 0).select(*keep, F.col("errors")[0].alias("reason"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_rows(parse_lines(table(spark, sf_dir, "parse_log")), "raw_id")


def p2_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good records, typed; warnings joined to text so that the rows compare plainly. A count beyond 64 bits is whole in part_count_text."""
    ok = good_rows(parse_lines(table(spark, sf_dir, "parse_log")))
    return ok.select("raw_id", "input_path", "status", "error", "work_order_id", F.col("part_count").try_cast("bigint").alias("part_count"), "part_count_text", F.array_join("parse_warnings", "|").alias("parse_warnings"), "encoding", "finished_at")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by log file: how many, how many bad, by reason."""
    p = parse_lines(table(spark, sf_dir, "parse_log")).select("log_file", F.coalesce(F.get("errors", F.lit(0)), F.lit("")).alias("reason"))
    return p.groupBy("log_file").agg(F.count("*").alias("lines"), *(F.count_if(F.col("reason") == r).alias(r) for r in ("quoting", "column_count", "invalid_value")))
