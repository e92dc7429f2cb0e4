"""Manuals: metadata from paths, text in bounded chunks, chunks as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import text as T

#: fixed values: directory names of the two kinds of manual
TYPICAL, CODES = "典型故障解析", "机器故障代码解析"
CHUNK, LEAST_CHUNK = 1800, 200


def path_metadata(path: Column) -> list[Column]:
    """Columns machine_type, manual_section, system_dir, file_name, fault_title, fault_code, fault_description, doc_type of a path relative to the root."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    name = F.get(parts, n - 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")
    at = F.array_position(F.transform(parts, lambda p: p.contains(TYPICAL)), F.lit(True))
    section = F.get(F.filter(parts, lambda p: p.contains(TYPICAL) | p.contains(CODES)), F.lit(0))
    code = T.fault_code_of_stem(stem)
    return [
        F.when(n >= 2, parts[0]).alias("machine_type"), section.alias("manual_section"), F.when((at > 0) & (at < n - 1), F.get(parts, at.cast("int"))).alias("system_dir"), name.alias("file_name"),
        T.fault_title_of_stem(stem).alias("fault_title"), code.alias("fault_code"), T.fault_description_of_stem(stem).alias("fault_description"),
        F.when(code.isNotNull() | (F.coalesce(section, F.lit("")) == CODES), "manual_fault_code").otherwise("manual_typical_fault").alias("doc_type"),
    ]


def clean_markdown(x: Column) -> Column:
    return T.py_strip(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "\r\n?", "\n"), "\n{4,}", "\n\n\n"))


def blocks(x: Column) -> Column:
    """Paragraphs and headed sections: a blank line ends a block, a heading begins one."""
    cut = F.regexp_replace(x, r"\n(?=[ \t]{0,3}#{1,6}[ \t])", "\n\n")
    return F.filter(F.transform(F.split(cut, r"\n[ \t]*(?:\n[ \t]*)+"), lambda b: T.py_strip(b)), lambda b: b != "")


def chunks(x: Column, most: int = CHUNK) -> Column:
    """Chunks of at most `most` characters (200 at least): whole blocks joined by a blank line; a longer block is cut hard.

    A short text is one chunk, an empty one none. A fold over the blocks with the finished chunks and the open one as state.
    """
    most = max(most, LEAST_CHUNK)
    whole = clean_markdown(x)
    none = F.array().cast("array<string>")
    piece = lambda b: F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.length(b) - 1) / most).cast("int")), lambda i: T.py_strip(F.substring(b, i * most + 1, F.lit(most)))), lambda p: p != "")
    state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))
    close = lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
    step = lambda s, b: (
        F.when(F.length(b) > most, state(F.concat(close(s), piece(b)), F.lit("")))
        .when(s["open"] == "", state(s["done"], b))
        .when(F.length(s["open"]) + 2 + F.length(b) > most, state(close(s), b))
        .otherwise(state(s["done"], F.concat(s["open"], F.lit("\n\n"), b)))
    )
    packed = F.aggregate(blocks(whole), state(none, F.lit("")), step, close)
    return F.when(whole == "", none).when(F.length(whole) <= most, F.array(whole)).otherwise(packed)


def manual_documents(pages: DataFrame, path: str, markdown: str, most: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """A document for each chunk of each page; pages without text have none."""
    meta = pages.select(*keep, F.col(path).alias("relative_path"), *path_metadata(F.col(path)), chunks(F.col(markdown), most).alias("_c"))
    c = meta.select("*", F.posexplode("_c").alias("chunk_index", "chunk_text")).withColumn("chunk_count", F.size("_c"))
    path_text = F.replace(F.col("relative_path"), F.lit("/"), F.lit(" "))
    named = [("fault_title", F.col("fault_title")), ("fault_code", F.col("fault_code")), ("fault_description", F.col("fault_description")), ("file_name", F.col("file_name")), ("path_text", path_text), ("chunk_text", F.col("chunk_text"))]
    facts = [(k, F.col(k).cast("string")) for k in ("machine_type", "manual_section", "system_dir", "chunk_index", "chunk_count")]
    as_map = lambda pairs: F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(T.clean_string(v) for _, v in pairs)))
    return c.select(
        *keep, F.concat_ws(":", F.lit("manual"), T.short_hash(F.col("relative_path")), F.col("chunk_index").cast("string")).alias("doc_id"), "doc_type", F.col("fault_title").alias("title"),
        T.join_text(*(v for _, v in named)).alias("text"), as_map(named).alias("fields"), as_map(facts).alias("metadata"), F.col("relative_path").alias("source_path"),
    )
