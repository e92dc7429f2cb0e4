"""From searchable documents to fields, postings and statistics; incremental maintenance of them.

A document is (doc_id, doc_type, title, text, fields map, metadata map, source_path). doc_id orders documents
and breaks ties. doc_type travels with each posting, so scoring needs no join with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.config import FIELD_WEIGHTS
from fieldloom.functions import text as T
from fieldloom.session import materialize


def field_weight(name: Column) -> Column:
    m = F.create_map(*(F.lit(v) for kv in FIELD_WEIGHTS.items() for v in kv))
    return F.coalesce(m[name], F.lit(1.0))


def document_fields(docs: DataFrame, *keep: str) -> DataFrame:
    """(*keep, doc_id, doc_type, field, tokens, field_weight, field_length): a row for each field, empty ones too, since they count in the averages."""
    rows = docs.select(*keep, "doc_id", "doc_type", F.explode("fields").alias("field", "field_text"))
    return rows.select(*keep, "doc_id", "doc_type", "field", T.tokens(F.col("field_text")).alias("tokens")).select("*", field_weight(F.col("field")).alias("field_weight"), F.size("tokens").alias("field_length"))


def postings(fields: DataFrame, *keep: str) -> DataFrame:
    """(term, doc_id, doc_type, field, tf, field_weight, field_length, *keep). Tokens are combined in each task before they are shuffled."""
    one = fields.select(*keep, "doc_id", "doc_type", "field", "field_weight", "field_length", F.explode("tokens").alias("term"))
    return one.groupBy("term", "doc_id", "doc_type", "field", "field_weight", "field_length", *keep).agg(F.count("*").alias("tf"))


def average_lengths(fields: DataFrame) -> DataFrame:
    """(field, avg_len) over the documents of every type; an empty field counts as one token long."""
    return fields.groupBy("field").agg(F.greatest(F.avg(F.greatest(F.col("field_length"), F.lit(1))), F.lit(1.0)).alias("avg_len"))


def document_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_type").agg(F.greatest(F.count("*"), F.lit(1)).alias("doc_count"))


def statistics(docs: DataFrame, fields: DataFrame, *keep: str) -> DataFrame:
    """(kind, name, rows, total, *keep): for each field how many documents have it and its lengths' sum, empty ones counting as 1; for each type its documents. Sums, so those of batches add up."""
    lengths = fields.groupBy(F.col("field").alias("name"), *keep).agg(F.count("*").alias("rows"), F.sum(F.greatest(F.col("field_length"), F.lit(1)).cast("bigint")).alias("total"))
    kinds = docs.groupBy(F.col("doc_type").alias("name"), *keep).agg(F.count("*").alias("rows"), F.lit(0).cast("bigint").alias("total"))
    return lengths.select(F.lit("field").alias("kind"), "name", "rows", "total", *keep).unionByName(kinds.select(F.lit("doc_type").alias("kind"), "name", "rows", "total", *keep))


def document_frequencies(posts: DataFrame) -> DataFrame:
    """(doc_type, term, df): documents that hold the term in any field. Exact."""
    return posts.groupBy("doc_type", "term", "doc_id").agg(F.lit(1).alias("x")).groupBy("doc_type", "term").agg(F.count("*").alias("df"))


def inverted_index(posts: DataFrame, block: int = 10_000) -> DataFrame:
    """(term, df, block, postings): the sorted postings of a term in hash blocks of about `block` documents, so that no term is one row, or one task, however common it is."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    cut = posts.join(df, "term").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("df") / block)))
    return cut.groupBy("term", "df", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "field", "tf"))).alias("postings"))


def number_documents(docs: DataFrame, key: str = "doc_id", name: str = "document_id") -> DataFrame:
    """Dense ids from 1 in key order without sorting everything in one task: range partitions are numbered by themselves and moved by the rows before them.

    The numbered partitions are written first. Their bounds come from a sample, and a second run of the same
    plan may draw another one.
    """
    ranged = docs.repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id())
    within = materialize(ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(key))))
    sizes = within.groupBy("_p").agg(F.max("_n").alias("_rows"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    return within.join(F.broadcast(offsets.select("_p", "_before")), "_p").withColumn(name, F.col("_n") + F.col("_before")).drop("_p", "_n", "_before")


def unique_doc_ids(docs: DataFrame, order: str) -> DataFrame:
    """Second and later documents of an id get `:dupN`; metadata names the original and the number.

    An id that many documents share spans several range partitions: each numbers its own, and moves them by the rows before it.
    """
    ranged = docs.repartitionByRange(F.col("doc_id"), F.col(order)).withColumn("_p", F.spark_partition_id())
    within = materialize(ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p", "doc_id").orderBy(order))))
    rows = within.groupBy("doc_id", "_p").agg(F.max("_n").alias("_rows"))
    before = rows.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.partitionBy("doc_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_before > 0")
    numbered = within.join(before.select("doc_id", "_p", "_before"), ["doc_id", "_p"], "left").withColumn("_n", F.col("_n") + F.coalesce("_before", F.lit(0))).drop("_p", "_before")
    extra = F.map_from_arrays(F.array(F.lit("duplicate_of"), F.lit("duplicate_index")), F.array(F.col("doc_id"), F.col("_n").cast("string")))
    meta = F.when(F.col("_n") > 1, F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), extra)).otherwise(F.col("metadata"))
    return numbered.withColumn("metadata", meta).withColumn("doc_id", F.when(F.col("_n") > 1, F.concat("doc_id", F.lit(":dup"), F.col("_n").cast("string"))).otherwise(F.col("doc_id"))).drop("_n")


def _map(*pairs: tuple[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(T.clean_string(v) for _, v in pairs)))


def work_order_documents(orders: DataFrame) -> DataFrame:
    """One document for each order and one for each of its parts, numbered from 1."""
    base = F.coalesce(F.nullif(T.clean_string(F.col("work_order_id")), F.lit("")), T.short_hash(F.col("source_path")))
    o = orders.withColumn("_id", base)
    order = o.select(
        F.concat(F.lit("wo:"), "_id").alias("doc_id"), F.lit("work_order").alias("doc_type"), T.first_non_empty(F.col("reported_issue"), F.col("work_order_id"), F.col("source_path")).alias("title"),
        T.join_text(F.col("reported_issue"), F.col("solution"), F.col("remarks"), F.col("raw_text")).alias("text"),
        _map(*((c, F.col(c)) for c in ("reported_issue", "solution", "remarks", "raw_text"))).alias("fields"),
        _map(("work_order_id", F.col("work_order_id")), ("part_count", F.size(F.coalesce("parts", F.array())).cast("string"))).alias("metadata"), "source_path",
    )
    p = o.select("_id", "work_order_id", "reported_issue", "solution", "source_path", F.posexplode("parts").alias("pos", "p"))
    keys = ("part_number_name", "part_number", "part_name", "part_code", "quantity", "raw_text")
    part = p.select(
        F.concat_ws(":", F.lit("part"), "_id", (F.col("pos") + 1).cast("string")).alias("doc_id"), F.lit("part_evidence").alias("doc_type"),
        T.first_non_empty(F.col("p.part_name"), F.col("p.part_number_name"), F.col("p.part_code"), F.col("p.raw_text"), F.col("work_order_id")).alias("title"),
        T.join_text(*(F.col(f"p.{k}") for k in keys), F.col("reported_issue"), F.col("solution")).alias("text"),
        _map(*((k, F.col(f"p.{k}")) for k in keys), ("reported_issue", F.col("reported_issue")), ("solution", F.col("solution"))).alias("fields"),
        _map(("work_order_id", F.col("work_order_id")), ("part_index", (F.col("pos") + 1).cast("string"))).alias("metadata"), "source_path",
    )
    return order.unionByName(part)


def part_rows(orders: DataFrame, *keep: str) -> DataFrame:
    """A row for each part, part_ord counting from 1."""
    return orders.select(*keep, F.posexplode("parts").alias("_pos", "_p")).select(*keep, (F.col("_pos") + 1).alias("part_ord"), "_p.*")


# --- incremental maintenance -------------------------------------------------------------------


def pending_sources(found: DataFrame, manifest: DataFrame, keys: tuple[str, ...] = ("source_kind", "source_path")) -> DataFrame:
    """Sources that still have to be read: all but those completed with the same content."""
    done = manifest.where(F.col("status") == "completed").select(*keys, "content_hash")
    return found.join(done, [*keys, "content_hash"], "left_anti")


def upsert_by_source(old: DataFrame, new: DataFrame, key: str = "source_path", touched: DataFrame | None = None) -> DataFrame:
    """old without any row of the touched sources, and new. touched defaults to new's sources; a source that became empty is touched but has no new rows."""
    gone = (new if touched is None else touched).select(key).distinct()
    return old.join(gone, key, "left_anti").unionByName(new, allowMissingColumns=True)


def last_per_document(docs: DataFrame, order: str = "source_path") -> DataFrame:
    """Of documents that share an id the last by source; one aggregation, no sort."""
    cols = [c for c in docs.columns if c != "doc_id"]
    return docs.groupBy("doc_id").agg(F.max_by(F.struct(*cols), order).alias("x")).select("doc_id", "x.*")


def missing_embeddings(docs: DataFrame, embeddings: DataFrame, provider: str, model: str) -> DataFrame:
    have = embeddings.where((F.col("provider") == provider) & (F.col("model") == model)).select("doc_id")
    return docs.join(have, "doc_id", "left_anti")


def merge_manifest(manifest: DataFrame, events: DataFrame, keys: tuple[str, ...] = ("source_kind", "source_path")) -> DataFrame:
    """The latest state of each source: running, completed or failed, by time."""
    all_ = manifest.unionByName(events, allowMissingColumns=True)
    rest = [c for c in all_.columns if c not in keys]
    return all_.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("updated_at", "status")).alias("x")).select(*keys, "x.*")
