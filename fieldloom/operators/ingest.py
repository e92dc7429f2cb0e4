"""Resumable ingest: changed sources only, a commit for each group of files, sources complete when their rows are visible.

Each group of files is parsed once, written, and committed together with its documents, postings and states, so what it
costs follows from the files that changed. Runs, states (running, completed, failed) and counters are kept in the store.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import embed as embeddings
from fieldloom.operators import html, index, manuals, workorder
from fieldloom.operators.store import TABLES, Change, Store
from fieldloom.session import materialize
from fieldloom.sources import files

Progress = Callable[[str, dict], None]
#: fixed values: the counters of a run
COUNTERS = ("work_order_files", "work_orders", "part_records", "manual_files", "manual_chunks", "total_documents", "term_rows", "embeddings", "html_converted_in_memory", "skipped_files", "failed_items")
#: files that are committed together
GROUP = 10_000


class IngestPaused(RuntimeError):
    """The pause was asked for between groups; everything before it is committed."""


class _Run:
    """The record of a run and its clocks."""

    def __init__(self, store: Store, tell: Progress) -> None:
        self.store, self.tell = store, tell
        self.id, self.began = uuid.uuid4().hex, datetime.now(UTC)
        self.counts = dict.fromkeys(COUNTERS, 0)
        self.timings: dict[str, float] = {}
        self.record("running")

    def record(self, status: str, warnings: list[str] | None = None) -> None:
        done = None if status == "running" else datetime.now(UTC)
        times = {k: round(v, 3) for k, v in self.timings.items()}
        self.store.append("ingest_runs", self.store.spark.createDataFrame([(self.id, self.began, done, status, self.counts, times, warnings or [])], TABLES["ingest_runs"]))

    def timed(self, stage: str, work: Callable):  # noqa: ANN201
        at = time.monotonic()
        try:
            return work()
        finally:
            self.timings[stage] = self.timings.get(stage, 0.0) + time.monotonic() - at


def latest_runs(store: Store) -> DataFrame:
    """The current record of each run."""
    rows = store.read("ingest_runs")
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(F.col("completed_at").isNotNull(), "completed_at")).alias("x")).select("id", "x.*")


def _mark(sources: DataFrame, status: Column | str, error: Column | None = None) -> DataFrame:
    state = F.lit(status) if isinstance(status, str) else status
    return sources.select("source_kind", F.col("path").alias("source_path"), "content_hash", state.alias("status"), F.current_timestamp().alias("updated_at"), (F.lit(None).cast("string") if error is None else error).alias("error"))


def item_states(store: Store) -> DataFrame:
    """The latest state of each source."""
    rows = store.read("ingest_items")
    return index.merge_manifest(rows.limit(0), rows)


def _order_rows(todo: DataFrame) -> tuple[list[Change], DataFrame, DataFrame]:
    """Changes, documents, and failures (path, why) of a group of order files."""
    parsed = materialize(workorder.parse_orders(todo, "text", "path", "encoding").withColumnRenamed("path", "source_path"))
    ok = parsed.where("status = 'parsed'").drop("status", "error")
    bad = parsed.where("status = 'failed'").select(F.col("source_path").alias("path"), F.col("error").alias("why"))
    return [Change("work_orders", ok, todo.select(F.col("path").alias("source_path")))], index.last_per_document(index.work_order_documents(ok)), bad


def _manual_rows(todo: DataFrame, root: str, most: int) -> tuple[list[Change], DataFrame, DataFrame]:
    suffix = F.lower(F.regexp_extract("path", r"(\.[^.]*)\z", 1))
    page = F.when(suffix.isin(*files.SUFFIXES["html"]), html.markdown(F.col("text"))).otherwise(F.col("text"))
    pages = todo.where("text is not null").select(files.relative_path(F.col("path"), root).alias("relative"), "path", page.alias("markdown"))
    docs = manuals.manual_documents(pages, "relative", "markdown", most, keep=("path",)).drop("source_path").withColumnRenamed("path", "source_path")
    return [], docs, todo.where("text is null").select("path", F.lit("no text").alias("why"))


def _commit_group(store: Store, run: _Run, kind: str, todo: DataFrame, root: str, most: int) -> int:
    """Parse a group of files and commit everything it changes at once; returns how many failed."""
    run.timed("mark", lambda: store.append("ingest_items", _mark(todo, "running")))
    changes, found, bad = run.timed("parse", lambda: _order_rows(todo) if kind == "work_order" else _manual_rows(todo, root, most))
    docs = run.timed("documents", lambda: materialize(found))
    touched = todo.select(F.col("path").alias("source_path"))
    fields = index.document_fields(docs, "source_path")
    posts = run.timed("postings", lambda: materialize(index.postings(fields, "source_path")))
    if kind == "manual":
        bad = materialize(bad)
    state = todo.join(bad, "path", "left")
    why = F.col("why")
    changes += [
        Change("documents", docs, touched), Change("postings", posts, touched), Change("statistics", index.statistics(docs, fields, "source_path"), touched), Change("embeddings", gone=touched),
        Change("ingest_items", _mark(state, F.when(why.isNull(), "completed").otherwise("failed"), why)),
    ]
    run.timed("commit", lambda: store.commit(*changes))
    failed, total = bad.count(), docs.count()
    c = run.counts
    c["total_documents"] += total
    c["term_rows"] += posts.count()
    c["failed_items"] += failed
    n = todo.count()
    if kind == "work_order":
        by = {r.doc_type: r.n for r in docs.groupBy("doc_type").agg(F.count("*").alias("n")).collect()}  # two types
        c["work_order_files"] += n
        c["work_orders"] += n - failed
        c["part_records"] += by.get("part_evidence", 0)
    else:
        pattern = "|".join(x.replace(".", r"\.") for x in files.SUFFIXES["html"])
        c["manual_files"] += n
        c["manual_chunks"] += total
        c["html_converted_in_memory"] += todo.where(F.col("path").rlike(rf"(?i)({pattern})\z")).count()
    return failed


def ingest(
    store: Store, kind: str, found: DataFrame, resume: bool = True, root: str = "", most: int = manuals.CHUNK, progress: Progress | None = None, paused: Callable[[], bool] = lambda: False,
    group: int = GROUP, provider: embeddings.Provider | None = None, model: tuple[str, str] = ("hash", "hash-64"),
) -> dict:
    """Read files of a kind ('work_order' or 'manual') into the store. found: a scan with path and content.

    Sources that were completed with the same content are skipped when resuming. A bad file is recorded as failed and its old
    rows go; an empty manual loses its rows, then counts as completed. Files are committed in groups of about `group`; a pause
    is heeded between them, and the next run goes on behind them. With a provider, documents without a vector get one. Returns files,
    skipped, ingested, failed, documents, counts (COUNTERS), timings and the run's id.
    """
    tell = progress or (lambda *_: None)
    run = _Run(store, tell)
    try:
        hashed = found.select("path", "content", F.sha2("content", 256).alias("content_hash")).withColumn("source_kind", F.lit(kind))
        if resume:
            done = item_states(store).where("status = 'completed'").select("source_kind", F.col("source_path").alias("path"), "content_hash")
            hashed = hashed.join(done, ["source_kind", "path", "content_hash"], "left_anti")
        todo = run.timed("scan", lambda: materialize(files.with_text(hashed, keep_hash=True)))
        n, total = todo.count(), found.select("path").count()
        run.counts["skipped_files"] = total - n
        tell("scanned", {"files": total, "pending": n, "percent": 0.0 if n else 100.0})
        groups, failed, seen = -(-n // group), 0, 0
        for i in range(groups):
            if paused():
                raise IngestPaused(f"{seen} of {n} files are committed")
            own = todo if groups == 1 else todo.where(F.pmod(F.xxhash64("path"), F.lit(groups)) == i)
            failed += _commit_group(store, run, kind, own, root, most)
            seen = run.counts["work_order_files"] + run.counts["manual_files"]
            tell("committed", {"files": seen, "of": n, "failed": failed, "percent": round(100 * seen / n, 1)})
        if provider:
            run.counts["embeddings"] = run.timed("embeddings", lambda: fill_embeddings(store, provider, *model))
        status = "completed_with_errors" if failed else "completed"
        run.record(status)
        return {"run": run.id, "status": status, "files": total, "skipped": total - n, "ingested": n - failed, "failed": failed, "documents": run.counts["total_documents"], "counts": run.counts, "timings": {k: round(v, 3) for k, v in run.timings.items()}}
    except IngestPaused:
        run.record("paused")
        raise
    except Exception as e:
        run.record("failed", [f"{type(e).__name__}: {e}"[:500]])
        raise


def fill_embeddings(store: Store, provider: embeddings.Provider, name: str, model: str, batch: int = embeddings.BATCH) -> int:
    """Vectors for the store's documents that have none of this provider and model; failures are stored with their reason and tried again by the next run. Returns how many were added."""
    have = store.read("embeddings").where("error is null")
    docs = store.read("documents").select("doc_id", "text", "source_path")
    new = materialize(embeddings.backfill(docs, have, provider, name, model, batch).join(docs.select("doc_id", "source_path"), "doc_id"))
    n = new.where("error is null").count()
    store.append("embeddings", new)
    return n
