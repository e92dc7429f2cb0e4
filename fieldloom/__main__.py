"""python -m fieldloom COMMAND: convert pages, parse orders, ingest, search. Runs in the session that spark-submit or the environment gives."""

from __future__ import annotations

import argparse
import json
import sys

from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fieldloom import config
from fieldloom.functions import text as T
from fieldloom.operators import embed, html, index, models, retrieval, workorder
from fieldloom.operators.evidence import Paused, Pipeline
from fieldloom.operators.ingest import ingest
from fieldloom.operators.store import Store
from fieldloom.session import materialize, ship
from fieldloom.sources import files


def convert(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Pages to Markdown as rows of (relative_path, markdown); existing ones are kept unless overwritten. A page that can't be read is counted as failed."""
    found = files.scan(spark, "html", a.input, limit=a.limit).select("path", "content")
    pages = files.with_text(found).withColumn("relative_path", files.relative_path(F.col("path"), a.input))
    try:
        done = None if a.overwrite else spark.read.parquet(a.output)
    except Exception:  # noqa: BLE001  nothing there yet
        done = None
    todo = materialize(pages if done is None else files.skip_existing(pages, done))
    out = todo.where("text is not null").select("relative_path", "encoding", "lossy", html.markdown(F.col("text")).alias("markdown"), F.lit("converted").alias("status"), T.table_count(F.col("text")).alias("tables"))
    out.write.mode("overwrite" if a.overwrite else "append").parquet(a.output)
    n, bad = todo.count(), todo.where("text is null").count()
    report = {"pages": spark.read.parquet(a.output).count(), "found": found.select("path").count(), "converted": n - bad, "failed": bad}
    report |= {"skipped": report["found"] - n, "tables": int(todo.agg(F.coalesce(F.sum(T.table_count(F.col("text"))), F.lit(0))).head()[0])}
    files.write_json(spark, f"{a.output.rstrip('/')}.report.json", report)
    return report


def parse(spark: SparkSession, a: argparse.Namespace) -> dict:
    found = files.with_text(files.scan(spark, "work_order", a.input, limit=a.limit).select("path", "content"))
    parsed = materialize(workorder.parse_orders(found, "text", "path", "encoding").withColumnRenamed("path", "source_path"))
    good = parsed.where("status = 'parsed'")
    files.write_json_lines(good.drop("status", "error"), f"{a.output}/work_orders")
    files.write_csv(files.part_table(good), f"{a.output}/parts_csv")
    files.write_json_lines(workorder.file_results(parsed), f"{a.output}/results")
    report = workorder.batch_report(parsed).collect()[0].asDict()
    files.write_json(spark, f"{a.output}/report.json", report)
    return report


def _provider(a: argparse.Namespace):  # noqa: ANN202
    if a.provider_command:
        return models.command_provider(a.provider_command), ("command", a.model)
    return (embed.hash_provider(), ("hash", a.model)) if a.hash_vectors else (None, ("", ""))


def load(spark: SparkSession, a: argparse.Namespace) -> dict:
    provider, model = _provider(a)
    return ingest(Store(spark, a.store), a.kind, files.scan(spark, a.kind, a.input, limit=a.limit), resume=not a.no_resume, root=a.input, provider=provider, model=model)


def export_index(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A store's index as JSON: the inverted index in lines, and a manifest."""
    store = Store(spark, a.store)
    files.write_inverted_index(index.inverted_index(store.read("postings")), f"{a.output}/inverted_index")
    counts = {r.table: r.rows for r in store.counts().collect()}
    manifest = files.index_manifest(datetime.now(UTC).isoformat(timespec="seconds"), {"store": a.store}, {"inverted_index": f"{a.output}/inverted_index"}, counts)
    files.write_json(spark, f"{a.output}/manifest.json", manifest)
    return manifest


def search(spark: SparkSession, a: argparse.Namespace) -> dict:
    if not a.query.strip():
        raise SystemExit("the question is empty")
    store, events, held = Store(spark, a.store), [], {}
    provider, (name, model) = _provider(a)
    settings = config.load({"embeddings": provider is not None, "provider": name, "model": model} if provider else None)
    docs = store.read("documents")
    parts = store.read("work_orders").select("work_order_id", "reported_issue", "source_path", F.posexplode("parts").alias("part_ord", "p")).select("work_order_id", "reported_issue", "source_path", "part_ord", "p.*")
    q = spark.createDataFrame([(1, a.query)], "query_id long, query string")
    vectors = (lambda: spark.createDataFrame([(1, [float(x) for x in provider([a.query])[0]])], "query_id long, vector array<double>")) if provider else None
    stored = lambda terms: retrieval.stored_index(store.read("postings"), store.read("statistics"), terms)
    found = retrieval.retrieve(docs, parts, q, settings, a.top_k, store.read("embeddings").where("error is null"), vectors, index_of=stored, events=events, candidates=held)
    rows = lambda n: [r.asDict() for r in retrieval.hit_rows(found[n], docs).orderBy("rank").collect()]  # noqa: E731  bounded by the channel's cut
    cuts = [e.asDict() for c in ("work_orders", "manual_typical_faults") for e in retrieval.threshold_events(held[c], found[c], c, settings, a.top_k).collect()]
    package = {
        "query": a.query, "mode": settings.resolve("auto"), "channel_modes": {c: settings.mode_for(c) for c in retrieval.CHANNELS}, "work_orders": rows("work_orders"), "manuals": rows("manual_typical_faults"), "fault_codes": rows("manual_fault_codes"),
        "parts": [r.asDict() for r in found["part_evidence"].orderBy("order_rank", "source_path", "part_ord").collect()], "warnings": [f"{e['channel']}:{e['stage']}:{e['reason']}" for e in events if e["status"] == "fallback"],
    }
    if a.debug:
        package["debug"] = {"retrieval_events": events + cuts, "embedding_enabled": settings.embeddings}
    if a.command == "search":
        return package
    try:
        return {"answer": Pipeline(deterministic_answer=True).run(a.query, package)["answer"]}
    except Paused as e:
        return {"paused": e.reason}


def _vectors(c: argparse.ArgumentParser) -> None:
    c.add_argument("--provider-command", help="a program that turns texts into vectors; with it, search is hybrid")
    c.add_argument("--hash-vectors", action="store_true", help="vectors without a model, for offline use")
    c.add_argument("--model", default="hash-64")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="fieldloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, run in (("html-to-md", convert), ("parse-workorders", parse), ("ingest", load)):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("input")
        c.add_argument("--limit", type=int)
        if name == "ingest":
            c.add_argument("store")
            c.add_argument("--kind", choices=("work_order", "manual"), default="work_order")
            c.add_argument("--no-resume", action="store_true")
            _vectors(c)
        else:
            c.add_argument("output")
            c.add_argument("--overwrite", action="store_true")
    for name in ("search", "ask"):
        c = sub.add_parser(name)
        c.set_defaults(run=search)
        c.add_argument("store")
        c.add_argument("query")
        c.add_argument("--top-k", type=int, default=8)
        c.add_argument("--debug", action="store_true")
        _vectors(c)
    c = sub.add_parser("export-index")
    c.set_defaults(run=export_index)
    c.add_argument("store")
    c.add_argument("output")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("fieldloom").getOrCreate()
    ship(spark)
    json.dump(a.run(spark, a), sys.stdout, ensure_ascii=False, default=str)
    print()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
