"""Command line: one function for each job; each builds frames and writes them."""

from __future__ import annotations

import argparse
from contextlib import nullcontext
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, collect, publish, rows, site
from ..sources import pages as parse
from ..sources import pdf, tables
from . import daily
from . import site as static
from .lock import HELD, RunIsActive, run_lock

def build_public(spark: SparkSession, a) -> None:
    document, _ = daily.published(spark, a.input, a.now, fail_fast=True)
    Path(a.output).write_text(document.first()["json"] + "\n", encoding="utf-8")

def export_public_from_sheet(spark: SparkSession, a) -> None:
    sheet = publish.publishable(tables.sheet_rows(spark, a.input))
    wide = sheet.withColumns({c: F.to_json(c) if c in publish.TYPED and publish.TYPED[c].startswith("array") else F.col(c).cast("string") for c in publish.PUBLIC if c in sheet.columns})
    document = publish.document(publish.public_events(publish.checked(wide, fail_fast=True).filter("error is null")), a.now)
    Path(a.output).write_text(document.first()["json"] + "\n", encoding="utf-8")

def archive_sheet(spark: SparkSession, a) -> None:
    site.archived(tables.sheet_rows(spark, a.input), a.now).write.mode("overwrite").parquet(a.output)

def upsert_sheet_events(spark: SparkSession, a) -> None:
    raw = spark.read.text(a.events, wholetext=True).select(F.parse_json("value").alias("v"))
    listed = raw.select(F.posexplode(F.coalesce(F.try_variant_get("v", "$.events", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))).alias("pos", "e"))
    cells = listed.select("pos", F.from_json(F.to_json("e"), "map<string,string>").alias("cells")).select(F.col("cells")["event_id"].alias("event_id"), "pos", F.map_filter("cells", lambda k, v: k != "event_id").alias("cells"))
    current = tables.sheet_rows(spark, a.input)
    flat = current.select(*[(F.array_join(c, "\n") if c in tables.MULTI else F.col(c).cast("string")).alias(c) for c in current.columns])
    unknown = [r["column"] for r in rows.unknown_columns(flat, cells).collect()]  # names of columns, a few at most
    if unknown:
        raise SystemExit(f"unknown columns: {', '.join(sorted(unknown))}")
    merged, counts = daily.merged_state(flat, cells)
    merged.drop("action").write.mode("overwrite").parquet(a.output)
    print(counts.first().asDict())

def build_site(spark: SparkSession, a) -> None:
    body = tables.published_events(spark, a.input)
    fields = [c for c in publish.PUBLIC if c not in publish.TYPED]
    get = lambda c, kind: F.try_variant_get("event", f"$.{c}", kind)
    events = body.select("generated_at", *[get(c, "string").alias(c) for c in ("event_id", "review_label", *fields)], *[get(c, "array<string>").alias(c) for c in ("genres", "detailed_tags", "pdf_search_hashes")])
    print(static.write(static.pages(events.drop("generated_at"), a.now), a.output))

def extract_pdf(spark: SparkSession, a) -> None:
    read = pdf.pages(pdf.files(spark, a.input))
    good = chunks.page_quality(read.filter("error is null"))
    chunks.document_quality(good).write.mode("overwrite").json(f"{a.output}/documents")
    chunks.chunks(good).write.mode("overwrite").json(f"{a.output}/chunks")

def collect_pages(spark: SparkSession, a) -> None:
    """Pages already fetched (key, url, body, content_type, encoding, adapter) to candidates; fetching itself is the data source ``fetches``."""
    fetched = spark.read.parquet(a.input).withColumn("html", parse.decoded(F.col("body"), F.col("content_type"), F.col("encoding")))
    documents = fetched.withColumn("body", F.col("html"))
    found = collect.enrich(collect.site_candidates(documents, collect.sites(spark)), documents)
    found.write.mode("append").json(a.output)

def plan_sheet(spark: SparkSession, a) -> None:
    tables.settings(spark).groupBy("list").count().show(100, truncate=False)

def init_sheet(spark: SparkSession, a) -> None:
    ddl = ", ".join(f"{c} string" for c in tables.EVENT_COLUMNS)
    print(tables.provision(spark, a.output, {"events": ddl, "settings": "list string, code string, sort_order int"}, {"settings": tables.settings(spark)}))

def export_sheet_template(spark: SparkSession, a) -> None:
    import json

    seeds = [r.asDict() for r in tables.settings(spark).collect()]
    Path(a.output).write_text(json.dumps({"events": tables.EVENT_COLUMNS, "settings": seeds}, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")

def daily_run(spark: SparkSession, a) -> None:
    """Status and totals of a run from its logs (sources: source_id, status, warnings, fatal, pos; candidates: source_id)."""
    with run_lock(a.lock) if a.lock else nullcontext():
        summary = daily.daily_summary(spark.read.json(a.input, schema="source_id string, status string, warnings array<string>, fatal string, pos int"), spark.read.json(a.events), "daily_" + a.now.replace("-", "").replace(":", "")[:15], a.now)
        summary.write.mode("overwrite").json(a.output)
        print(daily.summary_markdown(summary).first()["markdown"])

JOBS = {
    "plan-sheet": plan_sheet, "init-sheet": init_sheet, "build-public": build_public, "export-sheet-template": export_sheet_template, "collect-source": collect_pages, "extract-pdf": extract_pdf, "build-site": build_site, "daily-run": daily_run,
    "export-public-from-sheet": export_public_from_sheet, "archive-sheet": archive_sheet, "upsert-sheet-events": upsert_sheet_events,
}

def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="convena", description=__doc__)
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("--input", default="", help="what is read")
    parser.add_argument("--events", default="", help="incoming rows, where a job has two inputs")
    parser.add_argument("--output", default="", help="what is written")
    parser.add_argument("--now", default="", help="ISO time with an offset that the job takes as now")
    parser.add_argument("--lock", default="", help="file that a daily run holds while it runs")
    a = parser.parse_args(args)
    try:
        JOBS[a.job](spark or SparkSession.builder.appName("convena").getOrCreate(), a)
    except RunIsActive as held:
        print(f"another run holds {held}")
        raise SystemExit(HELD) from held

if __name__ == "__main__":
    main()
