"""Plans that the command line and the schedule run: each returns data frames or writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import publish, resolve, rows
from ..sources import tables


def published(spark: SparkSession, path: str, generated_at: str, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the document as one row, rows with an error) from event records."""
    records = tables.event_records(spark, path)
    chosen = publish.publishable(records)
    fields = [*publish.PUBLIC, "pdf_search_terms"]
    wanted = chosen.select("event_id", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field_name"))
    resolved = resolve.resolve_fields(wanted, tables.automatic_values(chosen), tables.overrides(chosen), tables.fixed_values(chosen))
    wide = publish.checked(resolve.widen(resolved, fields).join(chosen.select("event_id", "review_label"), "event_id"), fail_fast)
    return publish.document(publish.public_events(wide.filter("error is null")), generated_at), wide.filter("error is not null").select("event_id", "error")


def daily_summary(sources: DataFrame, candidates: DataFrame, run_id: str, started_at: str) -> DataFrame:
    """One row: the run with counts by status, candidates and sources. ``sources`` has source_id, status, warnings (array), fatal (error or null) and pos."""
    per_source = candidates.groupBy("source_id").agg(F.count("*").alias("candidate_count"))
    listed = sources.join(per_source, "source_id", "left").select(
        "pos", "source_id", "status", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.size("warnings").alias("warning_count"), F.slice("warnings", 1, 20).alias("warnings"), "fatal"
    )
    item = F.struct("source_id", "status", "candidate_count", "warning_count", "warnings")
    counts = F.map_from_arrays(F.array(*[F.lit(s) for s in codes.SOURCE_STATUSES]), F.array(*[F.count_if(F.col("status") == s) for s in codes.SOURCE_STATUSES]))
    fatal = F.collect_list(F.when(F.col("fatal").isNotNull(), F.concat_ws(": ", "source_id", "fatal")))
    return listed.agg(
        F.lit(run_id).alias("run_id"), F.lit(started_at).alias("started_at"), counts.alias("status_counts"), F.sum("candidate_count").alias("candidate_count"),
        F.coalesce(F.bool_or(F.col("fatal").isNotNull() | (F.col("status") == "failed")), F.lit(False)).alias("has_failures"), F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("s")))), lambda x: x["s"]).alias("sources"), fatal.alias("fatal_errors"),
    )


def summary_markdown(summary: DataFrame) -> DataFrame:
    """The summary as Markdown: a list of counts, a table of sources and a list of errors."""
    # Labels of the counts.
    labels = [("成功", "success"), ("部分成功", "partial"), ("失敗", "failed"), ("技術的保留", "technical_hold"), ("無効", "disabled")]
    counts = [F.concat(F.lit(f"- {label}: "), F.try_element_at("status_counts", F.lit(s))) for label, s in labels]
    line = F.transform("sources", lambda s: F.concat(F.lit("| "), F.concat_ws(" | ", s["source_id"], s["status"], s["candidate_count"].cast("string"), s["warning_count"].cast("string")), F.lit(" |")))
    errors = F.when(F.size("fatal_errors") > 0, F.concat(F.array(F.lit(""), F.lit("## 実行エラー"), F.lit("")), F.transform("fatal_errors", lambda e: F.concat(F.lit("- "), e)))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit("# 日次実行"), F.lit(""), F.concat(F.lit("- 実行ID: `"), "run_id", F.lit("`")), F.concat(F.lit("- 候補件数: "), "candidate_count"), *counts, F.lit(""), F.lit("| Source | 状態 | 候補 | 警告 |"), F.lit("|---|---:|---:|---:|"))
    return summary.select(F.concat(F.array_join(F.concat(head, line, errors), "\n"), F.lit("\n")).alias("markdown"))


def merged_state(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table after an upsert, its counts)."""
    merged = rows.merge_rows(current, incoming)
    return merged, rows.merge_counts(merged)
