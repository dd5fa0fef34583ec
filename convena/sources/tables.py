"""Typed tables: schemas are declared, never inferred; what a file lacks is null, and a row without its key is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, text, urls

VALUE = "array<struct<field_name:string,value:variant,confidence:double,extractor:string,extracted_at:string,accepted:boolean,source_document_id:string,evidence_text:string>>"
OVERRIDE = "array<struct<field_name:string,value:variant,active:boolean,updated_by:string,reason:string,updated_at:string>>"
#: Nested event records as they are exchanged.
EVENT_RECORD = (
    "struct<event_id:string,canonical_event_id:string,publication_status:string,review_status:string,review_label:string,duplicate_status:string,fixed_values:variant,"
    f"auto_values:{VALUE},overrides:{OVERRIDE}>"
)
CANDIDATE = "source_id string, source_url string, detail_url string, title_hint string, pdf_urls array<string>, published_at string, discovery_method string, block_text string, confidence_hint double, pos long"
FETCH_STATE = "url string, etag string, last_modified string, content_hash string, fetched_at string"
SOURCE = "source_id string, organization_name string, prefecture string, base_url string, discovery_urls string, allowed_path_prefixes string, adapter_type string, text_encoding string, enabled boolean, auto_publish_policy string, request_interval_seconds double, max_requests_per_run int, user_agent string, robots_url string, notes string"
DEFAULT_AGENT = "event-indexing/0.1 (one scheduled run a day)"
# Columns of the events table, in their order.
EVENT_COLUMNS = [
    "event_id", "canonical_event_id", "publication_status", "review_status", "review_label", "review_reason_codes", "review_reason_display", "duplicate_status", "data_quality_score", "auto_publish_eligible", "title", "summary", "event_type",
    "genres", "detailed_tags", "organizer_name", "organizer_type", "source_prefecture", "venue_prefecture", "venue_name", "venue_address", "format", "has_on_demand", "audience_conditions", "capacity_text", "credits_text", "event_start_at",
    "event_end_at", "event_date_precision", "stream_start_at", "stream_end_at", "stream_period_text", "application_start_at", "application_deadline_at", "application_deadline_text", "timezone", "effective_end_at", "fee_category", "fee_text",
    "fee_verified", "primary_official_url", "application_url", "primary_pdf_url", "source_url_count", "pdf_count", "pdf_keyword_hit", "last_auto_fetched_at", "last_admin_updated_at", "last_verified_at", "admin_note", "archived_at",
]
MULTI = ["genres", "detailed_tags"]
FLAGS = ["auto_publish_eligible", "has_on_demand", "fee_verified", "pdf_keyword_hit"]


def event_records(spark: SparkSession, path: str) -> DataFrame:
    """Event records of JSON documents, each an object with ``events`` or a bare array; ``pos`` is the place in the document."""
    return records_of(spark.read.text(path, wholetext=True))


def records_of(documents: DataFrame) -> DataFrame:
    """Event records of JSON texts (column ``value``)."""
    raw = documents.select(F.parse_json("value").alias("v"))
    listed = raw.select(F.coalesce(F.try_variant_get("v", "$.events", "array<variant>"), F.try_variant_get("v", "$", "array<variant>")).alias("e"))
    rows = listed.select(F.posexplode("e").alias("pos", "r"))
    return rows.select("pos", F.variant_get("r", "$", EVENT_RECORD).alias("r")).select("r.*", "pos")


def automatic_values(records: DataFrame) -> DataFrame:
    rows = records.select("event_id", F.posexplode("auto_values").alias("pos", "v"))
    value = F.when(F.schema_of_variant("v.value") == "STRING", F.variant_get("v.value", "$", "string")).otherwise(F.to_json("v.value"))
    return rows.select("event_id", F.col("v.field_name").alias("field_name"), F.when(~F.is_variant_null("v.value"), value).alias("value"), F.col("v.confidence").alias("confidence"), F.col("v.extracted_at").alias("extracted_at"), F.coalesce("v.accepted", F.lit(True)).alias("accepted"), "pos")


def overrides(records: DataFrame) -> DataFrame:
    rows = records.select("event_id", F.posexplode("overrides").alias("pos", "v"))
    value = F.when(F.schema_of_variant("v.value") == "STRING", F.variant_get("v.value", "$", "string")).otherwise(F.to_json("v.value"))
    return rows.select("event_id", F.col("v.field_name").alias("field_name"), F.when(~F.is_variant_null("v.value"), value).alias("value"), F.coalesce("v.active", F.lit(True)).alias("active"), F.col("v.updated_at").alias("updated_at"), "pos")


def fixed_values(records: DataFrame) -> DataFrame:
    cells = F.from_json(F.to_json("fixed_values"), "map<string,string>")
    return records.select("event_id", F.explode(cells).alias("field_name", "value"))


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a table kept as CSV with a header, by name and not by place: absent columns are empty, rows without event_id are dropped; lists and flags are typed, other text stays text."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    have = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in raw.columns else F.lit("")
    lacking = [c for c in ("event_id", "publication_status") if c not in raw.columns]
    if lacking:
        raise ValueError(f"missing headers: {', '.join(lacking)}")
    columns = [(text.split_cell(have(c)) if c in MULTI else text.cell_boolean(have(c)) if c in FLAGS else have(c)).alias(c) for c in EVENT_COLUMNS]
    number = have("row_number").try_cast("long").alias("row_number")
    return raw.select(*columns, number).filter("event_id <> ''")


def source_configs(rows: DataFrame) -> DataFrame:
    """Configured sources: lists split, ``/`` where no path is allowed explicitly, a default agent, hosts with their twins."""
    lines = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: x != "")
    paths, found = lines("allowed_path_prefixes"), lines("discovery_urls")
    hosts = F.array_distinct(F.transform(F.concat(F.array("base_url"), found), urls.host))
    return rows.withColumns({
        "discovery_urls": found, "allowed_path_prefixes": F.when(F.size(paths) > 0, paths).otherwise(F.array(F.lit("/"))), "user_agent": F.coalesce(text.blank_to_null(F.trim("user_agent")), F.lit(DEFAULT_AGENT)),
        "allowed_hosts": urls.expanded_hosts(hosts),
    })


def one_source(configs: DataFrame, source_id: str) -> DataFrame:
    """The source; an error where it is read if there is none."""
    found = configs.filter(F.col("source_id") == source_id)
    n = found.agg(F.count("*").alias("n")).select(F.assert_true(F.col("n") > 0, F.lit(f"unknown source: {source_id}")).alias("ok"))
    return found.join(F.broadcast(n), F.expr("ok is null")).drop("ok")


def require_known(wanted: list[str], configs: DataFrame) -> DataFrame:
    """Names that no source has."""
    return configs.sparkSession.createDataFrame([(w,) for w in wanted], "source_id string").join(configs.select("source_id"), "source_id", "left_anti")


def fetch_state(spark: SparkSession, path: str) -> DataFrame:
    """The last fetch of each URL; of several rows of one the latest counts."""
    rows = spark.read.schema(FETCH_STATE).json(path).filter("url is not null")
    latest = rows.groupBy("url").agg(F.max_by(F.struct("etag", "last_modified", "content_hash", "fetched_at"), "fetched_at").alias("s"))
    return latest.select("url", "s.*")


def extraction_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached answers by key, from JSON lines; lines that are no answers are dropped."""
    from ..operators.extraction import ANSWER

    return spark.read.schema(f"cache_key string, {ANSWER}").option("mode", "DROPMALFORMED").json(path).filter("cache_key is not null")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDIDATE).json(path)


def append(df: DataFrame, path: str, form: str = "json") -> None:
    """Append-only logs: candidates, fetches, reviews, actions, rules."""
    df.write.mode("append").format(form).save(path)


def tee(df: DataFrame, paths: list[str], form: str = "json") -> None:
    """The same rows to several places, computed once."""
    held = df.persist()
    try:
        for path in paths:
            append(held, path, form)
    finally:
        held.unpersist()


def replace_state(state: DataFrame, path: str) -> None:
    """State in order of URL, written whole; a job's commit makes it appear at once. It may not be read from the same path."""
    state.orderBy("url").write.mode("overwrite").json(path)


def provision(spark: SparkSession, database: str, tables: dict[str, str], seeds: dict[str, DataFrame] | None = None) -> list[str]:
    """Create what is missing of ``tables`` (name -> DDL of columns) and seed those that are empty; returns the names created."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    there = {t.name for t in spark.catalog.listTables(database)}
    made = [name for name in tables if name.lower() not in there]
    for name in made:
        spark.sql(f"CREATE TABLE {database}.{name} ({tables[name]}) USING parquet")
    for name, rows in (seeds or {}).items():
        if spark.table(f"{database}.{name}").isEmpty():
            rows.write.mode("append").insertInto(f"{database}.{name}")
    return made


def settings(spark: SparkSession) -> DataFrame:
    """Code tables as rows (list, code, sort_order), what drop-downs offer."""
    lists = {
        "publication_statuses": codes.PUBLICATION, "review_statuses": codes.REVIEW, "review_labels": codes.LABEL, "duplicate_statuses": codes.DUPLICATE, "event_types": codes.EVENT_TYPES, "formats": codes.FORMATS, "fee_categories": codes.FEES,
        "organizer_types": codes.ORGANIZER_TYPES, "genres": codes.GENRES, "review_priorities": codes.PRIORITIES, "review_decisions": list(codes.DECISIONS),
    }
    return spark.createDataFrame([(name, code, i) for name, values in lists.items() for i, code in enumerate(values, 1)], "list string, code string, sort_order int")


def setting_ranges(rows: DataFrame) -> DataFrame:
    """The first and last row of each list, as a drop-down's range needs."""
    return rows.groupBy("list").agg(F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row"))


def invalid_codes(rows: DataFrame, column: str, list_name: str, table: DataFrame) -> DataFrame:
    """Rows whose code is not in its list; empty codes pass."""
    known = table.filter(F.col("list") == list_name).select(F.col("code").alias(column))
    return rows.filter(F.coalesce(F.col(column), F.lit("")) != "").join(known, column, "left_anti")


def published_events(spark: SparkSession, path: str) -> DataFrame:
    """(generated_at, event as variant) of a published document."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    return raw.select(F.try_variant_get("v", "$.generated_at", "string").alias("generated_at"), F.explode(F.try_variant_get("v", "$.events", "array<variant>")).alias("event"))
