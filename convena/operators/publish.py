"""From resolved events to the published document. A row that fails a check gets an error code; ``fail_fast`` turns the first one into an exception instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, text, times, urls
from .rows import Cut, id_cut, placed

# The fields that are published, those that must be there, and those that hold URLs.
PUBLIC = [
    "title", "summary", "event_type", "genres", "detailed_tags", "organizer_name", "organizer_type", "source_prefecture", "venue_prefecture", "venue_name", "format", "has_on_demand", "audience_conditions", "capacity_text",
    "credits_text", "event_start_at", "event_end_at", "stream_start_at", "stream_end_at", "stream_period_text", "application_deadline_at", "application_deadline_text", "timezone", "effective_end_at", "fee_category", "fee_text",
    "primary_official_url", "application_url", "primary_pdf_url", "pdf_keyword_hit", "last_verified_at", "review_reason_display",
]
REQUIRED = ["format", "organizer_name", "primary_official_url", "title"]
URL_FIELDS = ["primary_official_url", "application_url", "primary_pdf_url"]
DATE_FIELDS = ["event_start_at", "stream_start_at", "stream_end_at"]
#: Lists and booleans are JSON text in resolved values.
TYPED = {"genres": "array<string>", "detailed_tags": "array<string>", "has_on_demand": "boolean", "pdf_keyword_hit": "boolean"}


def publishable(events: DataFrame) -> DataFrame:
    """Published, and not merged into another event."""
    return events.filter((F.col("publication_status") == "公開") & (F.col("canonical_event_id") == F.col("event_id")))


def missing_fields() -> Column:
    """Names of required fields that are null or empty, sorted."""
    return F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull())


def publication_error() -> Column:
    bad_urls = F.filter(F.array(*[F.when((F.coalesce(F.col(c), F.lit("")) != "") & ~urls.is_public(F.col(c)), F.lit(c)) for c in URL_FIELDS]), lambda x: x.isNotNull())
    return (
        F.when(F.size(missing_fields()) > 0, F.concat(F.lit("missing required public fields: "), F.array_join(missing_fields(), ", ")))
        .when(text.first_given(*[F.col(c) for c in DATE_FIELDS]).isNull(), F.lit("event or stream date is required"))
        .when(F.size(bad_urls) > 0, F.concat(F.lit("invalid URL in "), F.get(bad_urls, F.lit(0))))
    )


def checked(wide: DataFrame, fail_fast: bool = False) -> DataFrame:
    found = wide.withColumn("error", publication_error())
    if fail_fast:
        return found.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "event_id", "error"))))
    return found


def public_events(wide: DataFrame) -> DataFrame:
    """The allow-list of fields as ``public`` (null where absent or empty; false and empty lists stay), with event_id, detail_path, review_label and hashes of approved search terms."""
    columns = []
    for name in PUBLIC:
        if name in wide.columns:
            value = text.blank_to_null(F.col(name))
            columns.append((F.from_json(value, TYPED[name]) if TYPED.get(name, "").startswith("array") else value.cast(TYPED[name]) if name in TYPED else value).alias(name))
    hashes = F.lit(None).cast("array<string>")
    if "pdf_search_terms" in wide.columns:
        # NFKC over the terms joined by a character that it leaves alone, in a projection of its own, as a function in Python takes columns and not items.
        terms = F.filter(F.from_json("pdf_search_terms", "array<string>"), lambda t: F.trim(t) != "")
        wide = wide.withColumn("_terms", text.nfkc(F.array_join(terms, "\x01")))
        keys = F.split(text.search_key(F.col("_terms"), compatible=False), "\x01")
        hashes = F.when(F.col("_terms") != "", codes.all_gram_hashes(keys))
    head = [F.col("event_id"), F.concat(F.lit("/events/"), "event_id", F.lit("/")).alias("detail_path"), F.col("review_label")]
    return wide.select(*head, *columns, F.when(F.size(hashes) > 0, hashes).alias("pdf_search_hashes"))



def format_rank(c: Column) -> Column:
    """Place among the formats; the last one's for any other."""
    return F.when(c.isin(codes.FORMATS), F.array_position(F.array(*[F.lit(x) for x in codes.FORMATS]), c).cast("int") - 1).otherwise(F.lit(len(codes.FORMATS) - 1))


def publication_order() -> list[Column]:
    """Rank of the format, the date as text, the title, then the place in the input."""
    return [format_rank(F.col("format")), times.sort_date(F.col("event_start_at"), F.col("stream_start_at"), F.col("stream_end_at"), "9999-12-31"), F.col("title"), F.col("event_id")]


def publication_places(public: DataFrame) -> DataFrame:
    """``public`` with its place in publication order; the rank of the format and the month cut the order, and again date, title and id."""
    date = times.sort_date(F.col("event_start_at"), F.col("stream_start_at"), F.col("stream_end_at"), "9999-12-31")
    return placed(public, [[Cut("_rank", format_rank(F.col("format"))), Cut("_month", F.substring(date, 1, 7))], [Cut("_date", date), Cut("_title", F.col("title")), id_cut(public)]], publication_order())


def document(public: DataFrame, generated_at: str) -> DataFrame:
    """One row with the published document as JSON: its events in publication order. The one place that gathers rows, as the document is one text."""
    ranked = publication_places(public).withColumnRenamed("place", "_place")
    events = F.transform(F.array_sort(F.collect_list(F.struct("_place", F.struct(*public.columns).alias("e")))), lambda x: x["e"])
    body = ranked.agg(F.count("*").alias("event_count"), events.alias("events"))
    return body.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(generated_at).alias("generated_at"), "event_count", "events")).alias("json"))
