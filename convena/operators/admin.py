"""What administrators see and may change: projections with blanks for what is missing, validated edits, and the parts of a dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, text, urls
from . import review, rows

# Columns that administrators see, in their order.
SHOWN = [
    "event_id", "publication_status", "review_status", "review_label", "review_reason_display", "duplicate_status", "data_quality_score", "title", "summary", "event_type", "genres", "detailed_tags", "organizer_name", "organizer_type",
    "source_prefecture", "venue_prefecture", "venue_name", "venue_address", "format", "audience_conditions", "capacity_text", "credits_text", "event_start_at", "event_end_at", "stream_start_at", "stream_end_at", "stream_period_text",
    "application_deadline_at", "application_deadline_text", "effective_end_at", "fee_category", "fee_text", "fee_verified", "primary_official_url", "application_url", "primary_pdf_url", "last_auto_fetched_at", "last_admin_updated_at",
    "last_verified_at", "admin_note",
]
# Columns that they may edit, in their order.
EDITABLE = [
    "publication_status", "review_status", "review_label", "review_reason_display", "title", "summary", "event_type", "genres", "detailed_tags", "organizer_name", "organizer_type", "source_prefecture", "venue_prefecture", "venue_name",
    "venue_address", "format", "audience_conditions", "capacity_text", "credits_text", "event_start_at", "event_end_at", "stream_start_at", "stream_end_at", "stream_period_text", "application_deadline_at", "application_deadline_text",
    "effective_end_at", "fee_category", "fee_text", "fee_verified", "primary_official_url", "application_url", "primary_pdf_url", "last_verified_at", "admin_note",
]
ENUMS = {"publication_status": codes.PUBLICATION, "review_status": codes.REVIEW, "review_label": codes.LABEL, "event_type": codes.EVENT_TYPES, "organizer_type": codes.ORGANIZER_TYPES, "format": codes.FORMATS, "fee_category": codes.FEES}
LINKS = ["primary_official_url", "application_url", "primary_pdf_url"]
LISTS = ["genres", "detailed_tags"]
# Decisions that can be taken from the dashboard, what they say of automation, and the note of an edit without one.
QUICK = ["公開", "要確認付き公開", "非公開"]
ASK_AGAIN, EDITED = "次回も確認", "管理画面から更新"


def shown(events: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text of the columns, empty where there is none; order by what ends first, events without an end last."""
    cell = lambda c: F.array_join(c, "\n") if c in LISTS and events.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
    listed = [F.coalesce(cell(c) if c in events.columns else F.lit(""), F.lit("")).alias(c) for c in columns or SHOWN]
    end = F.coalesce(text.blank_to_null(F.col("effective_end_at").cast("string")), F.lit("9999")) if "effective_end_at" in events.columns else F.lit("9999")
    return events.select(*listed, end.alias("sort_key"))


def edit_error() -> Column:
    """Why an edit (a map ``cells``) is refused, or null: a column that is not editable, a code that is not in its list, a URL that is none."""
    bad_column = F.filter(F.map_keys("cells"), lambda k: ~k.isin(EDITABLE))
    cell = lambda c: F.coalesce(F.try_element_at("cells", F.lit(c)), F.lit(""))
    failures = [F.when((cell(c) != "") & ~cell(c).isin(members), F.lit(c)) for c, members in ENUMS.items()]
    failures += [F.when((cell(c) != "") & ~urls.is_public(cell(c)), F.lit(c)) for c in LINKS]
    bad_value = F.filter(F.array(*failures), lambda x: x.isNotNull())
    return F.when(F.size(bad_column) > 0, F.concat(F.lit("not editable: "), F.array_join(bad_column, ", "))).when(F.size(bad_value) > 0, F.concat(F.lit("invalid value: "), F.array_join(bad_value, ", ")))


def normalized_cells(cells: Column) -> Column:
    """Values trimmed, lists one value a line."""
    return F.transform_values(cells, lambda k, v: F.when(k.isin(LISTS), F.array_join(text.split_admin_value(F.coalesce(v, F.lit(""))), "\n")).otherwise(F.trim(F.coalesce(v, F.lit("")))))


def apply_edits(events: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events after the edits, refused edits with their error). ``edits`` has event_id, pos, cells and expected_updated_at; ``events`` has updated_at and text columns."""
    checked = edits.withColumn("error", edit_error())
    unknown = checked.join(events.select("event_id"), "event_id", "left_anti").withColumn("error", F.lit("unknown event"))
    known = checked.join(events.select("event_id"), "event_id", "left_semi")
    stale = rows.stale_rows(events, known.filter("error is null")).withColumn("error", F.lit("changed meanwhile"))
    good = known.filter("error is null").join(stale.select("event_id", "pos"), ["event_id", "pos"], "left_anti")
    merged = rows.merge_rows(events, good.select("event_id", "pos", normalized_cells(F.col("cells")).alias("cells")), canonical=None)
    return merged, known.filter("error is not null").unionByName(stale, allowMissingColumns=True).unionByName(unknown)


def edit_actions(events: DataFrame, edits: DataFrame, actor: str, acted_at: str) -> DataFrame:
    """Audit rows of the edits that ``apply_edits`` takes: the event before and after as JSON; ``edits`` may have a ``note``."""
    merged, refused = apply_edits(events, edits)
    good = edits.join(refused.select("event_id", "pos"), ["event_id", "pos"], "left_anti")
    before = events.select("event_id", F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("before_json"))
    after = merged.select("event_id", F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("after_json"))
    note = text.first_given(F.col("note"), F.lit(EDITED)) if "note" in edits.columns else F.lit(EDITED)
    key = codes.action_id(F.lit(""), F.concat_ws("|", "event_id", F.col("pos").cast("string")), F.lit(acted_at))
    rows_ = good.join(before, "event_id").join(after, "event_id")
    return rows_.select(key.alias("action_id"), F.lit("").alias("review_id"), "event_id", F.lit("admin_edit").alias("action"), "before_json", "after_json", F.lit(ASK_AGAIN).alias("automation_choice"), F.lit(actor).alias("actor"), F.lit(acted_at).alias("acted_at"), note.alias("note"))


def decide_quick(reviews: DataFrame) -> DataFrame:
    """``review.decide`` for the dashboard, where only QUICK decisions can be taken, of reviews not yet settled (``settled``: the decision that a review has, if any), and never a rule."""
    asked = reviews.withColumns({"automation_choice": F.lit(ASK_AGAIN), "approve_automation": F.lit(False)})
    decided = review.decide(asked)
    refused = F.when(~F.col("decision").isin(QUICK), F.lit("not a decision of the dashboard")).when(~F.coalesce("settled", F.lit("")).isin("", "未判断"), F.lit("already decided"))
    error = F.coalesce(refused, F.col("error"))
    return decided.withColumns({"error": error, "after": F.when(error.isNull(), F.col("after")), "action": F.when(error.isNull(), F.col("action"))})


def matched(reviews: DataFrame, events: DataFrame) -> DataFrame:
    """Reviews with their event; an error, when read, if one has none."""
    joined = reviews.join(events.withColumn("_there", F.lit(True)), "event_id", "left")
    return joined.filter(F.coalesce("_there", F.raise_error(F.concat(F.lit("no event "), "event_id")).cast("boolean"))).drop("_there")


def automation_rules(decided: DataFrame, event_sources: DataFrame) -> DataFrame:
    """Rules that approved decisions make for their event's source, the first that it was found at; those without a source make none."""
    first = rows.first_per_key(event_sources.select("event_id", "source_id", "row_number"), "event_id", "row_number")
    return decided.filter("rule is not null").join(first, "event_id").select("rule.*", F.to_json(F.struct("source_id")).alias("source_condition"))


def dashboard(events: DataFrame, reviews: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """The frames of a dashboard: none is collected here."""
    return {"events": shown(events), "reviews": rows.pending_reviews(reviews, events), "sources": sources, "stats": rows.admin_stats(events, rows.pending_reviews(reviews, events), sources)}
