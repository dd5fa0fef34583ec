"""Checks of fields that a provider extracted: a map from name to value (JSON text), confidence and evidence, with reasons for review."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes, times, urls
from .text import normalize_space, ordered_distinct

# Fields that are known, those that need evidence, and the closed sets.
DATES = ["event_start", "event_end", "stream_start", "stream_end", "application_deadline"]
ENUMS = {"format": codes.FORMATS, "event_type": codes.EVENT_TYPES, "organizer_type": codes.ORGANIZER_TYPES, "fee_category": codes.FEES}
LINKS = ["official_url", "application_url"]
KNOWN = ["title", *DATES, *ENUMS, "genres", "organizer", "fee_text", "audience_conditions", "credits_text", *LINKS]
EVIDENCED = [*DATES, "fee_category", "fee_text", "credits_text"]
EVIDENCE_LENGTH = 300

RAW = "map<string,struct<value:string,confidence:string,evidence:string>>"


def confidence(c: Column) -> Column:
    """Between 0 and 1; 0 for what is no number."""
    number = c.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def evidence(c: Column) -> Column:
    text = F.substring(normalize_space(c), 1, EVIDENCE_LENGTH)
    return F.when(text != "", text)


def _text(value: Column) -> Column:
    """A JSON string's text; other JSON as it stands."""
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"), value)


def _checked(name: Column, item: Column, allowed: Column) -> Column:
    """(value, confidence, evidence, reason): the first check that fails blanks the value, so later ones pass it over."""
    seen, value = evidence(item["evidence"]), F.when((item["value"] != "null"), item["value"])
    text, upper = _text(value), F.upper(name)
    source = F.transform(allowed, urls.source_form)
    is_list = F.startswith(F.trim(value), F.lit("["))
    failures = F.when(value.isNull(), F.lit(None).cast("string"))
    failures = failures.when(name.isin(EVIDENCED) & seen.isNull(), F.concat(upper, F.lit("_EVIDENCE_MISSING")))
    failures = failures.when(name.isin(DATES) & ~F.coalesce(times.is_aware(text), F.lit(False)), F.concat(upper, F.lit("_INVALID")))
    for field, members in ENUMS.items():
        failures = failures.when((name == field) & ~text.isin(members), F.concat(upper, F.lit("_INVALID")))
    failures = failures.when((name == "genres") & ~is_list, F.lit("GENRES_INVALID"))
    failures = failures.when(name.isin(LINKS) & ~F.array_contains(source, urls.source_form(text)), F.lit("URL_NOT_IN_SOURCE"))
    genres = F.to_json(F.filter(F.from_json(value, "array<string>"), lambda g: g.isin(codes.GENRES)))
    kept = F.when(name == "genres", genres).when(name.isin(LINKS), urls.source_form(text)).otherwise(text)
    return F.struct(
        F.when(failures.isNull(), kept).alias("value"), F.when(failures.isNull(), confidence(item["confidence"])).otherwise(F.lit(0.0)).alias("confidence"), seen.alias("evidence"), failures.alias("reason")
    )


def validated(fields: Column, reasons: Column, allowed_urls: Column) -> Column:
    """(fields, review_reasons): unknown fields dropped, bad values blanked with confidence 0 and a reason, reasons distinct in order."""
    known = F.map_filter(fields, lambda k, v: k.isin(KNOWN) & v.isNotNull())
    checked = F.transform_values(known, lambda k, v: _checked(k, v, allowed_urls))
    given = F.transform(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: r)
    found = F.transform(F.map_values(checked), lambda v: v["reason"])
    plain = F.transform_values(checked, lambda k, v: F.struct(v["value"].alias("value"), v["confidence"].alias("confidence"), v["evidence"].alias("evidence")))
    return F.struct(plain.alias("fields"), ordered_distinct(F.concat(F.filter(given, lambda r: F.trim(r) != ""), found)).alias("review_reasons"))
