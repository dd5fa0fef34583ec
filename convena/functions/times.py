"""Times are ISO texts with their offset, as offsets carry meaning and a timestamp drops them; instants are derived where they are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_given

AWARE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?)(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)$"
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)?)?$"


def instant(iso: Column) -> Column:
    """The instant of an ISO text with an offset; null for one that is malformed or names no offset."""
    return F.when(iso.rlike(AWARE), F.try_to_timestamp(iso))


def wall_date(iso: Column) -> Column:
    """The calendar date as written, whatever the offset; null if malformed."""
    return F.when(iso.rlike(ISO), F.to_date(F.try_to_timestamp(F.substring(iso, 1, 10))))


def is_aware(iso: Column) -> Column:
    return instant(iso).isNotNull()


def effective_end(effective: Column, stream_end: Column, event_end: Column, event_start: Column) -> Column:
    return first_given(effective, stream_end, event_end, event_start)


def sort_date(event_start: Column, stream_start: Column, stream_end: Column, missing: str) -> Column:
    """The text that orders events; compared as text."""
    return F.coalesce(first_given(event_start, stream_start, stream_end), F.lit(missing))


def date_score(a: Column, b: Column) -> Column:
    """1 on the same calendar date, 0.4 a day apart, else 0."""
    apart = F.abs(F.datediff(wall_date(a), wall_date(b)))
    return F.when(apart == 0, F.lit(1.0)).when(apart == 1, F.lit(0.4)).otherwise(F.lit(0.0))


def display_time(iso: Column) -> Column:
    """Month and day, with the time of day unless it is midnight; text that is no time as it is, a missing one as to be confirmed."""
    clock = F.coalesce(F.regexp_extract(iso, r"[T ](\d{2}:\d{2})", 1), F.lit(""))
    date = F.concat(F.month(wall_date(iso)), F.lit("月"), F.day(wall_date(iso)), F.lit("日"))
    shown = F.concat(date, F.when(clock.isin("", "00:00"), F.lit("")).otherwise(F.concat(F.lit(" "), clock)))
    return F.when(F.coalesce(iso, F.lit("")) == "", F.lit("要確認")).otherwise(F.coalesce(shown, iso))


def display_period(start: Column, end: Column, text: Column) -> Column:
    given = (F.coalesce(start, F.lit("")) != "") | (F.coalesce(end, F.lit("")) != "")
    return F.coalesce(first_given(text), F.when(given, F.concat(display_time(start), F.lit(" 〜 "), display_time(end))), F.lit("要確認"))
