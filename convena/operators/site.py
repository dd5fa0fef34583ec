"""What visitors see: active and past events, their order, facets and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, text, times
from .rows import Cut, id_cut, placed

SEARCHED = ["title", "organizer_name", "summary", "event_type", "format", "source_prefecture", "venue_prefecture", "audience_conditions", "credits_text"]


def _end() -> Column:
    return times.effective_end(F.col("effective_end_at"), F.col("stream_end_at"), F.col("event_end_at"), F.col("event_start_at"))


def expired(rows: DataFrame, as_of: str) -> DataFrame:
    """Published rows whose end, an aware time, is before ``as_of``; malformed and naive ends are passed over."""
    return rows.filter((F.col("publication_status") == "公開") & (times.instant(_end()) < F.to_timestamp(F.lit(as_of))))


def archived(rows: DataFrame, as_of: str) -> DataFrame:
    """All rows, the expired ones with the archive's status and time."""
    gone = F.coalesce((F.col("publication_status") == "公開") & (times.instant(_end()) < F.to_timestamp(F.lit(as_of))), F.lit(False))
    return rows.withColumns({"publication_status": F.when(gone, F.lit("アーカイブ")).otherwise(F.col("publication_status")), "archived_at": F.when(gone, F.lit(as_of)).otherwise(F.col("archived_at"))})


def flagged(events: DataFrame, generated_at: str) -> DataFrame:
    """``events`` with ``active``: an event without an end stays active."""
    return events.withColumn("active", ~F.coalesce(times.instant(_end()) < F.to_timestamp(F.lit(generated_at)), F.lit(False)))


def partitioned(events: DataFrame, generated_at: str) -> DataFrame:
    """``flagged`` events with ``place`` in the order of their list: active ones by date and title, past ones in reverse."""
    date = times.sort_date(F.col("event_start_at"), F.col("stream_start_at"), F.col("stream_end_at"), "9999")
    keyed = flagged(events, generated_at).withColumns({"_d": date, "_t": F.coalesce("title", F.lit(""))})
    # Events without a date are one month, so a month is cut again by date, title and id.
    levels = lambda down: [[Cut("_month", F.substring("_d", 1, 7), down)], [Cut("_date", F.col("_d"), down), Cut("_title", F.col("_t"), down), id_cut(events)]]
    up = placed(keyed.filter("active"), levels(False), [F.col("_d"), F.col("_t"), F.col("event_id")])
    down = placed(keyed.filter("not active"), levels(True), [F.desc("_d"), F.desc("_t"), F.col("event_id")])
    return up.unionByName(down).drop("_d", "_t")


def site_counts(parted: DataFrame) -> DataFrame:
    """Of ``flagged`` events; places aren't needed."""
    return parted.agg(F.count_if("active").alias("active_count"), F.count_if(~F.col("active")).alias("archive_count"), F.count("*").alias("detail_count"))


def home(parted: DataFrame, most: int = 6) -> DataFrame:
    """The first active events that can be followed on line; a top-k by design."""
    return parted.filter(F.col("active") & F.col("format").isin(codes.WEB_FORMATS)).orderBy("place").limit(most)


def first_tags(genres: Column) -> Column:
    return F.slice(genres, 1, 3)


def search_text() -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in SEARCHED], F.array_join("genres", " "), F.array_join("detailed_tags", " "))


def plain_match(searched: Column, query: str) -> Column:
    """``searched`` and ``query`` are search keys: without white space, so a match may run across fields."""
    return F.contains(searched, F.lit(query))


def hash_match(hashes: Column, query: str) -> Column:
    """All hashes of the query's runs of two and three characters are among ``hashes``; a query of one character matches none."""
    if len(query) < 2:
        return F.lit(False)
    return F.size(F.array_except(codes.gram_hashes(F.lit(query)), F.coalesce(hashes, F.array().cast("array<string>")))) == 0


def faceted(events: DataFrame, now: str, query: str = "", genre: str = "", form: str = "", event_type: str = "", fee: str = "", month: str = "", open_deadline: bool = False) -> DataFrame:
    """Events that meet all facets, with ``pdf_hit``: found by hashes and not by their text. ``events`` has ``search_key``; an event without a deadline has none that is open."""
    plain = plain_match(F.col("search_key"), query) if query else F.lit(True)
    by_hash = hash_match(F.col("pdf_search_hashes"), query) if query else F.lit(False)
    held = plain | by_hash
    for column, wanted in (("format", form), ("event_type", event_type), ("fee_category", fee)):
        held = held & (F.col(column) == wanted) if wanted else held
    held = held & F.array_contains("genres", genre) if genre else held
    held = held & F.startswith(times.sort_date(F.col("event_start_at"), F.col("stream_start_at"), F.col("stream_end_at"), ""), F.lit(month)) if month else held
    held = held & (times.instant(F.col("application_deadline_at")) >= F.to_timestamp(F.lit(now))) if open_deadline else held
    return events.withColumn("pdf_hit", by_hash & ~plain).filter(F.coalesce(held, F.lit(False)))


def browse_order(mode: str) -> list[Column]:
    """By date or deadline, missing ones last, or by title in Japanese order."""
    if mode == "title":
        return [F.collate("title", "ja"), F.col("event_id")]
    key = "application_deadline_at" if mode == "deadline" else "event_start_at"
    return [F.coalesce(text.blank_to_null(F.col(key)), F.lit("9999")), F.col("event_id")]


def browse_places(events: DataFrame, mode: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``events`` with their place by ``browse_order``, among those of equal ``by``."""
    order = browse_order(mode)
    cuts = [[Cut("_first", F.substring(order[0], 1, 7))], [Cut("_key", order[0]), id_cut(events)]] if mode != "title" else [[Cut("_key", order[0]), id_cut(events)]]
    return placed(events, cuts, order, by=by)
