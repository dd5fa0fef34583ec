"""Operators on rows that a position orders: de-duplication, joins by normal forms, merges, differences and counts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import codes, text, urls


def fullest_candidates(candidates: DataFrame, keys: tuple[str, str] = ("detail_url", "title_hint"), size: Column | None = None) -> DataFrame:
    """One row per key: the one with most PDF links, the first of equal ones; ``place`` is the key's first position. Null keys are keys too."""
    size = F.size("pdf_urls") if size is None else size
    own = F.struct(*candidates.columns)
    best = candidates.groupBy(*keys).agg(F.max_by(own, F.struct(size.alias("s"), (-F.col("pos")).alias("p"))).alias("best"), F.min("pos").alias("place"))
    return best.select("best.*", "place")


def last_per_key(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key, as a table read into a dictionary would leave it."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), position).alias("r")).select(key, "r.*")


def first_per_key(rows: DataFrame, key: str, position: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), position).alias("r")).select(key, "r.*")


def match_by_url(candidates: DataFrame, events: DataFrame, candidate_url: str = "detail_url", event_url: str = "primary_official_url") -> DataFrame:
    """Candidates with the event of the same URL; of events that share one the last row counts. URLs that are none match nothing."""
    keyed = last_per_key(events.withColumn("url_norm", urls.join_form(F.col(event_url))).filter("url_norm <> ''"), "url_norm", "row_number")
    return candidates.withColumn("url_norm", urls.join_form(F.col(candidate_url))).join(keyed, "url_norm")


def merge_rows(current: DataFrame, incoming: DataFrame, key: str = "event_id", canonical: str | None = "canonical_event_id", position: str = "pos") -> DataFrame:
    """Upsert: current columns, with ``action`` (kept, updated, inserted). ``incoming`` has the key, a position and a map ``cells`` from column to text (or null) of the columns it brings.

    Rows of one key apply in order, so the last that brings a column decides it. A new row has the columns that it brings, and itself as canonical row unless it names one.
    """
    columns = [c for c in current.columns if c != key]
    brought = incoming.select(key, position, F.explode("cells").alias("column", "value"))
    latest = brought.groupBy(key, "column").agg(F.max_by(F.struct("value"), position).alias("v"))
    cells = latest.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column", F.col("v.value").alias("value")))).alias("cells"))
    # Keys that bring no column still make a row.
    cells = incoming.select(key).distinct().join(cells, key, "left").withColumn("_in", F.lit(True))
    joined = current.withColumn("_cur", F.lit(True)).join(cells, key, "full")
    there = F.coalesce("_cur", F.lit(False))
    out = []
    for c in columns:
        kind = current.schema[c].dataType
        value = F.when(F.map_contains_key("cells", c), F.try_element_at("cells", F.lit(c)).cast(kind)).otherwise(F.col(c))
        if c == canonical:
            value = F.when(there, value).otherwise(F.coalesce(text.blank_to_null(value), F.col(key).cast(kind)))
        out.append(value.alias(c))
    action = F.when(~there, F.lit("inserted")).when(F.coalesce("_in", F.lit(False)), F.lit("updated")).otherwise(F.lit("kept"))
    return joined.select(key, *out, action.alias("action"))


def merge_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "updated").alias("updated"), F.count("*").alias("total"))


def unknown_columns(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Columns that incoming rows bring and the table has not."""
    names = incoming.select(F.explode(F.map_keys("cells")).alias("column")).distinct()
    return names.filter(~F.col("column").isin(current.columns))


def stale_rows(current: DataFrame, edits: DataFrame, key: str = "event_id") -> DataFrame:
    """Edits made against an older version: both versions are given and differ."""
    both = edits.join(current.select(key, F.col("updated_at").alias("_now")), key)
    given = (F.coalesce("expected_updated_at", F.lit("")) != "") & (F.coalesce("_now", F.lit("")) != "")
    return both.filter(given & (F.col("expected_updated_at") != F.col("_now"))).drop("_now")


def compare_with_state(fetched: DataFrame, state: DataFrame) -> DataFrame:
    """Change detection: fetched (url, body) against the last hash of each URL; outcome fetched or not_modified, the body blanked where nothing changed."""
    hashed = fetched.withColumn("content_hash", F.sha2(F.col("body").cast("binary"), 256))
    joined = hashed.join(state.select("url", F.col("content_hash").alias("_before")), "url", "left")
    same = F.coalesce(F.col("content_hash") == F.col("_before"), F.lit(False))
    return joined.select("url", F.when(same, F.lit("not_modified")).otherwise(F.lit("fetched")).alias("outcome"), F.when(~same, F.col("body")).alias("body"), "content_hash")


def next_state(state: DataFrame, compared: DataFrame) -> DataFrame:
    """State after a run, to be written after its candidates are: a lost run then repeats work and loses nothing."""
    new = compared.select("url", "content_hash")
    return state.select("url", "content_hash").join(new, "url", "left_anti").unionByName(new)


def write_back(events: DataFrame, candidates: DataFrame, accepted: float = 0.85) -> DataFrame:
    """(event_id, cells) that extracted fields of matched candidates bring: values of ``accepted`` confidence, reasons that are settled, their display and label.

    ``events`` has event_id, primary_official_url, row_number and reason_codes (array); ``candidates`` detail_url and extracted (a map of fields).
    """
    # Extracted field and the column that it fills.
    targets = {"event_start": "event_start_at", "application_deadline_at": "application_deadline_at", "application_deadline_text": "application_deadline_text", "capacity_text": "capacity_text", "fee_category": "fee_category", "fee_text": "fee_text", "application_url": "application_url"}
    met = match_by_url(candidates.filter(F.size("extracted") > 0), events)
    item = lambda name: F.try_element_at("extracted", F.lit(name))
    good = lambda name: item(name)["confidence"] >= accepted
    pair = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))
    cells = [F.when(good(name), pair(column, item(name)["value"])) for name, column in targets.items()]
    left = codes.open_reasons(F.col("reason_codes"), F.col("extracted"))
    cells += [F.when(good("fee_text"), pair("fee_verified", F.lit("TRUE")))]
    cells += [pair("review_reason_codes", F.array_join(left, "\n")), pair("review_reason_display", codes.reason_display(left)), pair("review_label", F.when(F.size(left) > 0, F.lit("あり")).otherwise(F.lit("なし")))]
    return met.select("event_id", "pos", F.map_from_entries(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("cells"))


def zero_filled_counts(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A count for each of ``values``, zero if it never comes, and for any other value that comes."""
    known = rows.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` string")
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return known.join(counted, column, "full").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def source_status() -> Column:
    """Of a source's run, from held (a reason to hold), candidates and failures."""
    none = F.col("candidates") == 0
    return F.when(F.col("held") & none, F.lit("technical_hold")).when((F.col("failures") > 0) & ~none, F.lit("partial")).when(F.col("failures") > 0, F.lit("failed")).otherwise(F.lit("success"))


class Cut(NamedTuple):
    """A column that cuts an order into stretches; ``down`` if they run from the greatest."""

    name: str
    value: Column
    down: bool = False


def id_cut(rows: DataFrame, column: str = "event_id") -> Cut:
    """Stretches of ids: four characters of a text, 2**16 numbers."""
    number = isinstance(rows.schema[column].dataType, NumericType)
    return Cut("_id", F.floor(F.col(column) / 65536) if number else F.substring(column, 1, 4))


def placed(rows: DataFrame, levels: list[list[Cut]], order: list[Column], name: str = "place", by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their place, from 1, in one order over all of them (or over those of equal ``by``), without gathering them in one task.

    Each of ``levels`` cuts the stretches of the level above into finer ones; ``order`` refines them all. Rows are numbered within the finest stretches, and the sizes of stretches say how many rows stand before: at each level within the stretch
    above it, so that no task sees more than the first level's stretches, the finer stretches of one, or the rows of one of the finest.
    """
    cuts = [c for level in levels for c in level]
    names = [*by, *[c.name for c in cuts]]
    keyed = rows.withColumns({c.name: c.value for c in cuts})
    sizes = keyed.groupBy(*names).agg(F.count("*").alias("_size"))
    before, above = None, list(by)
    for level in levels:
        ends = [F.desc(c.name) if c.down else F.asc(c.name) for c in level]
        within = [*above, *[c.name for c in level]]
        total = sizes.groupBy(*within).agg(F.sum("_size").alias("_size"))
        ahead = F.coalesce(F.sum("_size").over(Window.partitionBy(*above).orderBy(*ends).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        here = total.withColumn("_here", ahead).drop("_size")
        if before is None:
            before = here.withColumnRenamed("_here", "_before")
        else:
            last = before.select(*[F.col(c).alias(f"{c}_a") for c in above], "_before")
            met = here.join(last, on=[F.col(c).eqNullSafe(F.col(f"{c}_a")) for c in above])
            before = met.select(*within, (F.col("_before") + F.col("_here")).alias("_before"))
        above = within
    numbered = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    joined = numbered.alias("w").join(before.select(*[F.col(c).alias(f"{c}_b") for c in names], "_before"), on=[F.col(f"w.`{c}`").eqNullSafe(F.col(f"{c}_b")) for c in names])
    return joined.select(*[F.col(f"w.`{c}`") for c in rows.columns], (F.col("_before") + F.col("_nth")).alias(name))


def next_row(rows: DataFrame, number: str) -> DataFrame:
    """One row: the number behind the greatest one, 1 in an empty table."""
    return rows.agg((F.coalesce(F.max(number), F.lit(0)) + 1).cast("long").alias("next_row"))


def within_budget(requests: DataFrame, source: str, position: str, budget: str, used: int = 1) -> DataFrame:
    """``requests`` with ``allowed``: the first of each source that its budget leaves, robots.txt counting as ``used``."""
    nth = F.row_number().over(Window.partitionBy(source).orderBy(position))
    return requests.withColumn("allowed", nth + used <= F.col(budget))


def admin_stats(events: DataFrame, reviews: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: total, published, pending, review and source_errors."""
    e = events.agg(F.count("*").alias("total"), F.count_if(F.col("publication_status") == "公開").alias("published"), F.count_if(F.col("publication_status") == "確認待ち").alias("pending"))
    r = reviews.agg(F.count("*").alias("review"))
    s = sources.agg(F.count_if(F.col("consecutive_failures") > 0).alias("source_errors"))
    one = F.lit(1).alias("_one")
    return e.select("*", one).join(r.select("*", one), "_one").join(s.select("*", one), "_one").drop("_one")


def pending_reviews(reviews: DataFrame, events: DataFrame) -> DataFrame:
    """Undecided reviews with their event's title (or its id) and rank of priority."""
    open_ = reviews.filter((F.coalesce("review_id", F.lit("")) != "") & F.coalesce("decision", F.lit("")).isin("", "未判断"))
    titled = open_.join(events.select("event_id", "title"), "event_id", "left")
    rank = F.when(F.col("priority") == "緊急", 0).when(F.col("priority") == "高", 1).when(F.col("priority") == "低", 3).otherwise(2)
    return titled.withColumns({"title": text.first_given(F.col("title"), F.col("event_id")), "rank": rank})


def missing_names(required: list[str], existing: DataFrame, column: str) -> DataFrame:
    """Anti join of names: what is required and not there."""
    return existing.sparkSession.createDataFrame([(n,) for n in required], f"`{column}` string").join(existing.select(column).distinct(), column, "left_anti")
