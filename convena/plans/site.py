"""A static site as rows of (path, html): made by expressions, written by whoever holds the site."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..operators import site


def escaped(c: Column) -> Column:
    """Text as HTML, quotes included."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def _document(title: Column, body: Column) -> Column:
    return F.concat(F.lit('<!doctype html><html lang="ja"><meta charset="utf-8"><title>'), escaped(title), F.lit("</title><body>"), body, F.lit("</body></html>"))


def card() -> Column:
    """An event in a list, with what the browser filters by."""
    tags = F.array_join(F.transform(site.first_tags(F.coalesce("genres", F.array().cast("array<string>"))), lambda g: F.concat(F.lit('<span class="tag">'), escaped(g), F.lit("</span>"))), "")
    data = {"search": F.col("search_text"), "genre": F.array_join("genres", "|"), "format": F.col("format"), "event-type": F.col("event_type"), "fee": F.col("fee_category"), "date": F.col("event_start_at"), "deadline": F.col("application_deadline_at"), "pdf-hashes": F.array_join("pdf_search_hashes", ",")}
    attributes = F.concat(*[x for k, v in data.items() for x in (F.lit(f' data-{k}="'), escaped(v), F.lit('"'))])
    review = F.when(F.col("review_label") == "あり", F.concat(F.lit('<p class="review-note">要確認：'), escaped(F.coalesce("review_reason_display", F.lit("公式情報をご確認ください"))), F.lit("</p>"))).otherwise(F.lit(""))
    return F.concat(F.lit('<article class="event-card"'), attributes, F.lit("><h3>"), escaped(F.col("title")), F.lit("</h3><p>"), escaped(times.display_time(F.col("event_start_at"))), F.lit("</p>"), tags, review, F.lit("</article>"))


def pages(events: DataFrame, generated_at: str) -> DataFrame:
    """(path, html): home with the next six, lists of active and past events in their order, and a page for each event. Lists gather what is published, which is one page."""
    parted = site.partitioned(events.withColumn("search_text", site.search_text()), generated_at).withColumn("card", card())
    details = parted.select(F.concat(F.lit("events/"), "event_id", F.lit("/index.html")).alias("path"), _document(F.col("title"), F.concat(F.col("card"), F.lit("<p>"), escaped(F.col("summary")), F.lit("</p>"))).alias("html"))
    listing = lambda rows, path, title: rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "card"))), lambda x: x["card"]), "").alias("body")).select(F.lit(path).alias("path"), _document(F.lit(title), F.col("body")).alias("html"))
    lists = listing(site.home(parted), "index.html", "ホーム").unionByName(listing(parted.filter("active"), "events/index.html", "イベント一覧")).unionByName(listing(parted.filter("not active"), "archive/index.html", "過去のイベント"))
    about = events.sparkSession.range(1).select(F.lit("about/index.html").alias("path"), _document(F.lit("このサイトについて"), F.lit("")).alias("html"))
    return details.unionByName(lists).unionByName(about)


def write(rows: DataFrame, folder: str) -> int:
    """Write the pages below a folder of the driver, one at a time; returns how many."""
    n = 0
    for n, row in enumerate(rows.toLocalIterator(), 1):
        target = Path(folder, row["path"])
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(row["html"], encoding="utf-8")
    return n
