"""From pages to candidates. A site is described by a row of settings, not by code: patterns of detail URLs, whether titles of events count as links, and which structure is tried first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..sources import pages as parse
from .rows import fullest_candidates

# Confidences of the ways in which a candidate is found, and lengths of what is kept of it.
FEED, PDF_LINK, LINK, STRUCTURE, ENRICHED = 0.8, 0.65, 0.7, 0.85, 0.8
FEED_TEXT, BLOCK_TEXT = 1000, 4000
# Settings of the sites by name: detail patterns, links by title, structure tried first.
SITES = [
    ("fukuoka", [r"/event/(?!$|tag/)[^/?#]+/?"], False, "links"),
    ("saga", [r"/(?:\d+(?:st|th)_saga/)?index\.html", r"#\d+$"], True, "links"),
    ("nagasaki", [r"/~ncet/(?:event|kanren)\.html#"], True, "headings"),
    ("kumamoto", [r"/news\.html#\d+", r"/system/event_[^?]+\.php"], True, "headings"),
    ("oita", [r"/event/detail\.php\?"], False, "tables"),
    ("miyazaki", [r"/post/", r"/イベント", r"/関連学会情報"], False, "feed"),
    ("kagoshima", [r"\?news="], False, "links"),
    ("jace", [r"/gakkai/", r"/info-ce/", r"/jsc/seminar/"], False, "links"),
    ("okinawa", [r"/seminars(?:/|$)", r"/seminars-history", r"/notice"], False, "rendered"),
]
SITE = "adapter string, detail_patterns array<string>, by_title boolean, structure string"
#: Columns of a candidate.
COLUMNS = ["key", "source_url", "detail_url", "title_hint", "pdf_urls", "published_at", "discovery_method", "block_text", "confidence_hint", "pos"]


def sites(spark) -> DataFrame:
    return spark.createDataFrame(SITES, SITE)


def _candidate(rows: DataFrame, detail: Column, title: Column, pdfs: Column, method: str, block: Column, confidence: float, published: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("key", F.col("url").alias("source_url"), detail.alias("detail_url"), title.alias("title_hint"), pdfs.alias("pdf_urls"), (published if published is not None else none).alias("published_at"), F.lit(method).alias("discovery_method"), block.alias("block_text"), F.lit(confidence).alias("confidence_hint"), F.col("pos"))


def gated(sources: DataFrame, enabled: list[str] | None = None, force: bool = False) -> DataFrame:
    """``sources`` with ``runs`` and ``status``: a source that is not enabled (by its row, or by ``enabled`` where that is given) doesn't run unless forced, and is ``disabled``."""
    on = F.coalesce(F.col("enabled"), F.lit(False)) if enabled is None else F.col("source_id").isin(enabled)
    runs = on | F.lit(force)
    return sources.withColumns({"runs": runs, "status": F.when(~runs, F.lit("disabled"))})


def sitemap_pages(documents: DataFrame, official: str | None = None) -> DataFrame:
    """(key, place, url) of the pages that sitemaps list, on the official host where one is given; ``documents`` has key and body."""
    listed = documents.select("key", F.posexplode(parse.sitemap_urls(F.col("body"))).alias("place", "url"))
    return listed.withColumn("url", urls.with_host(F.col("url"), official)) if official else listed


def held_for_rendering(html: Column) -> Column:
    """Why a page can't be read: its content is made in the browser."""
    return F.when(F.contains(html, F.lit('id="__nuxt"')) & F.contains(html, F.lit("Loading...")), F.lit("CLIENT_RENDER_REQUIRED"))


def resolved_links(documents: DataFrame) -> DataFrame:
    """(key, url, pos, href, link_url, title) of followed links; ``documents`` has key, url (final) and html."""
    found = parse.page_links(documents, "key")
    joined = documents.select("key", "url").join(found, "key").filter(text.is_followed_link(F.col("href")))
    title = text.normalize_space(text.first_given(F.col("text"), F.col("title")))
    return joined.select("key", "url", F.col("place").cast("long").alias("pos"), "href", parse.joined_url("url", "href").alias("link_url"), F.coalesce(title, F.lit("")).alias("title"))


def link_candidates(documents: DataFrame, settings: DataFrame, adapter: str = "adapter") -> DataFrame:
    """Candidates among links: PDFs with an event's title, and pages whose URL matches a pattern of the site, or any with an event's title where the site says so."""
    links = resolved_links(documents).join(documents.select("key", F.col(adapter).alias("adapter")), "key").join(settings, "adapter")
    marked = links.withColumns({"is_pdf": text.is_pdf_url(F.col("link_url")), "titled": text.is_title_hint(F.col("title")), "matches": F.exists("detail_patterns", lambda p: F.regexp_like(F.col("link_url"), p))})
    empty = F.array().cast("array<string>")
    pdfs = _candidate(marked.filter("is_pdf and titled"), F.col("url"), F.col("title"), F.array("link_url"), "html_pdf", F.lit(""), PDF_LINK)
    details = _candidate(marked.filter("not is_pdf and titled and (matches or by_title)"), F.col("link_url"), F.col("title"), empty, "html", F.lit(""), LINK)
    return fullest_candidates(pdfs.unionByName(details), ("detail_url", "title_hint")).drop("place")


def discovered_urls(documents: DataFrame, settings: DataFrame, adapter: str = "adapter") -> DataFrame:
    """(key, urls, pdf_urls): pages worth fetching and PDFs, distinct in order."""
    links = resolved_links(documents).join(documents.select("key", F.col(adapter).alias("adapter")), "key").join(settings, "adapter")
    pdf = text.is_pdf_url(F.col("link_url"))
    wanted = ~pdf & (F.exists("detail_patterns", lambda p: F.regexp_like(F.col("link_url"), p)) | (F.col("by_title") & text.is_title_hint(F.col("title"))))
    listed = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "link_url")))), lambda x: x["link_url"]))
    return links.groupBy("key").agg(listed(wanted).alias("urls"), listed(pdf).alias("pdf_urls"))


def _linked_pdfs(base: str, hrefs: str) -> Column:
    return F.array_distinct(F.filter(F.col(hrefs), text.is_pdf_url))


def _with_absolute_links(rows: DataFrame) -> DataFrame:
    """``links`` of each row made absolute; links within the page are left out. Exploded, as URLs are joined in batches and not in lambdas."""
    one = rows.select("key", "place", "url", F.posexplode_outer("links").alias("i", "href")).withColumn("u", F.when(F.col("href").isNotNull() & ~F.startswith(F.col("href"), F.lit("#")), parse.joined_url("url", "href")))
    joined = one.groupBy("key", "place").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("u").isNotNull(), F.struct("i", "u")))), lambda x: x["u"]).alias("absolute"))
    return rows.join(joined, ["key", "place"])


def heading_candidates(documents: DataFrame) -> DataFrame:
    """A candidate for each h3 with an event's title; its anchor is its id or its number."""
    rows = _with_absolute_links(documents.select("key", "url").join(parse.page_blocks(documents, "key"), "key")).filter(text.is_title_hint(F.col("title")))
    anchor = F.concat(urls.without_fragment(F.col("url")), F.lit("#"), F.coalesce(text.blank_to_null(F.col("id")), F.concat(F.lit("event-"), "n")))
    rows = rows.withColumn("pos", F.col("n").cast("long"))
    return fullest_candidates(_candidate(rows, anchor, F.col("title"), _linked_pdfs("url", "absolute"), "html_heading_block", F.substring("text", 1, BLOCK_TEXT), STRUCTURE)).drop("place")


def table_candidates(documents: DataFrame, label: str = "名称") -> DataFrame:
    """A candidate for each event table whose named cell is an event's title."""
    rows = _with_absolute_links(documents.select("key", "url").join(parse.page_tables(documents, "key"), "key")).withColumn("title", parse.value_after(F.col("cells"), label))
    rows = rows.filter(text.is_title_hint(F.col("title"))).withColumn("pos", F.col("n").cast("long"))
    return fullest_candidates(_candidate(rows, F.concat("url", F.lit("#event-"), "n"), F.col("title"), _linked_pdfs("url", "absolute"), "html_event_table", F.substring("text", 1, BLOCK_TEXT), STRUCTURE)).drop("place")


def feed_candidates(documents: DataFrame) -> DataFrame:
    """A candidate for each item of a feed that is about an event."""
    rows = parse.feed_items(documents, "key", also=("url",)).filter(text.is_event_like(F.concat_ws(" ", "title", "description")))
    rows = rows.withColumns({"pos": F.col("place").cast("long"), "link": parse.joined_url("url", "link")})
    return _candidate(rows, F.col("link"), F.col("title"), F.array().cast("array<string>"), "rss", F.substring("description", 1, FEED_TEXT), FEED, F.col("published_at"))


def site_candidates(documents: DataFrame, settings: DataFrame) -> DataFrame:
    """Candidates of all pages by their site's settings: structure where it yields any, else links. ``documents`` has key, url, html, body, adapter and content_type."""
    kinds = documents.join(settings.select("adapter", "structure"), "adapter")
    readable = kinds.filter(held_for_rendering(F.col("html")).isNull())
    feed = F.coalesce(F.contains("content_type", F.lit("rss")) | F.col("body").rlike(r"^\s*<\?xml"), F.lit(False))
    structural = heading_candidates(readable.filter("structure = 'headings'")).unionByName(table_candidates(readable.filter("structure = 'tables'"))).unionByName(feed_candidates(readable.filter(feed)))
    rest = readable.filter(~feed).join(structural.select("key").distinct(), "key", "left_anti")
    return structural.unionByName(link_candidates(rest, settings))


def enrich(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates with what their detail page says, where that page is among ``documents`` (by URL without fragment): title, text, PDFs, fields found by rules, and a confidence of ENRICHED at least."""
    shown = parse.page_text(documents.filter("html <> ''"), "key").select("key", F.col("title").alias("page_title"), F.col("body").alias("page_body"))
    links = resolved_links(documents).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link_url"))), lambda x: x["link_url"]).alias("page_links"))
    pages = documents.select("key", urls.without_fragment(F.col("url")).alias("base")).join(shown, "key").join(links, "key", "left").drop("key")
    pages = pages.groupBy("base").agg(F.any_value(F.struct("page_title", "page_body", "page_links")).alias("p"))
    met = candidates.withColumn("base", urls.without_fragment(F.col("detail_url"))).join(pages, "base", "left").drop("base")
    found, none = F.col("p").isNotNull(), F.array().cast("array<string>")
    listed = F.coalesce("p.page_links", none)
    columns = {
        "title_hint": F.when(found & (F.col("p.page_title") != "") & text.is_event_like(F.col("p.page_title")), F.col("p.page_title")).otherwise(F.col("title_hint")),
        "pdf_urls": F.array_distinct(F.concat("pdf_urls", F.filter(listed, text.is_pdf_url))),
        "block_text": F.when(found, F.substring("p.page_body", 1, BLOCK_TEXT)).otherwise(F.col("block_text")),
        "confidence_hint": F.when(found, F.greatest("confidence_hint", F.lit(ENRICHED))).otherwise(F.col("confidence_hint")),
        "extracted_fields": F.when(found, rules.extract(F.col("p.page_body"), F.array_distinct(listed))),
    }
    return met.withColumns(columns).drop("p")
