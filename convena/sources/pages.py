"""What pages hold: links, text, heading blocks, event tables, feeds and sitemaps.

HTML is read by the standard library's parser, once per page, into a flat list of tags and texts; each reader below is one walk over that list. Pages come in Arrow
batches and rows go out one for each thing found, so nothing but a page is held at a time. Feeds and sitemaps are XML and stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import normalize_space

HIDDEN = {"script", "style", "noscript", "svg"}
#: Attributes of an element whose values hold no markup.
ATTRIBUTES = r'(?:\s+[A-Za-z][\w.:-]*="[^"<>&]*")*\s*'
#: Aliases of an encoding that stand for its larger superset.
SUPERSETS = {"shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "cp932": "cp932"}


class _Flat(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, dict[str, str]]] = []

    def handle_starttag(self, tag, attrs):
        self.found.append(("open", tag.lower(), {k.lower(): v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.found.append(("close", tag.lower(), {}))

    def handle_data(self, data):
        self.found.append(("text", data, {}))


def _flat(html: str) -> list[tuple[str, str, dict[str, str]]]:
    parser = _Flat()
    parser.feed(html or "")
    parser.close()
    return parser.found


def _clean(parts: Iterable[str]) -> str:
    return re.sub(r"\s+", " ", " ".join(parts)).strip()


def links(html: str) -> list[dict]:
    """Anchors in order; one inside another belongs to the outer, one that is never closed is dropped."""
    out, at = [], None
    for kind, value, attrs in _flat(html):
        if kind == "open" and value == "a" and at is None:
            at = {"href": attrs.get("href", ""), "title": _clean([attrs.get("title", "")]), "parts": []}
        elif kind == "text" and at is not None:
            at["parts"].append(value)
        elif kind == "close" and value == "a" and at is not None:
            out.append({"href": at["href"], "text": _clean(at["parts"]), "title": at["title"]})
            at = None
    return out


def text(html: str, references: tuple[str, ...] | None = None) -> dict:
    """Title and body without what isn't shown; the title is the first three texts of h1 and h2, else the page's own. Given ``references``, only character references of these names that a semicolon closes are resolved."""
    if references:
        html = re.sub(rf"&(?!(?:{'|'.join(references)});)", "&amp;", html)
    depth = dict.fromkeys(("hidden", "title", "heading"), 0)
    zone = lambda tag: "hidden" if tag in HIDDEN else "title" if tag == "title" else "heading" if tag in ("h1", "h2") else None
    body, titles, headings = [], [], []
    for kind, value, _ in _flat(html):
        if kind == "text":
            shown = _clean([value])
            if shown and not depth["hidden"]:
                body.append(shown)
                titles += [shown] * bool(depth["title"])
                headings += [shown] * bool(depth["heading"])
        elif where := zone(value):
            depth[where] = max(depth[where] + (1 if kind == "open" else -1), 0)
    return {"title": _clean(headings[:3]) or _clean(titles), "body": _clean(body)}


def _followed(href: str) -> bool:
    return bool(href) and not href.startswith(("mailto:", "javascript:"))


def heading_blocks(html: str) -> list[dict]:
    """Each h3 with what follows until the next one."""
    blocks: list[dict] = []
    inside = False
    for kind, value, attrs in _flat(html):
        if kind == "open" and value == "h3":
            blocks.append({"id": attrs.get("id", ""), "title": [], "text": [], "links": []})
            inside = True
        elif not blocks:
            continue
        elif kind == "open" and value == "a" and _followed(attrs.get("href", "")):
            blocks[-1]["links"].append(attrs["href"])
        elif kind == "close" and value == "h3":
            inside = False
        elif kind == "text" and (shown := _clean([value])):
            blocks[-1]["text"].append(shown)
            blocks[-1]["title"] += [shown] * inside
    return [{"n": i, "id": b["id"], "title": _clean(b["title"]), "text": _clean(b["text"]), "links": b["links"]} for i, b in enumerate(blocks, 1)]


def event_tables(html: str) -> list[dict]:
    """Tables of class ``event``; a table inside one belongs to it. Cells are (th or td, text)."""
    out, depth = [], 0
    cells: list[list] = []
    texts: list[str] = []
    hrefs: list[str] = []
    open_cell = None
    for kind, value, attrs in _flat(html):
        if kind == "open" and value == "table" and (depth or "event" in attrs.get("class", "").lower().split()):
            depth += 1
        elif not depth:
            continue
        elif kind != "text" and value in ("th", "td"):
            open_cell = None
            if kind == "open":
                open_cell = [value, []]
                cells.append(open_cell)
        elif kind == "open" and value == "a" and _followed(attrs.get("href", "")):
            hrefs.append(attrs["href"])
        elif kind == "close" and value == "table":
            depth -= 1
            if not depth:
                out.append({"n": len(out) + 1, "cells": [{"kind": k, "text": _clean(p)} for k, p in cells], "text": _clean(texts), "links": hrefs})
                cells, texts, hrefs, open_cell = [], [], [], None
        elif kind == "text" and (shown := _clean([value])):
            texts.append(shown)
            if open_cell:
                open_cell[1].append(shown)
    return out


LINK = "href string, text string, title string"
TEXT = "title string, body string"
BLOCK = "n int, id string, title string, text string, links array<string>"
TABLE = "n int, cells array<struct<kind:string,text:string>>, text string, links array<string>"


def _each(pages: DataFrame, key: str, html: str, read: Callable[[str], list[dict]], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"_key": k, "place": i, **row} for k, h in zip(b["_key"], b["_html"], strict=True) for i, row in enumerate([] if h is None else read(h))]
            names = ["_key", "place", *[c.split()[0] for c in schema.split(", ")]]
            yield pd.DataFrame(rows, columns=names)

    rows = pages.select(F.col(key).alias("_key"), F.col(html).alias("_html"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInPandas(run, f"_key {kind}, place int, {schema}").withColumnRenamed("_key", key)


def page_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, place, href, text, title) of each anchor."""
    return _each(pages, key, html, links, LINK)


def page_text(pages: DataFrame, key: str, html: str = "html", references: tuple[str, ...] | None = None) -> DataFrame:
    """(key, place, title, body), with ``references`` as in ``text``; a page whose HTML is null has no row."""
    return _each(pages, key, html, lambda h: [text(h, references)], TEXT)


@F.pandas_udf(StringType())
def page_title(html: pd.Series) -> pd.Series:
    """The whole title, as ``page_text`` gives it; null for a page without HTML."""
    return html.map(lambda h: text(h)["title"] if h else None)


def page_blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    return _each(pages, key, html, heading_blocks, BLOCK)


def page_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    return _each(pages, key, html, event_tables, TABLE)


def value_after(cells: Column, label: str) -> Column:
    """Text of the first td behind a th of this label and before the next th; empty if there is none."""
    at = F.filter(F.transform(cells, lambda c, i: F.when((c["kind"] == "th") & (c["text"] == label), i)), lambda i: i.isNotNull())
    follows = F.transform(at, lambda i: F.when(F.get(cells, i + 1)["kind"] == "td", F.get(cells, i + 1)["text"]))
    return F.coalesce(F.get(F.filter(follows, lambda x: x.isNotNull()), F.lit(0)), F.lit(""))


def feed_items(documents: DataFrame, key: str, body: str = "body", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns in ``also``, place, title, link, description, published_at) of each item with a link in an RSS feed."""
    # An item may lack a tag, so items are cut apart before their tags are read. Arrays are changed step by step before they are exploded, so that no step is repeated for each use of what it gives (nor, as "outer", for a check that there are any).
    # Most items hold nothing but elements of plain text, which need no XML parser (one run of it for each tag); all others go through it.
    plain = lambda x: F.regexp_replace(x, rf"<([A-Za-z][\w.:-]*){ATTRIBUTES}>[^<&]*</\1>", "").rlike(rf"^<item{ATTRIBUTES}>\s*</item>$")
    read = lambda x, tag: F.when(x["plain"], F.regexp_extract(x["item"], f"<{tag}{ATTRIBUTES}>([^<&]*)</{tag}>", 1)).otherwise(F.xpath_string(x["item"], F.lit(f"/item/{tag}")))
    one = lambda x, tag: normalize_space(F.coalesce(read(x, tag), F.lit("")))
    marked = F.transform(F.regexp_extract_all(F.col(body), F.lit(r"(?s)(<item[ >].*?</item>)"), F.lit(1)), lambda x: F.struct(x.alias("item"), plain(x).alias("plain")))
    items = F.transform(marked, lambda x: F.struct(*[one(x, tag).alias(name) for tag, name in (("title", "title"), ("link", "link"), ("description", "description"), ("pubDate", "published_at"))]))
    found = documents.select(F.col(key), *also, F.posexplode_outer(items).alias("place", "_item")).select(key, *also, "place", "_item.*")
    return found.filter("link <> ''").withColumn("published_at", F.when(F.col("published_at") != "", F.col("published_at")))


def sitemap_urls(body: Column) -> Column:
    """All ``loc`` texts, in any namespace, distinct in order."""
    return F.array_distinct(F.transform(F.xpath(body, F.lit("//*[local-name()='loc']/text()")), normalize_space))


def detect_encoding(body: bytes, content_type: str, configured: str) -> str:
    """The configured encoding, else the header's, else the mark at the start, else what the first 8 KiB declare, else UTF-8."""
    named = (configured or "").lower()
    if named not in ("", "auto"):
        return SUPERSETS.get(named, configured) if named != "sjis" else configured
    declared = re.search(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9._:-]+)", content_type or "", re.I)
    if not declared and body.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    declared = declared or re.search(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9._-]+)", body[:8192].decode("ascii", "ignore"), re.I)
    found = declared.group(1).lower() if declared else "utf-8"
    return SUPERSETS.get(found, found)


@F.pandas_udf(StringType())
def decoded(bodies: pd.Series, content_types: pd.Series, configured: pd.Series) -> pd.Series:
    """Bytes as text in their encoding; what it can't hold becomes U+FFFD, an unknown encoding reads as UTF-8."""

    def one(body: bytes, kind: str, named: str) -> str | None:
        if body is None:
            return None
        try:
            return bytes(body).decode(detect_encoding(bytes(body), kind, named), "replace")
        except LookupError:
            return bytes(body).decode("utf-8", "replace")

    return pd.Series([one(*x) for x in zip(bodies, content_types, configured, strict=True)], dtype="object")


@F.pandas_udf(StringType())
def joined_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """A link's URL, relative to its page's."""
    from urllib.parse import urljoin

    def one(b: str | None, h: str | None) -> str | None:
        try:
            return urljoin(b or "", h) if h is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype="object")
