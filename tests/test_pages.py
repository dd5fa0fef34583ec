import hashlib

from pyspark.sql import functions as F

from convena.operators import collect
from convena.sources import http, pages
from convena.streaming import changes

LINKS = '<a href="/event/1/" title="x">呼吸 <b>セミナー</b></a><a href="#t">z</a><a href="/event/tag/2/">学会大会の案内</a><a href="/f.pdf?v=1">研修会 資料</a><a href="mailto:a@b">m</a><a href="/open">未完'


def documents(spark, rows):
    return spark.createDataFrame([(k, "https://a.example/list", h, h, a, c) for k, h, a, c in rows], "key string, url string, html string, body string, adapter string, content_type string")


def test_links():
    assert pages.links('<a href="x">a<a href="y">b</a></a>') == [{"href": "x", "text": "a b", "title": ""}]
    assert pages.links(None) == []


def test_text_skips_what_is_hidden():
    assert pages.text("<title>T</title><script>s</script><h1>A <i>B</i></h1><svg>v</svg><p>c&amp;d</p>") == {"title": "A B", "body": "T A B c&d"}
    assert pages.text("<title> T </title>x")["title"] == "T"


def test_heading_blocks():
    got = pages.heading_blocks('<p>no</p><h3 id="i">研修会</h3><a href="a.pdf">x</a><!-- <h3>no</h3> --><h3>B</h3>t')
    assert [(b["n"], b["id"], b["title"], b["text"], b["links"]) for b in got] == [(1, "i", "研修会", "研修会 x", ["a.pdf"]), (2, "", "B", "B t", [])]


def test_event_tables(spark):
    html = '<table class="x EVENT"><tr><th>名称</th><td>呼吸セミナー</td></tr><tr><th>場所<td><table><td>in</td></table><a href="p.pdf">q</a></table><table><td>no</td></table>'
    got = pages.event_tables(html)
    assert len(got) == 1 and got[0]["links"] == ["p.pdf"] and [c["kind"] for c in got[0]["cells"]] == ["th", "td", "th", "td", "td"]
    df = pages.page_tables(spark.createDataFrame([(1, html)], "k int, html string"), "k")
    assert df.select(pages.value_after(F.col("cells"), "名称")).first()[0] == "呼吸セミナー"
    assert df.select(pages.value_after(F.col("cells"), "無い")).first()[0] == ""


def test_link_candidates(spark):
    docs = documents(spark, [("k", LINKS, "fukuoka", "text/html")])
    got = {r["detail_url"]: (r["title_hint"], r["pdf_urls"], r["confidence_hint"]) for r in collect.site_candidates(docs, collect.sites(spark)).collect()}
    assert got == {"https://a.example/event/1/": ("呼吸 セミナー", [], 0.7), "https://a.example/list": ("研修会 資料", ["https://a.example/f.pdf?v=1"], 0.65)}
    found = collect.discovered_urls(docs, collect.sites(spark)).first()
    assert found["urls"] == ["https://a.example/event/1/"] and found["pdf_urls"] == ["https://a.example/f.pdf?v=1"]


def test_structure_comes_first_and_links_are_the_fallback(spark):
    docs = documents(spark, [("h", '<h3>お知らせ</h3><h3 id="q">研修会A</h3><a href="a.pdf">x</a><a href="#z">y</a>', "kumamoto", "text/html"), ("l", '<a href="/x">学会のご案内</a>', "kumamoto", "text/html"), ("t", '<table class="event"><tr><th>名称</th><td>講習会B</td></table>', "oita", ""), ("r", 'id="__nuxt" Loading... <a href="/notice">学会C</a>', "okinawa", "")])
    got = {(r["key"], r["detail_url"]): (r["title_hint"], r["discovery_method"], r["pdf_urls"]) for r in collect.site_candidates(docs, collect.sites(spark)).collect()}
    assert got == {("h", "https://a.example/list#q"): ("研修会A", "html_heading_block", ["https://a.example/a.pdf"]), ("l", "https://a.example/x"): ("学会のご案内", "html", []), ("t", "https://a.example/list#event-1"): ("講習会B", "html_event_table", [])}


FEED = "<?xml version='1.0'?><rss><channel><title>c</title><item><title>呼吸セミナー</title><link>/1</link><description>d</description><pubDate>p</pubDate></item><item><title>会費</title><link>/2</link></item><item><title>研修</title></item></channel></rss>"


def test_feed_and_sitemap(spark):
    docs = documents(spark, [("f", FEED, "miyazaki", "application/rss+xml")])
    got = collect.site_candidates(docs, collect.sites(spark)).collect()
    assert [(r["detail_url"], r["title_hint"], r["published_at"], r["confidence_hint"]) for r in got] == [("https://a.example/1", "呼吸セミナー", "p", 0.8)]
    xml = '<urlset xmlns="http://x"><url><loc> https://o.example/a </loc></url><url><loc>https://o.example/a</loc></url></urlset>'
    assert spark.range(1).select(pages.sitemap_urls(F.lit(xml))).first()[0] == ["https://o.example/a"]


def test_enrichment(spark):
    docs = documents(spark, [("d", '<h1>第2回 研修会</h1><p>2026年8月1日 13:00 定員：20名</p><a href="b.pdf">x</a>', "saga", "")])
    candidate = spark.createDataFrame([("https://a.example/list#x", "研修会", ["p"], "", 0.7), ("https://a.example/other", "研修会", [], "", 0.7)], "detail_url string, title_hint string, pdf_urls array<string>, block_text string, confidence_hint double")
    got = {r["detail_url"]: r for r in collect.enrich(candidate, docs).collect()}
    row = got["https://a.example/list#x"]
    assert row["title_hint"] == "第2回 研修会" and row["pdf_urls"] == ["p", "https://a.example/b.pdf"] and row["confidence_hint"] == 0.8
    assert row["extracted_fields"]["event_start"]["value"] == "2026-08-01T13:00:00+09:00" and "capacity_text" in row["extracted_fields"]
    assert got["https://a.example/other"]["extracted_fields"] is None


def test_encodings(spark):
    detect = pages.detect_encoding
    assert [detect(b"", "", "Shift_JIS"), detect(b"", "text/html; charset=SJIS", "auto"), detect(b"\xef\xbb\xbfx", "", ""), detect(b'<meta charset="EUC-JP">', "", ""), detect(b"", "", "")] == ["cp932", "cp932", "utf-8-sig", "euc-jp", "utf-8"]
    body = spark.createDataFrame([("研修①".encode("cp932"), "", "cp932"), (b"\xff", "", ""), (b"a", "text/html; charset=none", ""), (None, "", "")], "b binary, c string, e string")
    assert [r[0] for r in body.select(pages.decoded("b", "c", "e")).collect()] == ["研修①", "�", "a", None]


def test_fetching():
    script = {"https://a.example/r": (302, {"Location": "/x"}, b""), "https://a.example/x": (200, {"ETag": "e"}, b"body"), "https://a.example/m": (404, {}, b"")}
    get = lambda url, headers: script[url]
    run = lambda **k: http.fetch({"allowed_hosts": ["a.example"], **k}, get, sleep=lambda s: None)
    got = run(url="https://a.example/r")
    assert (got["outcome"], got["final_url"], got["body"], got["etag"]) == ("fetched", "https://a.example/x", b"body", "e")
    assert run(url="https://a.example/x", content_hash=hashlib.sha256(b"body").hexdigest())["outcome"] == "not_modified"
    assert run(url="https://a.example/m")["error_code"] == "HTTP_404"
    assert run(url="https://b.example/")["error_code"] == "HOST_NOT_ALLOWED"
    assert run(url="https://a.example/x", robots="User-agent: *\nDisallow: /x")["error_code"] == "ROBOTS"
    waits, answers = [], iter([(503, {"Retry-After": "999"}, b""), (503, {}, b""), (200, {}, b"ok")])
    assert http.fetch({"url": "https://a.example/"}, lambda u, h: next(answers), sleep=waits.append)["outcome"] == "fetched" and waits == [300.0, 2.0]
    assert http.interval({"interval_seconds": 10, "robots": "User-agent: *\nCrawl-delay: 60"}) == 60 and http.interval({"interval_seconds": 10}) == 10
    assert not http.is_public_address("10.0.0.1") and http.is_public_address("8.8.8.8")


def test_fetch_source(spark, tmp_path):
    import json

    (tmp_path / "canned_transport.py").write_text("def get(url, headers):\n    return 200, {'Content-Type': 'text/plain'}, url.encode()\n")
    spark.sparkContext.addPyFile(str(tmp_path / "canned_transport.py"))
    spark.dataSource.register(http.Fetches)
    requests = json.dumps([{"url": "https://a.example/1"}, {"url": "https://b.example/2"}])
    got = spark.read.format("fetches").options(transport="canned_transport:get", requests=requests).load().collect()
    assert sorted((r["outcome"], bytes(r["body"])) for r in got) == [("fetched", b"https://a.example/1"), ("fetched", b"https://b.example/2")]


def test_stream_of_changes(spark, tmp_path):
    for i, rows in enumerate(([("u", "1"), ("v", "1")], [("u", "1"), ("v", "2")])):
        spark.createDataFrame(rows, "url string, body string").coalesce(1).write.json(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema("url string, body string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = changes.changes(source).writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("changed").collect()
    assert sorted((r["url"], r["outcome"], r["body"]) for r in got if r["outcome"] == "fetched") == [("u", "fetched", "1"), ("v", "fetched", "1"), ("v", "fetched", "2")] and len(got) == 4


def test_stream_of_daily_counts(spark, tmp_path):
    spark.createDataFrame([("s", "2026-01-01 01:00:00"), ("s", "2026-01-01 23:00:00"), ("s", "2026-01-05 00:00:00")], "source_id string, ts string").select("source_id", F.to_timestamp("ts").alias("ts")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("source_id string, ts timestamp").parquet(str(tmp_path / "in"))
    query = changes.daily_counts(source).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["day"]["start"].day, r["n"]) for r in spark.table("daily").collect()) == [(1, 2), (5, 1)]
