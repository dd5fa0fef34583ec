"""More queries over the supplied tables: rules, parsers, duplicates, sources and administration. Texts, pages and edits are made from the tables' rows by plain expressions that the SQL repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import codes, rules, text, urls
from ..operators import admin, chunks, collect, extraction, review, rows, site
from ..sources import pages as parse
from ..sources import tables
from . import queries as base
from . import site as static
from .queries import LINES, NOW, QUALITY, iso, query, t


def words(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def key() -> Column:
    return F.col("o_orderkey")


DAY = "(2020 + o_orderkey % 10) || '年' || (o_orderkey % 12 + 1) || '月' || (o_orderkey % 28 + 1) || '日'"
STAMP = "(2020 + o_orderkey % 10) || '-' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') || 'T'"


@query(f"""SELECT o_orderkey, {STAMP} || CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':30' ELSE '00:00' END || ':00+09:00' AS event_start, CASE WHEN o_orderkey % 2 = 0 THEN 0.92 ELSE 0.85 END::DOUBLE AS start_confidence,
  CASE WHEN o_orderkey % 3 = 0 THEN '無料' ELSE o_orderkey || '円' END AS fee_text, CASE WHEN o_orderkey % 3 = 0 THEN '無料' ELSE '有料' END AS fee_category, (o_orderkey % 100) || '名' AS capacity_text,
  CASE WHEN o_orderkey % 5 <> 0 THEN {STAMP} || '23:59:00+09:00' END AS application_deadline_at, CASE WHEN o_orderkey % 5 <> 0 THEN {DAY} END AS application_deadline_text, CASE WHEN o_orderkey % 4 = 0 THEN 'https://a.example/' || o_orderkey END AS application_url FROM orders""")
def rule_fields(spark, sf_dir):
    day = words(2020 + key() % 10, "年", key() % 12 + 1, "月", key() % 28 + 1, "日")
    clock = F.when(key() % 2 == 0, words(" ", key() % 24, ":30")).otherwise(F.lit(""))
    fee = F.when(key() % 3 == 0, F.lit("無料")).otherwise(words(key(), "円"))
    closing = F.when(key() % 5 != 0, words("申込締切：", day, "\n")).otherwise(F.lit(""))
    body = words("セミナー ", day, clock, "\n参加費：", fee, "\n定員：", key() % 100, "名\n", closing, "https://a.example/", key(), " まで")
    allowed = F.when(key() % 4 == 0, F.array(words("https://a.example/", key()))).otherwise(F.array(F.lit("https://b.example/")))
    found = t(spark, sf_dir, "orders").select("o_orderkey", rules.extract(body, allowed).alias("f"))
    value = lambda name: F.try_element_at("f", F.lit(name))["value"].alias(name)
    return found.select("o_orderkey", value("event_start"), F.col("f")["event_start"]["confidence"].alias("start_confidence"), *[value(x) for x in ("fee_text", "fee_category", "capacity_text", "application_deadline_at", "application_deadline_text", "application_url")])


TITLES = ["第1回セミナー", "求人", "採用セミナー", "イベント", "https://x.example/セミナー", "Annual Conference 2020", "一覧", "  ", "採用担当の方のための長い名前がついている特別な公開の研修会です。お申し込みはこちら"]


@query(f"""SELECT event_id, [true, false, false, false, true, true, false, false, true][event_id % 9 + 1] AS event_like, [true, false, false, false, false, true, false, false, true][event_id % 9 + 1] AS title_hint FROM events""")
def title_hints(spark, sf_dir):
    title = F.element_at(F.array(*[F.lit(x) for x in TITLES]), (F.col("event_id") % 9 + 1).cast("int"))
    e = t(spark, sf_dir, "events").select("event_id", title.alias("title"))
    return e.select("event_id", text.is_event_like(F.col("title")).alias("event_like"), text.is_title_hint(F.col("title")).alias("title_hint"))


# The similarity of a run of a letters to a run of b of them is 2 min(a, b) / (a + b).
RATIO = "2.0 * least(o_orderkey % 20 + 1, o_orderkey % 13 + 1) / (o_orderkey % 20 + o_orderkey % 13 + 2)"
TOTAL = f"round_even(0.40 * ({RATIO})::DOUBLE + 0.25 * (CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 ELSE 0.0 END)::DOUBLE + 0.15 * (CASE WHEN o_orderkey % 7 < 4 THEN 1 ELSE 0 END) + 0.15 * (CASE WHEN o_orderkey % 4 < 3 THEN 1 ELSE 0 END) + 0.05 * (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END), 4)"


@query(f"""SELECT o_orderkey, round_even(({RATIO})::DOUBLE, 4) AS title_score, (CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 ELSE 0.0 END)::DOUBLE AS date_score, (CASE WHEN o_orderkey % 7 < 4 THEN 1.0 ELSE 0.0 END)::DOUBLE AS organizer_score,
  ['official_url', 'application_url', 'pdf_hash', ''][o_orderkey % 4 + 1] AS deterministic_anchor, (CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS format_score, {TOTAL} AS total_score,
  CASE WHEN {TOTAL} >= 0.85 AND o_orderkey % 4 < 3 THEN 'auto_merge_candidate' WHEN {TOTAL} >= 0.65 THEN 'review' ELSE 'separate' END AS disposition FROM orders""")
def duplicate_scores(spark, sf_dir):
    listed = lambda c: F.array(c)
    same = lambda n, side, one: listed(F.when(key() % 4 == n, F.lit(one)).otherwise(words(one, side)))

    def event(side: str, letters, day, organizer, form):
        return F.struct(
            words(key(), side).alias("event_id"), F.repeat(F.lit("a"), letters.cast("int")).alias("title"), day.alias("event_start_at"), organizer.alias("organizer_name"), form.alias("event_format"),
            same(0, side, "https://o.example/p").alias("official_urls"), same(1, side, "https://a.example/p").alias("application_urls"), same(2, side, "AB").alias("pdf_hashes"),
        ).alias(side)

    day = F.lit("2000-01-02T10:00:00+09:00")
    other = F.when(key() % 3 == 0, day).when(key() % 3 == 1, F.lit("2000-01-03T10:00:00+09:00")).otherwise(F.lit("2000-02-01T10:00:00+09:00"))
    pairs = t(spark, sf_dir, "orders").select(
        event("a", key() % 20 + 1, day, F.lit("技士会"), F.lit("Web")), event("b", key() % 13 + 1, other, F.when(key() % 7 < 4, F.lit("一般社団法人 技士会")).otherwise(F.lit("xyz")), F.when(key() % 2 == 0, F.lit("Web")).otherwise(F.lit("現地開催")))
    )
    found = review.assess_pairs(pairs)
    return found.select(F.regexp_replace("event_id_a", "a$", "").cast("long").alias("o_orderkey"), "title_score", "date_score", "organizer_score", "deterministic_anchor", "format_score", "total_score", "disposition")


def made_pages(spark, sf_dir, html):
    return t(spark, sf_dir, "orders").select(key().alias("key"), words("https://x.example/news.html#top").alias("url"), html.alias("html"), html.alias("body"))


@query("""SELECT o_orderkey AS key, 'https://x.example/news.html#' || CASE WHEN o_orderkey % 2 = 0 THEN 'e' || o_orderkey ELSE 'event-1' END AS detail_url, '第' || o_orderkey || '回セミナー' AS title_hint, 'https://x.example/f' || o_orderkey || '.pdf' AS pdf, 'html_heading_block' AS discovery_method, 0.85::DOUBLE AS confidence_hint FROM orders WHERE o_orderkey % 5 <> 0""")
def heading_candidates(spark, sf_dir):
    start = F.when(key() % 2 == 0, words('<h3 id="e', key(), '">')).otherwise(F.lit("<h3>"))
    title = F.when(key() % 5 == 0, F.lit("お知らせ")).otherwise(words("第", key(), "回セミナー"))
    found = collect.heading_candidates(made_pages(spark, sf_dir, words("<html><body>", start, title, "</h3><p>本文 &amp; 場所</p><a href='/f", key(), ".pdf'>資料</a></body></html>")))
    return found.select("key", "detail_url", "title_hint", F.get("pdf_urls", F.lit(0)).alias("pdf"), "discovery_method", "confidence_hint")


@query("""SELECT o_orderkey AS key, 'https://x.example/news.html#top#event-1' AS detail_url, '第' || o_orderkey || '回研修会' AS title_hint, 'html_event_table' AS discovery_method FROM orders WHERE o_orderkey % 3 <> 0""")
def table_candidates(spark, sf_dir):
    title = F.when(key() % 3 == 0, F.lit("総会")).otherwise(words("第", key(), "回研修会"))
    return collect.table_candidates(made_pages(spark, sf_dir, words("<table class='x event'><tr><th>名称</th><td>", title, "</td></tr><tr><th>会場</th><td>x</td></tr></table>"))).select("key", "detail_url", "title_hint", "discovery_method")


@query("""SELECT o_orderkey AS key, 'https://x.example/p' || o_orderkey AS detail_url, 'セミナー ' || o_orderkey AS title_hint, 'text ' || o_orderkey AS block_text, CASE WHEN o_orderkey % 2 = 0 THEN 'Mon, 01 Jan 2024' END AS published_at FROM orders""")
def feed_candidates(spark, sf_dir):
    date = F.when(key() % 2 == 0, F.lit("<pubDate>Mon, 01 Jan 2024</pubDate>")).otherwise(F.lit(""))
    body = words("<?xml version='1.0'?><rss><channel><item><title> セミナー  ", key(), "</title><link>/p", key(), "</link><description>text ", key(), "</description>", date, "</item><item><title>求人</title><link>/j</link></item><item><title>セミナー</title></item></channel></rss>")
    return collect.feed_candidates(made_pages(spark, sf_dir, body)).select("key", "detail_url", "title_hint", "block_text", "published_at")


@query("""SELECT o_orderkey AS key, CAST(p AS INTEGER) AS place, 'http://new.example/p' || (o_orderkey + p) || '?q=' || p AS url FROM orders, (VALUES (0), (1)) v(p)""")
def sitemap_pages(spark, sf_dir):
    loc = lambda n: words("<url><loc> http://old.example/p", key() + n, f"?q={n} </loc></url>")
    return collect.sitemap_pages(made_pages(spark, sf_dir, words("<urlset>", loc(0), loc(1), loc(0), "</urlset>")), "new.example")


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'https://x.example/event/' || o_orderkey ELSE 'https://x.example/news.html#top' END AS detail_url, '第' || o_orderkey || '回研修' AS title_hint, CASE WHEN o_orderkey % 2 = 0 THEN 'html' ELSE 'html_pdf' END AS discovery_method FROM orders WHERE o_orderkey % 3 <> 0""")
def link_candidates(spark, sf_dir):
    href = F.when(key() % 3 == 0, words("/other/", key())).when(key() % 2 == 0, words("/event/", key())).otherwise(words("/f/", key(), ".PDF?x=1"))
    pages = made_pages(spark, sf_dir, words("<a href='", href, "'>第", key(), "回研修</a><a href='#x'>セミナー</a><a href='/event/9'>一覧</a>")).withColumn("adapter", F.lit("fukuoka"))
    return collect.link_candidates(pages, collect.sites(spark)).select("key", "detail_url", "title_hint", "discovery_method")


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'CLIENT_RENDER_REQUIRED' END AS held FROM orders""")
def rendered_holds(spark, sf_dir):
    html = F.when(key() % 2 == 0, F.lit('<div id="__nuxt">Loading...</div>')).when(key() % 3 == 0, F.lit("Loading...")).otherwise(F.lit('<div id="__nuxt">x</div>'))
    return made_pages(spark, sf_dir, html).select("key", collect.held_for_rendering(F.col("html")).alias("held"))


@query("SELECT doc_id, text AS decoded FROM documents")
def decoded_texts(spark, sf_dir):
    k = F.col("doc_id")
    kind = F.when(k % 3 == 0, F.lit("text/html; charset=UTF-8")).when(k % 3 == 1, F.lit("text/html")).otherwise(F.lit(None))
    d = t(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"), kind.alias("kind"), F.when(k % 3 == 2, F.lit("utf-8")).otherwise(F.lit("auto")).alias("named"))
    return d.select("doc_id", parse.decoded("body", "kind", "named").alias("decoded"))


OCR = f"SELECT doc_id, {QUALITY} AS quality, length(text) < 30 OR {QUALITY} < 0.35 AS needs FROM (SELECT doc_id, {LINES} AS text FROM documents)"


@query(f"""SELECT doc_id AS doc, CASE WHEN needs AND quality < 1 THEN 'ocr' ELSE 'text_layer' END AS method, CASE WHEN needs AND quality < 1 THEN 1.0 ELSE quality END AS quality, needs AND quality >= 1 AS needs_ocr FROM ({OCR})""")
def ocr_pages(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    pages = chunks.page_quality(d.select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "text"))
    read = d.select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.repeat(F.lit("good text "), F.lit(20)).alias("ocr_text"))
    return chunks.with_ocr(pages, read).select("doc", "method", "quality", "needs_ocr")


@query(f"SELECT doc_id AS doc, {QUALITY} AS mean_quality FROM (SELECT doc_id, {LINES} AS text FROM documents)")
def document_mean_quality(spark, sf_dir):
    paged = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.array(F.lit(1), F.lit(2))).alias("page"), "text")
    return chunks.document_quality(chunks.page_quality(paged)).select("doc", F.col("quality").alias("mean_quality"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'INVALID_PDF_SIGNATURE' WHEN doc_id % 4 = 0 THEN 'INVALID_PDF_MIME' END AS error FROM documents""")
def pdf_guards(spark, sf_dir):
    k = F.col("doc_id")
    data = F.concat(F.when(k % 3 == 0, F.lit("x%PDF-")).otherwise(F.lit("%PDF-1.7 ")), F.coalesce("text", F.lit(""))).cast("binary")
    mime = F.when(k % 4 == 0, F.lit("text/html")).when(k % 4 == 1, F.lit(" Application/PDF ; x=1")).otherwise(F.lit("application/octet-stream"))
    return t(spark, sf_dir, "documents").select("doc_id", chunks.file_error(data, mime).alias("error"))


@query("""SELECT s_suppkey AS source_id, array_to_string(list_sort(['www.s' || s_suppkey || '.example', 's' || s_suppkey || '.example', 't' || s_suppkey || '.example', 'www.t' || s_suppkey || '.example']), ',') AS allowed_hosts,
  CASE WHEN s_suppkey % 2 = 0 THEN '/a,/b' ELSE '/' END AS prefixes, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'event-indexing/0.1 (one scheduled run a day)' END AS user_agent, s_suppkey % 5 <> 0 AS runs, CASE WHEN s_suppkey % 5 = 0 THEN 'disabled' END AS status FROM supplier""")
def source_gate(spark, sf_dir):
    k = F.col("s_suppkey")
    s = t(spark, sf_dir, "supplier").select(
        k.alias("source_id"), words("https://www.s", k, ".example/").alias("base_url"), words("https://s", k, ".example/a\r\nhttps://t", k, ".example/b").alias("discovery_urls"), F.when(k % 2 == 0, F.lit("/a\n/b")).alias("allowed_path_prefixes"),
        F.when(k % 3 == 0, F.col("s_name")).otherwise(F.lit(" ")).alias("user_agent"), F.when(k % 5 == 0, F.when(k % 2 == 0, F.lit(False))).otherwise(F.lit(True)).alias("enabled"),
    )
    return collect.gated(tables.source_configs(s)).select("source_id", F.array_join("allowed_hosts", ",").alias("allowed_hosts"), F.array_join("allowed_path_prefixes", ",").alias("prefixes"), "user_agent", "runs", "status")


@query(f"""SELECT event_id, title, format, '' AS summary, publication_status, CASE WHEN ee IS NULL THEN '9999' ELSE ee END AS sort_key, CAST(41 AS INTEGER) AS n_columns FROM ({base.ORDER_EVENTS})""")
def admin_events(spark, sf_dir):
    seen = admin.shown(base.order_events(spark, sf_dir))
    return seen.select("event_id", "title", "format", "summary", "publication_status", "sort_key", F.lit(len(seen.columns)).alias("n_columns"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'not editable: event_id' WHEN 1 THEN 'not editable: timezone' WHEN 2 THEN 'invalid value: format' WHEN 3 THEN 'invalid value: primary_official_url' END AS error FROM events""")
def admin_edit_errors(spark, sf_dir):
    k = F.col("event_id")
    cell = lambda name, value: F.create_map(F.lit(name), F.lit(value))
    cells = F.when(k % 6 == 0, cell("event_id", "x")).when(k % 6 == 1, cell("timezone", "x")).when(k % 6 == 2, cell("format", "x")).when(k % 6 == 3, cell("primary_official_url", "ftp://x")).when(k % 6 == 4, cell("last_verified_at", "x")).otherwise(cell("review_reason_display", ""))
    return t(spark, sf_dir, "events").select("event_id", cells.alias("cells")).select("event_id", admin.edit_error().alias("error"))


@query("""SELECT c_custkey AS event_id, 'admin_edit' AS action, '' AS review_id, '次回も確認' AS automation_choice, 'me' AS actor, CASE WHEN c_custkey % 2 = 0 THEN '管理画面から更新' ELSE 'n' END AS note, 'new ' || c_custkey AS title_after, c_name AS title_before FROM customer WHERE c_custkey % 3 <> 0""")
def admin_audit(spark, sf_dir):
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer")
    events = c.select(k.alias("event_id"), F.col("c_name").alias("title"), F.lit("1").alias("updated_at"))
    edits = c.select(k.alias("event_id"), k.alias("pos"), F.create_map(F.lit("title"), words(" new ", k)).alias("cells"), F.when(k % 3 == 0, F.lit("0")).otherwise(F.lit("1")).alias("expected_updated_at"), F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("n")).alias("note"))
    actions = admin.edit_actions(events, edits, "me", NOW)
    title = lambda c: F.get_json_object(c, "$.title")
    return actions.select("event_id", "action", "review_id", "automation_choice", "actor", "note", title("after_json").alias("title_after"), title("before_json").alias("title_before"))


@query(r"""SELECT doc_id, len(l) AS n, coalesce(l[1], '') AS first_value FROM (SELECT doc_id, [trim(x) FOR x IN regexp_split_to_array(coalesce(text, ''), '[\r\n,]+') IF trim(x) <> ''] AS l FROM documents)""")
def admin_values(spark, sf_dir):
    values = t(spark, sf_dir, "documents").select("doc_id", text.split_admin_value(F.col("text")).alias("l"))
    return values.select("doc_id", F.size("l").cast("long").alias("n"), F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("first_value"))


@query("""SELECT event_id, CASE WHEN event_id % 6 IN (2, 4, 5) THEN 'not a decision of the dashboard' WHEN event_id % 4 = 0 THEN 'already decided' WHEN event_id % 10 = 0 THEN 'actor is required' END AS error,
  CASE WHEN event_id % 6 NOT IN (2, 4, 5) AND event_id % 4 <> 0 AND event_id % 10 <> 0 THEN '次回も確認' END AS automation_choice, CASE WHEN event_id % 6 NOT IN (2, 4, 5) AND event_id % 4 <> 0 AND event_id % 10 <> 0 THEN CASE WHEN event_id % 6 = 3 THEN '非公開' ELSE '公開' END END AS publication_status, true AS no_rule FROM events""")
def quick_decisions(spark, sf_dir):
    asked = base.decisions(spark, sf_dir).withColumn("settled", F.when(F.col("event_id").cast("long") % 4 == 0, F.lit("公開")).otherwise(F.lit("未判断")))
    d = admin.decide_quick(asked)
    return d.select(F.col("event_id").cast("long").alias("event_id"), "error", F.col("action.automation_choice").alias("automation_choice"), F.try_element_at("after", F.lit("publication_status")).alias("publication_status"), F.col("rule").isNull().alias("no_rule"))


@query("""SELECT doc_id, sha256(replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM documents""")
def html_escaped(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(static.escaped(F.col("text")), 256).alias("escaped"))


@query("""SELECT p_partkey, CASE WHEN n < 1 THEN NULL WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER)) WHEN n <= 702 THEN chr(CAST(65 + (n - 27) // 26 AS INTEGER)) || chr(CAST(65 + (n - 27) % 26 AS INTEGER)) WHEN n <= 18278 THEN chr(CAST(65 + (n - 703) // 676 AS INTEGER)) || chr(CAST(65 + (n - 703) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (n - 703) % 26 AS INTEGER)) END AS letters FROM (SELECT p_partkey, p_partkey * 3 AS n FROM part)""")
def column_letters(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", codes.column_letter(F.col("p_partkey") * 3).alias("letters"))


@query("""SELECT c_custkey AS event_id FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 5 <> 0""")
def stale_edits(spark, sf_dir):
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer")
    now = c.select(k.alias("event_id"), F.when(k % 5 != 0, F.lit("v2")).alias("updated_at"))
    return rows.stale_rows(now, c.select(k.alias("event_id"), F.when(k % 3 == 1, F.lit("v1")).when(k % 3 == 2, F.lit("v2")).otherwise(F.lit("")).alias("expected_updated_at"))).select("event_id")


@query("SELECT doc_id AS review_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def undecided_reviews(spark, sf_dir):
    return review.undecided(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id")), t(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id")))


@query("""SELECT event_id, sha256('{"model":"m","prompt_version":"1","provider":"p","request":{"source_id":"' || event_type || '","source_url":"https://x.example/' || event_id || '"}}') AS cache_key,
  'untrusted source data: {"source_id":"' || event_type || '","source_url":"u","candidate_text":"say \\"' || event_id || '\\"","allowed_urls":["u"]}' AS message FROM events""")
def requests_asked(spark, sf_dir):
    k = F.col("event_id")
    e = t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source_id"), F.lit("u").alias("source_url"), words('say "', k, '"').alias("candidate_text"), F.array(F.lit("u")).alias("allowed_urls"))
    key = codes.cache_key(F.struct("source_id", words("https://x.example/", k).alias("source_url")), "p", "m", "1")
    return extraction.prompt(e, "find").select("event_id", key.alias("cache_key"), F.col("messages")[1]["content"].alias("message"))


@query(f"""SELECT event_id, NOT contains(lower(o_orderpriority), 'med') AS pdf_hit FROM (SELECT CAST(o_orderkey AS VARCHAR) AS event_id, o_orderkey, o_orderpriority FROM orders) WHERE contains(lower(o_orderpriority), 'med') OR o_orderkey % 2 = 0""")
def facet_pdf_hits(spark, sf_dir):
    events = base.order_events(spark, sf_dir).withColumn("pdf_search_hashes", F.when(F.col("event_id").cast("long") % 2 == 0, codes.gram_hashes(F.lit("medium"))))
    return site.faceted(events, NOW, "med").select("event_id", "pdf_hit")


@query("SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority || '|x' AS tags FROM orders")
def three_tags(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(site.first_tags(F.array("o_orderstatus", "o_orderpriority", F.lit("x"), F.lit("y"))), "|").alias("tags"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN event_type WHEN 2 THEN 'true' END AS value, event_id % 3 <> 0 AS accepted, CAST(0 AS INTEGER) AS pos FROM events""")
def exchanged_values(spark, sf_dir):
    k = F.col("event_id")
    value = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, words('"', F.col("event_type"), '"')).when(k % 4 == 2, F.lit("true")).otherwise(F.lit("null"))
    accepted = F.when(k % 3 == 0, F.lit(',"accepted":false')).otherwise(F.lit(""))
    body = words('{"events":[{"event_id":"', k, '","auto_values":[{"field_name":"f","value":', value, ',"confidence":0.5', accepted, "}]}]}")
    found = tables.automatic_values(tables.records_of(t(spark, sf_dir, "events").select(body.alias("value"))))
    return found.select(F.col("event_id").cast("long").alias("event_id"), "value", "accepted", F.col("pos").cast("int").alias("pos"))


@query("""SELECT l.doc_id AS review_id, d.source AS title FROM labels l JOIN documents d USING (doc_id)""")
def reviews_matched(spark, sf_dir):
    reviews = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"), F.col("doc_id").alias("event_id"))
    return admin.matched(reviews, t(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("source").alias("title"))).select("review_id", "title")


@query("""SELECT page_id, lower(regexp_extract(url, '^([^:/]*)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '(\\?[^#]*)', 1) AS safe FROM pages WHERE url IS NOT NULL""")
def safe_urls(spark, sf_dir):
    return t(spark, sf_dir, "pages").filter("url is not null").select("page_id", urls.safe_form(F.col("url")).alias("safe"))
