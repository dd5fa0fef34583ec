import json

import pytest
from pyspark.sql import functions as F

from convena.operators import chunks, extraction, resolve, review, rows, site
from convena.plans import daily
from convena.sources import tables

JST = "+09:00"


def test_resolution(spark):
    auto = spark.createDataFrame([("e", "format", "Web", 0.95, "1", True, 0), ("e", "format", "現地", 0.70, "2", True, 1), ("e", "format", "ハイブリッド", 1.0, "3", False, 2), ("e", "fee", "", 0.5, "1", True, 3), ("e", "title", "auto", 1.0, "1", True, 4)], "event_id string, field_name string, value string, confidence double, extracted_at string, accepted boolean, pos int")
    over = spark.createDataFrame([("e", "title", "旧", True, "2026-01-01", 0), ("e", "title", "新", True, "2026-02-01", 1), ("e", "title", "無効", False, "2026-03-01", 2), ("e", "none", None, True, "2026-01-01", 3)], "event_id string, field_name string, value string, active boolean, updated_at string, pos int")
    fixed = spark.createDataFrame([("e", "place", "x"), ("e", "null", None)], "event_id string, field_name string, value string")
    wanted = spark.createDataFrame([("e", f) for f in ("format", "title", "none", "fee", "place", "null", "gone")], "event_id string, field_name string")
    got = {r["field_name"]: (r["value"], r["origin"], r["confidence"]) for r in resolve.resolve_fields(wanted, auto, over, fixed).collect()}
    assert got == {"format": ("Web", "auto", 0.95), "title": ("新", "override", None), "none": (None, "override", None), "fee": ("", "auto", 0.5), "place": ("x", "fixed", None), "null": (None, "fixed", None), "gone": (None, "missing", None)}


def test_ties_fall_to_the_first(spark):
    over = spark.createDataFrame([("e", "f", "a", True, "1", 5), ("e", "f", "b", True, "1", 2)], "event_id string, field_name string, value string, active boolean, updated_at string, pos int")
    assert resolve.best_override(over).first()["value"] == "b"


RECORDS = {
    "events": [
        {
            "event_id": "evt_1", "canonical_event_id": "evt_1", "publication_status": "公開", "review_status": "確認済み", "review_label": "なし", "duplicate_status": "重複なし",
            "fixed_values": {"organizer_name": "会", "format": "Web", "primary_official_url": "https://a.example/1", "genres": ["呼吸"], "has_on_demand": False, "pdf_search_terms": ["ECMO"]},
            "auto_values": [{"field_name": "title", "value": "auto", "confidence": 0.9, "extractor": "r", "extracted_at": "2026-01-01T00:00:00+09:00"}, {"field_name": "event_start_at", "value": "2026-08-01T13:00:00+09:00", "confidence": 0.9, "extractor": "r", "extracted_at": "2026-01-01T00:00:00+09:00"}],
            "overrides": [{"field_name": "title", "value": "override", "active": True, "updated_by": "a", "reason": "r", "updated_at": "2026-01-02T00:00:00+09:00"}],
        },
        {"event_id": "evt_2", "canonical_event_id": "evt_2", "publication_status": "確認待ち", "review_status": "未確認", "review_label": "あり", "duplicate_status": "重複なし", "fixed_values": {}},
        {"event_id": "evt_3", "canonical_event_id": "evt_1", "publication_status": "公開", "review_status": "確認済み", "review_label": "なし", "duplicate_status": "統合済み", "fixed_values": {}},
        {"event_id": "evt_4", "canonical_event_id": "evt_4", "publication_status": "公開", "review_status": "確認済み", "review_label": "なし", "duplicate_status": "重複なし", "fixed_values": {"title": "t"}},
    ]
}


@pytest.mark.parametrize("bare", [False, True])
def test_publication(spark, tmp_path, bare):
    path = tmp_path / "events.json"
    path.write_text(json.dumps(RECORDS["events"] if bare else RECORDS, ensure_ascii=False))
    document, errors = daily.published(spark, str(path), "2026-07-01T00:00:00+00:00")
    got = json.loads(document.first()["json"])
    assert got["schema_version"] == 1 and got["event_count"] == 1
    event = got["events"][0]
    assert (event["title"], event["detail_path"], event["genres"], event["has_on_demand"]) == ("override", "/events/evt_1/", ["呼吸"], False)
    assert "summary" not in event and len(event["pdf_search_hashes"]) == 5
    assert [(r["event_id"], r["error"]) for r in errors.collect()] == [("evt_4", "missing required public fields: format, organizer_name, primary_official_url")]


def test_fail_fast(spark, tmp_path):
    path = tmp_path / "events.json"
    path.write_text(json.dumps(RECORDS, ensure_ascii=False))
    document, _ = daily.published(spark, str(path), "2026-07-01T00:00:00+00:00", fail_fast=True)
    with pytest.raises(Exception, match="evt_4: missing required"):
        document.collect()


def snapshot(spark, **change):
    base = {"event_id": "a", "title": "第10回 呼吸セミナー", "event_start_at": "2026-08-01T10:00:00+09:00", "organizer_name": "会", "event_format": "Web", "official_urls": [], "application_urls": [], "pdf_hashes": []} | change
    return base


SNAPSHOT = "struct<event_id:string,title:string,event_start_at:string,organizer_name:string,event_format:string,official_urls:array<string>,application_urls:array<string>,pdf_hashes:array<string>>"


def assessed(spark, a, b):
    return review.assess_pairs(spark.createDataFrame([(a, b)], f"a {SNAPSHOT}, b {SNAPSHOT}")).first()


def test_equal_events_without_an_anchor_are_reviewed(spark):
    got = assessed(spark, snapshot(spark), snapshot(spark, event_id="b"))
    assert (got["total_score"], got["deterministic_anchor"], got["disposition"]) == (0.85, "", "review")


def test_a_trailing_slash_is_no_difference_for_an_anchor(spark):
    got = assessed(spark, snapshot(spark, official_urls=["https://a.example/x/"]), snapshot(spark, event_id="b", official_urls=["https://A.example/x"]))
    assert (got["total_score"], got["deterministic_anchor"], got["disposition"]) == (1.0, "official_url", "auto_merge_candidate")


def test_anchors_have_an_order(spark):
    got = assessed(spark, snapshot(spark, application_urls=["https://a.example/"], pdf_hashes=["AB"]), snapshot(spark, event_id="b", title="x", organizer_name=None, event_start_at=None, event_format=None, application_urls=["https://a.example"], pdf_hashes=["ab"]))
    assert (got["deterministic_anchor"], got["disposition"]) == ("application_url", "separate")


def test_pairs_share_a_key_and_come_once(spark):
    rows_ = spark.createDataFrame([("a", 1, ["k", "l"]), ("b", 2, ["k", "l"]), ("c", 3, ["m"]), ("d", 4, ["m", ""]), ("e", 5, [""]), ("b2", 2, ["k", "l"]), ("b3", 2, ["k", "l"])], "event_id string, n int, keys array<string>")
    got = review.candidate_pairs(rows_, F.col("keys")).select("a.event_id", "b.event_id").collect()
    assert sorted(map(tuple, got)) == [("a", "b"), ("b", "b2"), ("b", "b3"), ("c", "d")]


def test_routing(spark):
    now = "2026-07-01T00:00:00+00:00"
    kind = "event_id string, reason_codes array<string>, uncertain_fields array<string>, source_urls array<string>, source_excerpt string, event_start_at string, application_deadline_at string"
    items = spark.createDataFrame([
        ("urgent", ["FEE_UNKNOWN", "FEE_UNKNOWN"], ["fee_text"], ["u"], " a  b ", "2026-08-01 00:00:00", "2026-07-03 00:00:00"), ("edge", [], [], [], "", None, "2026-07-04 00:00:00"), ("changed", ["HIGH_IMPACT_FIELD_CHANGED"], [], [], "", "2026-08-01 00:00:00", "2026-07-20 00:00:00"),
        ("soon", ["DUPLICATE_CANDIDATE", "LOW_EVENT_CONFIDENCE"], [], [], "", "2026-07-08 00:00:00", None), ("past", ["LOW_EVENT_CONFIDENCE"], [], [], "", "2026-06-01 00:00:00", None), ("other", [], [], [], "", "2026-09-01 00:00:00", None),
    ], kind).withColumns({c: F.to_timestamp(c) for c in ("event_start_at", "application_deadline_at")})
    got = {r["event_id"]: (r["priority"], r["due_at"] and r["due_at"].isoformat()[:10], r["suggested_action"]) for r in review.route(items, now).collect()}
    assert got == {"urgent": ("緊急", "2026-07-03", "修正"), "edge": ("緊急", "2026-07-04", "要確認付き公開"), "changed": ("高", "2026-07-20", "要確認付き公開"), "soon": ("高", "2026-07-08", "統合"), "past": ("低", None, "非公開"), "other": ("通常", "2026-09-01", "要確認付き公開")}
    assert review.route(items, now).filter("event_id = 'urgent'").first()["source_excerpt"] == "a b"


DECISION = "review_id string, event_id string, cells map<string,string>, decision string, automation_choice string, actor string, acted_at string, note string, overrides map<string,string>, canonical_id string, approve_automation boolean, automation_condition string, automation_scope string"


def decided(spark, **change):
    base = {"review_id": "r", "event_id": "e", "cells": {"title": "t"}, "decision": "公開", "automation_choice": "自動公開", "actor": " a ", "acted_at": "2026-07-01T00:00:00+00:00", "note": None, "overrides": None, "canonical_id": None, "approve_automation": False, "automation_condition": None, "automation_scope": None} | change
    return review.decide(spark.createDataFrame([base], DECISION)).first()


def test_decisions(spark):
    got = decided(spark, decision="要確認付き公開")
    assert got["after"]["publication_status"] == "公開" and got["after"]["review_label"] == "あり" and got["action"]["action"] == "publish_with_warning" and got["rule"] is None
    assert json.loads(got["action"]["before_json"]) == {"title": "t"} and got["action"]["actor"] == "a"
    merged = decided(spark, decision="重複統合", canonical_id="evt_9")
    assert (merged["after"]["duplicate_status"], merged["after"]["canonical_event_id"]) == ("統合済み", "evt_9") and "review_label" not in merged["after"]
    assert decided(spark, decision="修正後公開", overrides={"title": "n"})["after"]["title"] == "n"
    rule = decided(spark, approve_automation=True, automation_condition="{}")["rule"]
    assert rule["action"] == "publish" and rule["scope"] == "source" and rule["approved_from_action_id"].startswith("act_")


@pytest.mark.parametrize("change", [{"decision": "x"}, {"actor": " "}, {"decision": "修正後公開"}, {"decision": "重複統合"}, {"approve_automation": True}])
def test_decisions_that_lack_something(spark, change):
    got = decided(spark, **change)
    assert got["error"] and got["after"] is None and got["action"] is None


def test_undecided_reviews(spark):
    reviews, actions = spark.createDataFrame([("a",), ("b",)], "review_id string"), spark.createDataFrame([("a",), ("a",)], "review_id string")
    assert [r["review_id"] for r in review.undecided(reviews, actions).collect()] == ["b"]


def test_canonical_from_note(spark):
    assert spark.range(1).select(review.canonical_from_note(F.lit("x canonical_event_id = evt_1-a y"))).first()[0] == "evt_1-a"


CANDIDATE = "detail_url string, title_hint string, pdf_urls array<string>, pos int"


def test_fullest_candidates(spark):
    got = rows.fullest_candidates(spark.createDataFrame([("u", "t", [], 0), ("v", "t", ["p"], 1), ("u", "t", ["p"], 2), ("u", "t", ["q"], 3)], CANDIDATE)).orderBy("place").collect()
    assert [(r["detail_url"], r["pdf_urls"], r["place"]) for r in got] == [("u", ["p"], 0), ("v", ["p"], 1)]


def test_match_by_url_takes_the_last_row(spark):
    events = spark.createDataFrame([("a", "https://x.example/p/", 2), ("b", "https://X.example/p#y", 3), ("c", "", 4)], "event_id string, primary_official_url string, row_number int")
    got = rows.match_by_url(spark.createDataFrame([("https://x.example/p",), ("",), (None,)], "detail_url string"), events).collect()
    assert [r["event_id"] for r in got] == ["b"]


def test_merge(spark):
    now = spark.createDataFrame([("a", "a", "t1", "s1"), ("b", "a", "t2", "s2")], "event_id string, canonical_event_id string, title string, status string")
    new = spark.createDataFrame([("a", 0, {"title": "x", "status": None}), ("c", 1, {"title": "y"}), ("c", 2, {"title": "z"}), ("a", 3, {"title": "w"})], "event_id string, pos int, cells map<string,string>")
    merged = rows.merge_rows(now, new)
    got = {r["event_id"]: tuple(r)[1:] for r in merged.collect()}
    assert got == {"a": ("a", "w", None, "updated"), "b": ("a", "t2", "s2", "kept"), "c": ("c", "z", None, "inserted")}
    assert tuple(rows.merge_counts(merged).first()) == (1, 1, 3)
    assert [r["column"] for r in rows.unknown_columns(now, spark.createDataFrame([("a", {"odd": "1", "title": "2"})], "event_id string, cells map<string,string>")).collect()] == ["odd"]


def test_change_detection_and_state(spark):
    state = spark.createDataFrame([("u", "x"), ("v", "y")], "url string, body string").select("url", F.sha2("body", 256).alias("content_hash"))
    got = rows.compare_with_state(spark.createDataFrame([("u", "x"), ("v", "z"), ("w", "n")], "url string, body string"), state)
    assert {r["url"]: (r["outcome"], r["body"]) for r in got.collect()} == {"u": ("not_modified", None), "v": ("fetched", "z"), "w": ("fetched", "n")}
    assert rows.next_state(state, got).count() == 3


def test_stale_edits(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "event_id string, updated_at string")
    edits = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "")], "event_id string, expected_updated_at string")
    assert [r["event_id"] for r in rows.stale_rows(now, edits).collect()] == ["b"]


def test_archive_of_expired_rows(spark):
    kind = "event_id string, publication_status string, effective_end_at string, stream_end_at string, event_end_at string, event_start_at string, archived_at string"
    rows_ = spark.createDataFrame([("2", "公開", "2026-07-01T00:00:00+09:00", None, None, None, ""), ("3", "公開", "", "2026-08-01T00:00:00+09:00", None, None, ""), ("4", "非公開", "2026-07-01T00:00:00+09:00", None, None, None, ""), ("5", "公開", "2026-07-01T00:00:00", None, None, None, ""), ("6", "公開", "bad", None, None, None, "")], kind)
    assert [r["event_id"] for r in site.expired(rows_, "2026-07-04T00:00:00+09:00").collect()] == ["2"]
    assert site.archived(rows_, "2026-07-04T00:00:00+09:00").filter("publication_status = 'アーカイブ'").count() == 1


EVENT = "event_id string, title string, format string, genres array<string>, event_type string, fee_category string, event_start_at string, stream_start_at string, stream_end_at string, event_end_at string, effective_end_at string, application_deadline_at string, search_key string, pdf_search_hashes array<string>"


def events(spark):
    return spark.createDataFrame([
        ("past", "b", "Web", ["呼吸"], "研修会", "無料", "2026-01-01T00:00:00+09:00", None, None, None, None, None, "ecmob", None), ("next", "a", "Web", ["循環"], "研修会", "有料", "2026-09-01T00:00:00+09:00", None, None, None, None, "2026-08-01T00:00:00+09:00", "a", None),
        ("open", "c", "現地開催", [], "研修会", "有料", None, None, None, None, None, None, "c", None),
    ], EVENT)


def test_site(spark):
    parted = site.partitioned(events(spark), "2026-07-01T00:00:00+00:00")
    assert {r["event_id"]: (r["active"], r["place"]) for r in parted.collect()} == {"past": (False, 1), "next": (True, 1), "open": (True, 2)}
    assert tuple(site.site_counts(parted).first()) == (2, 1, 3)
    assert [r["event_id"] for r in site.home(parted).collect()] == ["next"]


def test_facets(spark):
    from convena.functions import codes

    e = events(spark).withColumn("pdf_search_hashes", F.when(F.col("event_id") == "open", codes.gram_hashes(F.lit("ecmo"))))
    got = {r["event_id"]: r["pdf_hit"] for r in site.faceted(e, "2026-07-01T00:00:00+00:00", query="ecmo").collect()}
    assert got == {"past": False, "open": True}
    assert [r["event_id"] for r in site.faceted(e, "2026-07-01T00:00:00+00:00", genre="循環", month="2026-09", open_deadline=True, form="Web").collect()] == ["next"]
    assert site.faceted(e, "2026-07-01T00:00:00+00:00", query="x").count() == 0
    assert [r["title"] for r in e.orderBy(*site.browse_order("title")).collect()] == ["a", "b", "c"]


def test_counts_and_status(spark):
    got = rows.zero_filled_counts(spark.createDataFrame([("success",), ("odd",)], "status string"), "status", ["success", "failed"])
    assert {r["status"]: r["n"] for r in got.collect()} == {"success": 1, "failed": 0, "odd": 1}
    runs = spark.createDataFrame([(0, 0, True), (1, 2, True), (0, 1, False), (1, 0, True)], "candidates int, failures int, held boolean").select(rows.source_status().alias("s"))
    assert [r["s"] for r in runs.collect()] == ["technical_hold", "partial", "failed", "success"]


def test_daily_summary(spark):
    sources = spark.createDataFrame([("s1", "success", ["w"] * 25, None, 0), ("s2", "failed", [], "ValueError", 1)], "source_id string, status string, warnings array<string>, fatal string, pos int")
    summary = daily.daily_summary(sources, spark.createDataFrame([("s1",)], "source_id string"), "daily_1", "now")
    got = summary.first()
    assert got["candidate_count"] == 1 and got["has_failures"] and got["status_counts"]["partial"] == 0 and len(got["sources"][0]["warnings"]) == 20 and got["sources"][0]["warning_count"] == 25
    assert daily.summary_markdown(summary).first()["markdown"].endswith("- s2: ValueError\n")


def brute_chunks(pages, size):
    """Adds pieces one at a time to a text."""
    out, text, first, last = [], "", 0, 0
    for number, body in pages:
        mark = f"[page {number}]\n"
        for i in range(0, max(1, len(body)), size - len(mark)):
            piece = mark + body[i : i + size - len(mark)]
            if text and len(text) + 1 + len(piece) > size:
                out.append((first, last, text))
                text = ""
            first = first if text else number
            text, last = f"{text}\n{piece}".strip(), number
    return [*out, (first, last, text)] if text else out


@pytest.mark.parametrize("size", [500, 700])
def test_chunks(spark, size):
    pages = [(i, "あ" * n + " " * (i % 3)) for i, n in enumerate((0, 10, 300, 2000, 180, 180, 500, 0), 1)]
    got = [(c["page_from"], c["page_to"], c["text"]) for c in chunks.chunk_pages(pages, size)]
    assert got == brute_chunks(pages, size)
    df = spark.createDataFrame([("d", n, t) for n, t in reversed(pages)], "doc string, page int, text string")
    assert [r["text"] for r in chunks.chunks(df, size).orderBy("chunk_index").collect()] == [x[2] for x in got]
    with pytest.raises(ValueError, match="500"):
        chunks.chunks(df, 499)


def test_document_quality_and_ocr(spark):
    pages = chunks.page_quality(spark.createDataFrame([("d", 1, "a" * 100), ("d", 2, "x"), ("e", 1, "")], "doc string, page int, text string"))
    assert {r["doc"]: (r["status"], r["warnings"]) for r in chunks.document_quality(pages).collect()} == {"d": ("partial", ["OCR_CANDIDATE_PAGE_2"]), "e": ("failed", ["OCR_CANDIDATE_PAGE_1"])}
    read = chunks.with_ocr(pages, spark.createDataFrame([("d", 2, "b" * 80)], "doc string, page int, ocr_text string"))
    assert {(r["doc"], r["page"]): r["method"] for r in read.collect()} == {("d", 1): "text_layer", ("d", 2): "ocr", ("e", 1): "text_layer"}
    assert [spark.range(1).select(chunks.file_error(F.lit(b), F.lit(m))).first()[0] for b, m in ((b"%PDF-1", "application/pdf; x"), (b"x", "application/pdf"), (b"%PDF-1", "text/html"))] == [None, "INVALID_PDF_SIGNATURE", "INVALID_PDF_MIME"]


def test_extraction_asks_only_for_what_is_not_cached(spark):
    requests = spark.createDataFrame([("1", "s", "u", "t", ["https://a.example/"]), ("2", "s", "u", "t2", [])], "request_id string, source_id string, source_url string, candidate_text string, allowed_urls array<string>")
    empty = spark.createDataFrame([], f"cache_key string, {extraction.ANSWER}")
    out, new = extraction.extract(requests, empty)
    assert {r["request_id"]: (r["review_reasons"], r["cache_hit"]) for r in out.collect()} == {"1": (["AI_PENDING"], False), "2": (["AI_PENDING"], False)}
    cached = spark.createDataFrame(new.limit(2).collect(), new.schema)
    again, more = extraction.extract(requests, cached, provider=lambda r: 1 / 0)
    assert more.count() == 0 and all(r["cache_hit"] for r in again.collect())
    assert "untrusted" in extraction.prompt(requests, "x").first()["messages"][1]["content"]


def test_tables(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text('event_id,publication_status,genres,fee_verified\ne1,公開,"呼吸\n循環",TRUE\n,公開,,\ne2,公開\n', encoding="utf-8")
    got = {r["event_id"]: (r["genres"], r["fee_verified"], r["title"]) for r in tables.sheet_rows(spark, str(path)).collect()}
    assert got == {"e1": (["呼吸", "循環"], True, ""), "e2": ([], None, "")}
    configs = tables.source_configs(spark.createDataFrame([("s", "https://www.a.example/", "https://b.example/x\nhttps://www.a.example/y", "", " ")], "source_id string, base_url string, discovery_urls string, allowed_path_prefixes string, user_agent string"))
    row = tables.one_source(configs, "s").first()
    assert row["allowed_path_prefixes"] == ["/"] and row["allowed_hosts"] == ["a.example", "b.example", "www.a.example", "www.b.example"] and row["user_agent"] == tables.DEFAULT_AGENT
    with pytest.raises(Exception, match="unknown source"):
        tables.one_source(configs, "x").collect()
    assert [r["source_id"] for r in tables.require_known(["s", "x"], configs).collect()] == ["x"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "2"), ("a", "1")], "url string, content_hash string")
    tables.tee(df, [str(tmp_path / "x"), str(tmp_path / "y")])
    tables.append(df, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).count() == 4 and spark.read.json(str(tmp_path / "y")).count() == 2
    tables.replace_state(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    made = tables.provision(spark, "prov", {"settings": "list string, code string, sort_order int"}, {"settings": tables.settings(spark)})
    assert made == ["settings"] and tables.provision(spark, "prov", {"settings": "x int"}) == []
    bad = spark.createDataFrame([("Web",), ("",), ("x",)], "format string")
    assert [r["format"] for r in tables.invalid_codes(bad, "format", "formats", spark.table("prov.settings")).collect()] == ["x"]
