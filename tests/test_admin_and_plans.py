import json

import pytest
from pyspark.sql import functions as F

from convena.operators import admin, rows
from convena.plans import cli, lock, site
from convena.sources import pdf, tables
from convena.sources.tables import EVENT_COLUMNS

NOW = "2026-07-01T00:00:00+00:00"


def test_edits(spark):
    events = spark.createDataFrame([("a", "t", "", "1"), ("b", "t", "", "2"), ("c", "t", "", "3")], "event_id string, title string, genres string, updated_at string")
    edits = spark.createDataFrame([("a", 0, {"title": " new ", "genres": "x, y"}, "1"), ("b", 1, {"event_id": "z"}, ""), ("b", 2, {"format": "bad", "application_url": "x"}, ""), ("c", 3, {"title": "late"}, "2"), ("d", 4, {"title": "x"}, "")], "event_id string, pos int, cells map<string,string>, expected_updated_at string")
    after, refused = admin.apply_edits(events, edits)
    assert {r["event_id"]: (r["title"], r["genres"]) for r in after.collect()} == {"a": ("new", "x\ny"), "b": ("t", ""), "c": ("t", "")}
    assert {r["pos"]: r["error"] for r in refused.collect()} == {1: "not editable: event_id", 2: "invalid value: format, application_url", 3: "changed meanwhile", 4: "unknown event"}


def test_dashboard_and_matches(spark):
    events = spark.createDataFrame([("a", "t", "公開", None), ("b", None, "確認待ち", "2026")], "event_id string, title string, publication_status string, effective_end_at string")
    reviews = spark.createDataFrame([("r", "b", None, "緊急"), ("s", "a", "公開", None)], "review_id string, event_id string, decision string, priority string")
    board = admin.dashboard(events, reviews, spark.createDataFrame([("s", 2)], "source_id string, consecutive_failures int"))
    assert [r["title"] for r in board["events"].orderBy("sort_key").collect()] == ["", "t"]
    assert [(r["review_id"], r["title"], r["rank"]) for r in board["reviews"].collect()] == [("r", "b", 0)]
    assert tuple(board["stats"].first()) == (2, 1, 1, 1, 1)
    assert admin.matched(reviews, events).count() == 2
    with pytest.raises(Exception, match="no event x"):
        admin.matched(reviews.withColumn("event_id", F.lit("x")), events).collect()


def test_rules_need_a_source(spark):
    decided = spark.createDataFrame([("a", ("rule_1",)), ("b", ("rule_2",)), ("c", None)], "event_id string, rule struct<rule_id:string>")
    sources = spark.createDataFrame([("a", "s2", 3), ("a", "s1", 2)], "event_id string, source_id string, row_number int")
    assert [tuple(r) for r in admin.automation_rules(decided, sources).collect()] == [("rule_1", '{"source_id":"s1"}')]


def test_pdf_pages(spark):
    docs = spark.createDataFrame([("a", b"%PDF-1", "application/pdf"), ("b", b"no", "application/pdf"), ("c", b"%PDF-x", "application/pdf")], "doc string, data binary, mime string")

    def read(data):
        if data.endswith(b"x"):
            raise RuntimeError
        return ["one", "two"]

    got = {(r["doc"], r["page"]): (r["text"], r["error"]) for r in pdf.pages(docs, read).collect()}
    assert got == {("a", 1): ("one", None), ("a", 2): ("two", None), ("b", None): (None, "INVALID_PDF_SIGNATURE"), ("c", None): (None, "RuntimeError")}


def test_jobs(spark, tmp_path):
    records = [{"event_id": "evt_1", "canonical_event_id": "evt_1", "publication_status": "公開", "review_label": "あり", "fixed_values": {"title": "<A>", "organizer_name": "会", "format": "Web", "primary_official_url": "https://a.example/", "event_start_at": "2026-08-01T00:00:00+09:00", "genres": ["呼吸"]}}]
    (tmp_path / "records.json").write_text(json.dumps({"events": records}, ensure_ascii=False))
    run = lambda job, **k: cli.main([job, "--now", NOW, *[x for name, v in k.items() for x in (f"--{name}", str(v))]], spark)
    run("build-public", input=tmp_path / "records.json", output=tmp_path / "public.json")
    assert json.loads((tmp_path / "public.json").read_text())["event_count"] == 1
    run("build-site", input=tmp_path / "public.json", output=tmp_path / "site")
    assert "&lt;A&gt;" in (tmp_path / "site/index.html").read_text() and "要確認" in (tmp_path / "site/events/evt_1/index.html").read_text()
    assert "article" not in (tmp_path / "site/archive/index.html").read_text() and (tmp_path / "site/about/index.html").exists()
    (tmp_path / "sheet.csv").write_text('event_id,canonical_event_id,publication_status,title,organizer_name,format,primary_official_url,event_start_at,genres,review_label\ne1,e1,公開,T,会,Web,https://a.example/,2026-01-01T00:00:00+09:00,"呼吸\n循環",なし\n')
    run("export-public-from-sheet", input=tmp_path / "sheet.csv", output=tmp_path / "sheet.json")
    assert json.loads((tmp_path / "sheet.json").read_text())["events"][0]["genres"] == ["呼吸", "循環"]
    run("archive-sheet", input=tmp_path / "sheet.csv", output=tmp_path / "archived")
    assert spark.read.parquet(str(tmp_path / "archived")).first()["publication_status"] == "アーカイブ"
    (tmp_path / "new.json").write_text(json.dumps([{"event_id": "e1", "title": "U"}, {"event_id": "e2", "title": "V"}]))
    run("upsert-sheet-events", input=tmp_path / "sheet.csv", events=tmp_path / "new.json", output=tmp_path / "merged")
    assert {r["event_id"]: (r["title"], r["canonical_event_id"]) for r in spark.read.parquet(str(tmp_path / "merged")).collect()} == {"e1": ("U", "e1"), "e2": ("V", "e2")}
    (tmp_path / "bad.json").write_text(json.dumps([{"event_id": "e1", "odd": "U"}]))
    with pytest.raises(SystemExit, match="odd"):
        run("upsert-sheet-events", input=tmp_path / "sheet.csv", events=tmp_path / "bad.json", output=tmp_path / "merged2")
    run("export-sheet-template", output=tmp_path / "template.json")
    assert json.loads((tmp_path / "template.json").read_text())["events"][0] == "event_id"
    run("plan-sheet")
    run("init-sheet", output="cli_db")
    assert spark.table("cli_db.settings").count() > 20


def test_collecting_job_and_daily_run(spark, tmp_path):
    spark.createDataFrame([("k", "https://a.example/list", '<h3 id="x">呼吸セミナー</h3>2026年8月1日'.encode("cp932"), "text/html", "cp932", "kumamoto")], "key string, url string, body binary, content_type string, encoding string, adapter string").write.parquet(str(tmp_path / "pages"))
    cli.main(["collect-source", "--input", str(tmp_path / "pages"), "--output", str(tmp_path / "candidates")], spark)
    row = spark.read.json(str(tmp_path / "candidates")).first()
    assert row["detail_url"] == "https://a.example/list#x" and row["extracted_fields"]["event_start"]["value"].startswith("2026-08-01")
    (tmp_path / "runs.json").write_text(json.dumps({"source_id": "s", "status": "success", "warnings": [], "pos": 0}) + "\n")
    (tmp_path / "found.json").write_text(json.dumps({"source_id": "s"}) + "\n")
    cli.main(["daily-run", "--input", str(tmp_path / "runs.json"), "--events", str(tmp_path / "found.json"), "--output", str(tmp_path / "summary"), "--now", NOW], spark)
    assert spark.read.json(str(tmp_path / "summary")).first()["run_id"] == "daily_20260701T000000"


def test_escaping(spark):
    assert spark.range(1).select(site.escaped(F.lit("<&\"'>"))).first()[0] == "&lt;&amp;&quot;&#x27;&gt;"


def test_lock(tmp_path):
    path = tmp_path / "run.lock"
    with lock.run_lock(path):
        with pytest.raises(lock.RunIsActive), lock.run_lock(path):
            pass
        with lock.run_lock(path, stale=-1):
            pass
    assert not path.exists()


def test_state_and_cache(spark, tmp_path):
    (tmp_path / "state.json").write_text('{"url":"u","content_hash":"1","fetched_at":"1"}\n{"url":"u","content_hash":"2","fetched_at":"2"}\n{"x":1}\n')
    assert [(r["url"], r["content_hash"]) for r in tables.fetch_state(spark, str(tmp_path / "state.json")).collect()] == [("u", "2")]
    (tmp_path / "cache.json").write_text('{"cache_key":"k","is_event":true,"fields":{"title":{"value":"\\"x\\"","confidence":"1"}}}\n[1]\n')
    assert [(r["cache_key"], r["fields"]["title"]["value"]) for r in tables.extraction_cache(spark, str(tmp_path / "cache.json")).collect()] == [("k", '"x"')]
    (tmp_path / "found.json").write_text('{"source_id":"s","pdf_urls":["p"]}\n')
    assert tables.candidates(spark, str(tmp_path / "found.json")).first()["pdf_urls"] == ["p"]


def test_admin_lists():
    assert len(admin.SHOWN) == len(set(admin.SHOWN)) == 40 and len(admin.EDITABLE) == len(set(admin.EDITABLE)) == 35
    assert set(admin.EDITABLE) <= set(admin.SHOWN) <= set(EVENT_COLUMNS)
    assert {"timezone", "has_on_demand", "canonical_event_id"}.isdisjoint(admin.SHOWN) and {"review_reason_display", "last_verified_at"} <= set(admin.EDITABLE)


def test_daily_run_holds_its_lock(spark, tmp_path):
    (tmp_path / "sources.json").write_text('{"source_id":"a","status":"success","warnings":[],"pos":1}\n')
    (tmp_path / "found.json").write_text('{"source_id":"a"}\n')
    args = ["daily-run", "--input", str(tmp_path / "sources.json"), "--events", str(tmp_path / "found.json"), "--output", str(tmp_path / "out"), "--now", "2000-01-01T00:00:00+00:00", "--lock", str(tmp_path / "run.lock")]
    cli.main(args, spark)
    assert not (tmp_path / "run.lock").exists()
    with lock.run_lock(tmp_path / "run.lock"), pytest.raises(SystemExit) as held:
        cli.main(args, spark)
    assert held.value.code == lock.HELD


def test_places_in_one_order(spark):
    import random

    rng = random.Random(5)
    rows_ = [(f"{rng.randrange(10**5):05d}{i}", rng.choice(["a", "b", None]), rng.choice(["2000-01-01", "2000-01-02", "2000-02-01", "9999"]), rng.choice("xy")) for i in range(500)]
    df = spark.createDataFrame(rows_, "event_id string, title string, date string, kind string")
    cuts = [[rows.Cut("_m", F.substring("date", 1, 7), True)], [rows.Cut("_d", F.col("date"), True), rows.Cut("_t", F.col("title")), rows.id_cut(df)]]
    order = [F.desc("date"), F.col("title"), F.col("event_id")]
    in_order = lambda some: sorted(sorted(some, key=lambda r: (r[1] or "", r[0])), key=lambda r: r[2], reverse=True)
    got = {r["event_id"]: r["place"] for r in rows.placed(df, cuts, order).collect()}
    assert got == {r[0]: i for i, r in enumerate(in_order(rows_), 1)}
    got = {r["event_id"]: r["place"] for r in rows.placed(df, cuts, order, by=("kind",)).collect()}
    assert got == {r[0]: i for k in "xy" for i, r in enumerate(in_order(r for r in rows_ if r[3] == k), 1)}
