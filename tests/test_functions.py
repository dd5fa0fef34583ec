import pytest
from pyspark.sql import functions as F

from convena.functions import codes, rules, text, times, urls, validate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def s(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize(("given", "wanted"), [("  a　 b\n\tc ", "a b c"), ("", ""), ("　", "")])
def test_normalize_space(spark, given, wanted):
    assert one(spark, text.normalize_space(s(given))) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("第3回 セミナー", True), ("SEMINAR 2030", True), ("求人セミナー", False), ("求人" + "あ" * 40 + "セミナー", True), ("お知らせ", False), (None, False)])
def test_event_like(spark, given, wanted):
    assert one(spark, text.is_event_like(s(given))) is wanted


@pytest.mark.parametrize(("given", "wanted"), [("学術セミナー", False), ("https://a.example/セミナー", False), ("呼吸セミナー", True), ("", False)])
def test_title_hint(spark, given, wanted):
    assert one(spark, text.is_title_hint(s(given))) is wanted


def test_pdf_url_looks_at_the_path(spark):
    assert one(spark, text.is_pdf_url(s("https://a.example/x.PDF?y=1")))
    assert not one(spark, text.is_pdf_url(s("https://a.example/x?y=z.pdf")))


def test_titles_differ_by_number_and_not_by_format(spark):
    a, b, c = (one(spark, text.title_key(s(x))) for x in ("第10回 人工呼吸器 WEBセミナー", "第10回　人工呼吸器セミナー（オンライン）", "第11回 人工呼吸器セミナー"))
    assert a == b != c


def test_organizer_without_its_corporate_form(spark):
    assert one(spark, text.organizer_key(s("一般社団法人 ＡＢＣ・会"))) == "abc会"


def test_search_keys_fold_width_and_case(spark):
    assert one(spark, text.search_key(s("ＥＣＭＯ - データー_x"))) == "ecmoデタx"
    keyed = spark.createDataFrame([("ＥＣＭＯ",), ("ecmo",)], "t string").withColumn("k", text.search_key(F.col("t")))
    full, plain = (r["h"] for r in keyed.select(codes.gram_hashes(F.col("k")).alias("h")).collect())
    assert full == plain and len(plain) == 5 and plain == sorted(plain)


def test_short_keys_have_no_hashes(spark):
    assert one(spark, codes.gram_hashes(s("a"))) == []
    assert len(one(spark, codes.gram_hashes(s("ab")))) == 1


def test_similarity_depends_on_order_and_is_0_for_blanks(spark):
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "x"), (None, "x"), ("ab", "ab")], "a string, b string").select(text.similarity("a", "b").alias("r")).collect()
    assert [r["r"] for r in rows] == [0.25, 0.5, 0.0, 0.0, 1.0]


@pytest.mark.parametrize(("given", "wanted"), [("a" * 80, 1.0), ("a" * 40, 0.5), ("", 0.0), (" \n", 0.0), ("�" * 40 + "a" * 40, 0.5), ("\x01" * 80, 0.0)])
def test_text_quality(spark, given, wanted):
    assert one(spark, text.text_quality(s(given))) == wanted


def test_page_lines(spark):
    assert one(spark, text.page_lines(s(" a\0  b \n\n　\r\nc"))) == "a b\nc"


def test_cells(spark):
    assert one(spark, text.split_cell(s(" a \n\nb"))) == ["a", "b"]
    assert one(spark, text.split_admin_value(s("a, b\nc"))) == ["a", "b", "c"]
    assert [one(spark, text.cell_boolean(s(x))) for x in ("true", "FALSE", "x")] == [True, False, None]
    assert one(spark, text.ordered_distinct(F.array(s("b"), s(""), s("a"), s(None), s("b")))) == ["b", "a"]


URL = "HTTPS://user@A.Example:443/Dir/?q=1#top"


@pytest.mark.parametrize(
    ("form", "wanted"),
    [
        (urls.join_form, "https://user@a.example:443/Dir?q=1"),
        (urls.source_form, "https://a.example/Dir/?q=1"),
        (urls.duplicate_form, "https://a.example/Dir?q=1"),
        (urls.safe_form, "https://a.example:443/Dir/?q=1"),
        (urls.rule_form, "https://user@A.Example:443/Dir/?q=1#top"),
    ],
)
def test_url_forms_differ(spark, form, wanted):
    assert one(spark, form(s(URL))) == wanted


def test_url_forms_of_what_is_none(spark):
    assert {one(spark, f(s(x))) for f in (urls.join_form, urls.source_form, urls.duplicate_form, urls.rule_form) for x in ("", "mailto:a@b.example", "/x", None)} == {""}
    assert one(spark, urls.join_form(s("https://a.example"))) == "https://a.example/"
    assert one(spark, urls.safe_form(s("https://例え.example"))) == "https://xn--r8jz45g.example/"


def test_hosts_and_refusals(spark):
    assert one(spark, urls.expanded_hosts(F.array(s("www.a.example"), s("b.example")))) == ["a.example", "b.example", "www.a.example", "www.b.example"]
    why = lambda u: one(spark, urls.refusal(s(u), F.array(s("a.example")), F.array(s("/ok"))))
    assert [why(u) for u in ("https://a.example/ok/1", "ftp://a.example/ok", "https://u:p@a.example/ok", "https://b.example/ok", "https://a.example/no")] == [None, "SCHEME", "CREDENTIALS", "HOST_NOT_ALLOWED", "PATH_NOT_ALLOWED"]
    assert one(spark, urls.with_host(s("http://old.example/a?b=1"), "new.example")) == "http://new.example/a?b=1"


def test_times(spark):
    assert one(spark, times.is_aware(s("2026-08-01T13:30:00+09:00"))) and not one(spark, times.is_aware(s("2026-08-01T13:30:00")))
    assert [one(spark, times.date_score(s("2026-08-01T23:00:00+09:00"), s(b))) for b in ("2026-08-01T01:00:00Z", "2026-08-02T00:00:00+09:00", "2026-08-04", "bad", None)] == [1.0, 0.4, 0.0, 0.0, 0.0]
    assert [one(spark, times.display_time(s(x))) for x in ("2026-08-01T13:30:00+09:00", "2026-08-01T00:00:00+09:00", "later", None)] == ["8月1日 13:30", "8月1日", "later", "要確認"]
    assert one(spark, times.display_period(s(""), s("2026-08-02"), s(""))) == "要確認 〜 8月2日"
    assert one(spark, times.effective_end(s(""), s(None), s("b"), s("c"))) == "b"


def found(spark, given, allowed=None):
    got = one(spark, rules.extract(s(given), F.array(*map(s, allowed)) if allowed is not None else None))
    return {k: (v["value"], v["confidence"], v["evidence"]) for k, v in got.items()}


def test_rules_find_a_start_with_its_time(spark):
    got = found(spark, "日時：2026年8月1日（土）13:30 から 参加費：無料")
    assert got["event_start"][:2] == ("2026-08-01T13:30:00+09:00", 0.92)
    assert got["fee_text"][0] == "無料" and got["fee_category"][:2] == ("無料", 0.95)


def test_rules_dates(spark):
    assert found(spark, "2026/8/1")["event_start"] == ("2026-08-01T00:00:00+09:00", 0.85, "2026/8/1")
    assert "event_start" not in found(spark, "2026年2月30日")
    assert found(spark, "")== {}
    deadline = lambda x: found(spark, f"申込締切：{x}")["application_deadline_at"][0]
    assert deadline("2026（令和8）年7月1日") == "2026-07-01T23:59:00+09:00"
    assert deadline("2026年7月1日 17時") == "2026-07-01T17:59:00+09:00"


def test_rules_fees_capacity_credits_and_urls(spark):
    got = found(spark, "参加費：会員 1,000円、非会員は無料\n定員： 30名\n認定 5単位を申請\nhttps://a.example/x?y 他", ["https://b.example/", "https://a.example/x?y"])
    assert got["fee_category"][0] == "有料" and got["capacity_text"][0] == "30名" and got["credits_text"][0] == "認定 5単位を申請"
    assert got["application_url"] == ("https://a.example/x?y", 1.0, "https://a.example/x?y")
    assert "application_url" not in found(spark, "https://a.example/x", ["https://a.example/z"])


def checked(spark, fields, reasons=(), allowed=("https://a.example/x/",)):
    rows = [(k, *v) for k, v in fields.items()]
    items = F.map_from_entries(F.array(*[F.struct(s(k), F.struct(s(v).alias("value"), s(c).alias("confidence"), s(e).alias("evidence"))) for k, v, c, e in rows])) if rows else F.create_map().cast(validate.RAW)
    return one(spark, validate.validated(items.cast(validate.RAW), F.array(*map(s, reasons)).cast("array<string>"), F.array(*map(s, allowed)).cast("array<string>")))


def test_validation(spark):
    got = checked(spark, {
        "title": ('"x"', "1.5", None), "unknown": ('"x"', "1", "e"), "event_start": ('"2026-01-01T00:00:00"', "0.9", "e"), "fee_text": ('"free"', "0.9", " "), "format": ('"Web"', "0.8", None), "event_type": ('"party"', "0.8", None),
        "genres": ('["呼吸","x"]', "0.7", None), "official_url": ('"https://A.example:443/x/#y"', "1", None), "application_url": ('"https://c.example/"', "1", None),
    }, ["LOW", "LOW", ""])
    fields = {k: (v["value"], v["confidence"]) for k, v in got["fields"].items()}
    assert fields == {"title": ("x", 1.0), "event_start": (None, 0.0), "fee_text": (None, 0.0), "format": ("Web", 0.8), "event_type": (None, 0.0), "genres": ('["呼吸"]', 0.7), "official_url": ("https://a.example/x/", 1.0), "application_url": (None, 0.0)}
    assert got["review_reasons"] == ["LOW", "EVENT_START_INVALID", "FEE_TEXT_EVIDENCE_MISSING", "EVENT_TYPE_INVALID", "URL_NOT_IN_SOURCE"]


def test_reasons(spark):
    extracted = F.create_map(s("fee_text"), s("x"))
    left = codes.open_reasons(F.array(s("FEE_UNKNOWN"), s("DATE_UNKNOWN"), s("OWN")), extracted)
    assert one(spark, left) == ["DATE_UNKNOWN", "OWN"]
    assert one(spark, codes.reason_display(left)) == "開催日時を確認してください\nOWN"


def test_ids_have_their_lengths(spark):
    assert one(spark, codes.event_source_id(s("a"), s("b"))).startswith("es_") and len(one(spark, codes.event_source_id(s("a"), s("b")))) == 27
    assert len(one(spark, codes.review_id(s("e"), F.array(s("r")), s("now")))) == 24
