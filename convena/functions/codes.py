"""Closed sets of codes, identifiers derived from content, and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed sets.
PUBLICATION = ["公開", "非公開", "確認待ち", "アーカイブ"]
REVIEW = ["未確認", "確認済み", "要修正"]
LABEL = ["あり", "なし"]
DUPLICATE = ["重複なし", "重複候補", "統合済み"]
EVENT_TYPES = ["セミナー", "研修会", "講習会", "学会・大会", "研究会", "オンデマンド", "その他"]
FORMATS = ["Web", "オンデマンド", "ハイブリッド", "現地開催", "要確認"]
WEB_FORMATS = ["Web", "オンデマンド", "ハイブリッド"]
FEES = ["無料", "有料", "要確認"]
ORGANIZER_TYPES = ["技士会主催", "関連団体主催", "企業主催", "企業共催", "要確認"]
GENRES = ["血液浄化", "呼吸", "循環", "医療機器管理", "手術室", "教育・研究", "DX・IT", "その他"]
SOURCE_STATUSES = ["success", "partial", "failed", "technical_hold", "disabled"]
PRIORITIES = ["緊急", "高", "通常", "低"]
DECISIONS = {"公開": "publish", "要確認付き公開": "publish_with_warning", "修正後公開": "edit", "非公開": "reject", "重複統合": "merge"}
AUTOMATION = {"自動公開": "publish", "要確認付き公開": "publish_with_warning", "非公開": "reject"}
# What a reviewer reads for each reason. CAPACITY_UNKNOWN is a reason like the others.
REASONS = {
    "DATE_UNKNOWN": "開催日時を確認してください",
    "DEADLINE_UNKNOWN": "申込締切を確認してください",
    "FEE_UNKNOWN": "参加費を確認してください",
    "CAPACITY_UNKNOWN": "定員を確認してください",
    "CREDITS_UNCERTAIN": "取得単位を確認してください",
    "PDF_PRIMARY": "PDF原本を確認してください",
    "DUPLICATE_CANDIDATE": "重複候補を確認してください",
    "LOW_EVENT_CONFIDENCE": "イベント情報を確認してください",
    "ORGANIZER_UNKNOWN": "主催者を確認してください",
    "FORMAT_UNKNOWN": "開催形式を確認してください",
    "OFFICIAL_URL_UNKNOWN": "公式URLを確認してください",
    "SOURCE_UNREACHABLE": "公式ページの取得状況を確認してください",
    "TEXT_QUALITY_LOW": "原文の読み取り結果を確認してください",
    "HIGH_IMPACT_FIELD_CHANGED": "重要項目の変更を確認してください",
    "SOURCE_GAP": "情報源の不足を確認してください",
}
# Which extracted field settles which reason.
SETTLED_BY = {"event_start": "DATE_UNKNOWN", "application_deadline_at": "DEADLINE_UNKNOWN", "fee_text": "FEE_UNKNOWN", "capacity_text": "CAPACITY_UNKNOWN"}
# Fields whose doubt asks for a correction.
HIGH_RISK = ["event_start_at", "application_deadline_at", "fee_text", "credits_text"]


def lookup(table: dict[str, str], c: Column) -> Column:
    """The table's value; the code itself where it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c), c)


def digest_id(prefix: str, length: int, separator: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws(separator, *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, length))


def event_source_id(source_id: Column, detail_url: Column) -> Column:
    return digest_id("es", 24, "\0", source_id, detail_url)


def log_id(run_id: Column, stage: Column, url: Column, started: Column) -> Column:
    return digest_id("log", 24, "\0", run_id, stage, url, started)


def review_id(event_id: Column, reasons: Column, now: Column) -> Column:
    return digest_id("rev", 20, "|", event_id, F.array_join(reasons, "|"), now)


def action_id(review: Column, event_id: Column, acted_at: Column) -> Column:
    return digest_id("act", 20, "|", review, event_id, acted_at)


def rule_id(action: Column, choice: Column) -> Column:
    return digest_id("rule", 20, "|", action, choice)


def daily_run_id(started: Column) -> Column:
    return F.concat(F.lit("daily_"), F.date_format(started, "yyyyMMdd'T'HHmmss"))


def gram_hashes(key: Column) -> Column:
    """SHA-256 of every run of two and three characters of a search key, distinct and sorted; none for a shorter key."""

    def grams_of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(1)))
        return F.when(F.length(key) >= n, F.transform(places, lambda i: F.substr(key, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = [grams_of(n) for n in (2, 3)]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*grams), lambda g: F.sha2(g, 256))))


def all_gram_hashes(keys: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(keys, gram_hashes))))


def reason_display(reasons: Column) -> Column:
    return F.array_join(F.transform(reasons, lambda r: lookup(REASONS, r)), "\n")


def open_reasons(reasons: Column, extracted: Column) -> Column:
    """Reasons that no extracted field settles; a field settles its reason whatever its confidence."""
    settled = F.filter(F.array(*[F.when(F.map_contains_key(extracted, field), F.lit(reason)) for field, reason in SETTLED_BY.items()]), lambda r: r.isNotNull())
    return F.filter(reasons, lambda r: ~F.array_contains(settled, r))


def cache_key(request: Column, provider: str, model: str, prompt_version: str) -> Column:
    """SHA-256 of a request as JSON with what answers it."""
    parts = F.struct(F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), F.lit(provider).alias("provider"), request.alias("request"))
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def column_letter(n: Column) -> Column:
    """The letters of a sheet's column by its number, from 1 (A) to 18278 (ZZZ); null beyond."""
    letter = lambda i: F.char(F.lit(65) + i % 26)
    one, two, three = n - 1, n - 27, n - 703
    return (
        F.when(n.between(1, 26), letter(one))
        .when(n.between(27, 702), F.concat(letter(F.floor(two / 26)), letter(two)))
        .when(n.between(703, 18278), F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26)), letter(three)))
    )
