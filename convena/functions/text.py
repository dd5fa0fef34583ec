"""Text predicates and normal forms as columns. Only NFKC and sequence similarity leave the JVM, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Words that make a text an event, words that make a short one something else, and labels of navigation links.
EVENT_WORDS = ["セミナー", "研修", "講習", "学会", "大会", "研究会", "勉強会", "カンファレンス", "フォーラム", "webinar", "seminar", "conference", "workshop", "e-learning", "eラーニング", "オンデマンド"]
EXCLUDING_WORDS = ["求人", "採用", "会費", "入会", "退会", "役員選挙", "議事録", "広告募集", "協賛募集", "物品販売"]
NAVIGATION_LABELS = ["イベント", "セミナー情報", "お知らせ", "ニュース", "関連学会情報", "当会主催イベント", "学術セミナー", "学術大会", "詳細", "詳しくはこちら", "more", "一覧"]
# Words of format and forms of corporations that titles and organisers are compared without.
FORMAT_WORDS = ["オンライン", "web", "ウェブ", "オンデマンド", "ハイブリッド", "現地開催"]
CORPORATE_FORMS = ["公益社団法人", "一般社団法人", "公益財団法人", "一般財団法人", "特定非営利活動法人", "NPO法人"]
TITLE_PUNCTUATION = r"[「」『』【】()\[\]（）:：・,，。~〜～／/]"
#: White space of any script, separators among the control characters included; and the control characters that are not white space.
BLANK = r"(?U)[\s\x1c-\x1f]"
CONTROLS = "".join(map(chr, [*range(9), *range(14, 28)]))
#: An excluding word counts only in texts of up to so many characters.
SHORT_TEXT = 35


def normalize_space(c: Column) -> Column:
    """Runs of white space, U+3000 and the like included, become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, BLANK + "+", " "), "^ | $", "")


def contains_any(c: Column, words: list[str]) -> Column:
    # One pattern, so that the text is made once and not once a word.
    return c.rlike("|".join(re.escape(w.lower()) for w in words))


def is_event_like(c: Column) -> Column:
    text = F.lower(normalize_space(F.coalesce(c, F.lit(""))))
    return contains_any(text, EVENT_WORDS) & (~contains_any(text, EXCLUDING_WORDS) | (F.length(text) > SHORT_TEXT))


def is_title_hint(c: Column) -> Column:
    text = normalize_space(F.coalesce(c, F.lit("")))
    return ~text.rlike("^(?i:https?)://[^/?#]") & (text != "") & ~F.lower(text).isin(NAVIGATION_LABELS) & is_event_like(text)


def is_pdf_url(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)[?#].*$", "")).endswith(".pdf")


def is_followed_link(href: Column) -> Column:
    return F.coalesce((href != "") & ~href.rlike("^(#|mailto:|javascript:)"), F.lit(False))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility normal form, for which Spark has no function."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts, in this order; 0 if either is empty or null."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def _folded(c: Column, compatible: bool) -> Column:
    return F.lower(nfkc(c) if compatible else c)


def search_key(c: Column, compatible: bool = True) -> Column:
    """What searches compare: NFKC, lower case, no white space, hyphens, underscores or long vowel marks. ``compatible`` False leaves NFKC out where it is known to change nothing."""
    return F.regexp_replace(_folded(F.coalesce(c, F.lit("")), compatible), r"(?U)[\s\-_ー]+", "")


def title_key(c: Column, compatible: bool = True) -> Column:
    text = _folded(F.coalesce(c, F.lit("")), compatible)
    for word in FORMAT_WORDS:
        text = F.replace(text, F.lit(word), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(text, TITLE_PUNCTUATION, " "), r"(?U)\s+", "")


def organizer_key(c: Column, compatible: bool = True) -> Column:
    text = _folded(F.coalesce(c, F.lit("")), compatible)
    for form in CORPORATE_FORMS:
        text = F.replace(text, F.lit(form.lower()), F.lit(""))
    return F.regexp_replace(text, r"(?U)[\s・,，。]", "")


def page_lines(c: Column) -> Column:
    """Text of a page: no NUL, white space within lines collapsed, blank lines dropped."""
    lines = F.split(F.replace(c, F.lit("\0"), F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.array_join(F.filter(F.transform(lines, normalize_space), lambda x: x != ""), "\n")


def text_quality(c: Column) -> Column:
    """Visible characters of 80 at most, less the shares of replacement and control characters; 0 to 1, to four places."""
    text = F.coalesce(c, F.lit(""))
    n = F.length(F.regexp_replace(text, BLANK + "+", ""))
    # Neither kind is white space, so they are counted in the text as it is.
    lost = F.length(text) - F.length(F.replace(text, F.lit("\ufffd"), F.lit("")))
    control = F.length(text) - F.length(F.translate(text, CONTROLS, ""))
    score = F.least(F.lit(1.0), n / 80) * (1 - lost / n) * (1 - control / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))


def needs_ocr(text: Column, quality: Column) -> Column:
    return (F.length(text) < 30) | (quality < 0.35)


def excerpt(c: Column, length: int) -> Column:
    return F.substring(normalize_space(F.coalesce(c, F.lit(""))), 1, length)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_given(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def split_cell(c: Column) -> Column:
    """A cell of several values, one a line: trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), normalize_space), lambda x: x != "")


def split_admin_value(c: Column) -> Column:
    """As typed by an administrator: one value a line or between commas."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\r\n,]+"), lambda x: F.trim(x)), lambda x: x != "")


def ordered_distinct(c: Column) -> Column:
    """Without nulls and blanks, each value where it first stands."""
    return F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))


def cell_boolean(c: Column) -> Column:
    return F.when(F.upper(c) == "TRUE", F.lit(True)).when(F.upper(c) == "FALSE", F.lit(False))
