"""Duplicates, review routing and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, text, times, urls

# Weights of the parts of a duplicate's score, and its thresholds.
TITLE, DATE, ORGANIZER, ANCHOR, FORMAT = 0.40, 0.25, 0.15, 0.15, 0.05
AUTO, REVIEW = 0.85, 0.65
URGENT_HOURS, SOON_DAYS = 72, 7


def anchor(a: str, b: str) -> Column:
    """What two events certainly share: an official URL, else an application URL, else a PDF's hash, else nothing."""

    def shared(name: str, form) -> Column:
        forms = lambda side: F.filter(F.transform(F.col(f"{side}.{name}"), form), lambda u: u != "")
        return F.coalesce(F.arrays_overlap(forms(a), forms(b)), F.lit(False))

    return F.when(shared("official_urls", urls.duplicate_form), F.lit("official_url")).when(shared("application_urls", urls.duplicate_form), F.lit("application_url")).when(shared("pdf_hashes", F.lower), F.lit("pdf_hash")).otherwise(F.lit(""))


def anchor_keys() -> Column:
    """Keys of all three anchors, told apart by a tag: two events share one if and only if they have an anchor."""
    tagged = lambda name, tag, form: F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda u: F.when(form(u) != "", F.concat(F.lit(tag), form(u))))
    return F.concat(tagged("official_urls", "official ", urls.duplicate_form), tagged("application_urls", "application ", urls.duplicate_form), tagged("pdf_hashes", "pdf ", F.lower))


def equal_given(a: Column, b: Column) -> Column:
    return F.when((F.coalesce(a, F.lit("")) != "") & (a == b), F.lit(1.0)).otherwise(F.lit(0.0))


def disposition(total: Column, anchored: Column) -> Column:
    return F.when((total >= AUTO) & (anchored != ""), F.lit("auto_merge_candidate")).when(total >= REVIEW, F.lit("review")).otherwise(F.lit("separate"))


def total_score(title: Column, date: Column, organizer: Column, url: Column, form: Column) -> Column:
    return F.bround(title * TITLE + date * DATE + organizer * ORGANIZER + url * ANCHOR + form * FORMAT, 4)


def assess_pairs(pairs: DataFrame, compatible: bool = True) -> DataFrame:
    """Scores of pairs given as structs ``a`` and ``b`` of event_id, title, event_start_at, organizer_name, event_format, official_urls, application_urls, pdf_hashes."""
    keyed = pairs.select("a", "b", *[f(F.col(f"{s}.{c}"), compatible).alias(f"{s}_{c}") for s in "ab" for c, f in (("title", text.title_key), ("organizer_name", text.organizer_key))])
    scored = keyed.select(
        F.col("a.event_id").alias("event_id_a"), F.col("b.event_id").alias("event_id_b"), text.similarity("a_title", "b_title").alias("title_score"), times.date_score(F.col("a.event_start_at"), F.col("b.event_start_at")).alias("date_score"),
        text.similarity("a_organizer_name", "b_organizer_name").alias("organizer_score"), equal_given(F.col("a.event_format"), F.col("b.event_format")).alias("format_score"), anchor("a", "b").alias("deterministic_anchor"),
    )
    scored = scored.withColumn("url_score", F.when(F.col("deterministic_anchor") != "", F.lit(1.0)).otherwise(F.lit(0.0)))
    scored = scored.withColumn("total_score", total_score(F.col("title_score"), F.col("date_score"), F.col("organizer_score"), F.col("url_score"), F.col("format_score")))
    rounded = {c: F.bround(c, 4) for c in ("title_score", "organizer_score")}
    return scored.withColumns(rounded).withColumn("disposition", disposition(F.col("total_score"), F.col("deterministic_anchor")))


def candidate_pairs(events: DataFrame, keys: Column) -> DataFrame:
    """Pairs (a, b) of events that share one of ``keys`` (an array), the lesser id first, each pair once. Blocks bound the pairs that the quadratic similarity sees.

    Events that differ in nothing but their id are copies: the one of the least id stands for them in their blocks and is paired with each of them, so a group of copies costs what it has rows and no pair of different events is lost.
    """
    own = F.struct(*events.columns)
    content = F.sha2(F.to_json(F.struct(*[F.col(c) for c in events.columns if c != "event_id"]), {"ignoreNullFields": "false"}), 256)
    told = events.select(own.alias("e"), F.array_distinct(keys).alias("keys"), content.alias("content"))
    stands = told.groupBy("content").agg(F.min_by(F.struct("e", "keys"), F.col("e.event_id")).alias("r")).select("content", "r.e", "r.keys")
    copies = told.select(F.col("e").alias("b"), "content").join(stands.select(F.col("e").alias("a"), "content"), "content").filter("a.event_id < b.event_id").select("a", "b")
    keyed = stands.select("e", F.explode("keys").alias("key")).filter("key is not null and key <> ''")
    a, b = keyed.select(F.col("e").alias("a"), "key"), keyed.select(F.col("e").alias("b"), "key")
    pairs = a.join(b, "key").filter("a.event_id < b.event_id")
    pairs = pairs.groupBy(F.col("a.event_id").alias("x"), F.col("b.event_id").alias("y")).agg(F.any_value("a").alias("a"), F.any_value("b").alias("b")).select("a", "b")
    return pairs.unionByName(copies)


def priority(reasons: Column, now: Column, start: Column, deadline: Column) -> Column:
    """(priority, due): a deadline within three days is urgent; then high-impact changes, then a start within a week; what is past is low."""
    hours = F.expr(f"INTERVAL {URGENT_HOURS} HOURS")
    days = F.expr(f"INTERVAL {SOON_DAYS} DAYS")
    case = lambda name, due: F.struct(F.lit(name).alias("priority"), due.cast("timestamp").alias("due_at"))
    none = F.lit(None)
    return (
        F.when((deadline >= now) & (deadline <= now + hours), case("緊急", deadline))
        .when(F.array_contains(reasons, "HIGH_IMPACT_FIELD_CHANGED"), case("高", F.least(start, deadline)))
        .when((start >= now) & (start <= now + days), case("高", start))
        .when(start < now, case("低", none))
        .otherwise(case("通常", F.coalesce(deadline, start)))
    )


def suggested_action(reasons: Column, uncertain: Column) -> Column:
    risky = F.arrays_overlap(uncertain, F.array(*[F.lit(x) for x in codes.HIGH_RISK]))
    return F.when(F.array_contains(reasons, "DUPLICATE_CANDIDATE"), F.lit("統合")).when(F.array_contains(reasons, "LOW_EVENT_CONFIDENCE"), F.lit("非公開")).when(risky, F.lit("修正")).otherwise(F.lit("要確認付き公開"))


def route(items: DataFrame, now: str) -> DataFrame:
    """The review queue. ``items`` has event_id, reason_codes, uncertain_fields, source_urls, source_excerpt, event_start_at and application_deadline_at (timestamps); ``now`` is ISO text with an offset."""
    reasons, fields = text.ordered_distinct(F.col("reason_codes")), text.ordered_distinct(F.col("uncertain_fields"))
    routed = priority(reasons, F.to_timestamp(F.lit(now)), F.col("event_start_at"), F.col("application_deadline_at"))
    return items.select(
        codes.review_id(F.col("event_id"), reasons, F.lit(now)).alias("review_id"), "event_id", routed["priority"].alias("priority"), reasons.alias("reason_codes"), suggested_action(reasons, fields).alias("suggested_action"),
        text.excerpt(F.col("source_excerpt"), 300).alias("source_excerpt"), text.ordered_distinct(F.col("source_urls")).alias("source_urls"), fields.alias("uncertain_fields"), F.lit(now).alias("opened_at"), routed["due_at"].alias("due_at"),
        F.lit("未判断").alias("decision"), F.lit("次回も確認").alias("automation_choice"),
    )


def decision_error() -> Column:
    return (
        F.when(~F.col("decision").isin(list(codes.DECISIONS)), F.lit("unsupported decision"))
        .when(F.trim(F.coalesce("actor", F.lit(""))) == "", F.lit("actor is required"))
        .when((F.col("decision") == "修正後公開") & (F.coalesce(F.size("overrides"), F.lit(0)) < 1), F.lit("overrides are required"))
        .when((F.col("decision") == "重複統合") & (F.coalesce("canonical_id", F.lit("")) == ""), F.lit("a canonical event is required"))
        .when(F.col("approve_automation") & F.col("automation_choice").isin(list(codes.AUTOMATION)) & (F.coalesce("automation_condition", F.lit("")) == ""), F.lit("a condition is required"))
    )


def canonical_from_note(note: Column) -> Column:
    return text.blank_to_null(F.regexp_extract(note, r"canonical_event_id\s*=\s*(evt_[A-Za-z0-9_-]+)", 1))


def sorted_json(cells: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(cells))), {"ignoreNullFields": "false"})


def decide(reviews: DataFrame) -> DataFrame:
    """``reviews`` with ``error``, and where it is null ``after`` (the event's cells), ``action`` and ``rule`` (null unless automation is approved).

    Needs review_id, event_id, ``cells`` (the event as a map), decision, automation_choice, actor, acted_at (ISO text), note, overrides (map or null), canonical_id, approve_automation, automation_condition (JSON or null) and automation_scope.
    """
    d = F.col("decision")
    pair = lambda k, v: F.create_map(F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))
    changes = (
        F.when(d.isin("公開", "修正後公開"), F.map_concat(pair("publication_status", "公開"), pair("review_label", "なし")))
        .when(d == "要確認付き公開", F.map_concat(pair("publication_status", "公開"), pair("review_label", "あり")))
        .when(d == "非公開", F.map_concat(pair("publication_status", "非公開"), pair("review_label", "なし")))
        .when(d == "重複統合", F.map_concat(pair("publication_status", "非公開"), pair("duplicate_status", "統合済み"), pair("canonical_event_id", F.col("canonical_id"))))
    )

    def over(base: Column, top: Column) -> Column:
        return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(top, k)), top)

    given = F.coalesce("overrides", F.create_map().cast("map<string,string>"))
    after = over(over(F.col("cells"), given), F.map_concat(pair("review_status", "確認済み"), pair("last_admin_updated_at", F.col("acted_at")), changes))
    found = reviews.withColumn("error", decision_error()).withColumn("after", F.when(F.col("error").isNull(), after)).withColumn("action_id", codes.action_id(F.col("review_id"), F.col("event_id"), F.col("acted_at")))
    actor = F.trim("actor")
    action = F.struct(
        "action_id", "review_id", "event_id", codes.lookup(codes.DECISIONS, d).alias("action"), sorted_json(F.col("cells")).alias("before_json"), sorted_json(F.col("after")).alias("after_json"), "automation_choice", actor.alias("actor"), "acted_at",
        F.substring(F.trim(F.coalesce("note", F.lit(""))), 1, 500).alias("note"),
    )
    rule = F.struct(
        codes.rule_id(F.col("action_id"), F.col("automation_choice")).alias("rule_id"), F.lit(True).alias("enabled"), F.coalesce("automation_scope", F.lit("source")).alias("scope"), F.col("automation_condition").alias("condition_json"),
        codes.lookup(codes.AUTOMATION, F.col("automation_choice")).alias("action"), F.col("action_id").alias("approved_from_action_id"), actor.alias("approved_by"), F.col("acted_at").alias("approved_at"),
    )
    ok, automated = F.col("error").isNull(), F.col("approve_automation") & F.col("automation_choice").isin(list(codes.AUTOMATION))
    return found.withColumns({"action": F.when(ok, action), "rule": F.when(ok & automated, rule)}).drop("action_id")


def undecided(reviews: DataFrame, actions: DataFrame) -> DataFrame:
    """Reviews that no action has settled yet."""
    return reviews.join(actions.select("review_id").distinct(), "review_id", "left_anti")
