"""Extraction by a provider, asked only for what the cache lacks; what it says, cached or not, is validated each time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, validate

ANSWER = f"is_event boolean, event_confidence string, fields {validate.RAW}, review_reasons array<string>"
Provider = Callable[[str], dict]


def pending(request: str) -> dict:
    """The provider that is none: everything waits."""
    return {"is_event": False, "event_confidence": "0", "fields": {}, "review_reasons": ["AI_PENDING"]}


def prompt(requests: DataFrame, instructions: str) -> DataFrame:
    """``requests`` with ``messages``: instructions, and the text as JSON, so that nothing in it reads as an instruction."""
    body = F.to_json(F.struct("source_id", "source_url", "candidate_text", "allowed_urls"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return requests.withColumn("messages", F.array(message("system", F.lit(instructions)), message("user", F.concat(F.lit("untrusted source data: "), body))))


def extract(requests: DataFrame, cache: DataFrame, provider: Provider = pending, name: str = "none", model: str = "none", prompt_version: str = "1") -> tuple[DataFrame, DataFrame]:
    """(validated answers, new cache rows). ``requests`` has request_id, source_id, source_url, candidate_text, allowed_urls; ``cache`` has cache_key and the columns of an answer."""
    body = F.struct("source_id", "source_url", "candidate_text", "allowed_urls")
    keyed = requests.withColumn("cache_key", codes.cache_key(body, name, model, prompt_version))
    misses = keyed.join(cache.select("cache_key").distinct(), "cache_key", "left_anti").select("cache_key", F.to_json(body).alias("request")).dropDuplicates(["cache_key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"cache_key": k, **provider(r)} for k, r in zip(b["cache_key"], b["request"], strict=True)]
            yield pd.DataFrame(rows, columns=["cache_key", "is_event", "event_confidence", "fields", "review_reasons"])

    new = misses.mapInPandas(run, f"cache_key string, {ANSWER}")
    known = cache.withColumn("cache_hit", F.lit(True)).unionByName(new.withColumn("cache_hit", F.lit(False)))
    answered = keyed.join(known, "cache_key", "left")
    checked = answered.withColumn("v", validate.validated(F.coalesce("fields", F.create_map().cast(validate.RAW)), F.col("review_reasons"), F.col("allowed_urls")))
    out = checked.select("request_id", F.coalesce("is_event", F.lit(False)).alias("is_event"), validate.confidence(F.col("event_confidence")).alias("event_confidence"), "v.fields", "v.review_reasons", F.lit(name).alias("provider"), F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), "cache_hit")
    return out, new
