"""Resolution of fields: an active override beats the best accepted automatic value, which beats a fixed one.

Values are kept long, one row per event, field and source of the value, as JSON text or plain text. Every choice has a total order, so ties fall as they
stood in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _best(rows: DataFrame, keys: list[str], order: Column, *values: str) -> DataFrame:
    """One row per key: the greatest ``order``, the first position of equal ones. An aggregate with partial sums, as a window would sort all rows."""
    position = -F.col("pos")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(order.alias("o"), position.alias("p"))).alias("best"))


def best_override(overrides: DataFrame) -> DataFrame:
    """(event_id, field_name, value) of the latest active override; its value may be null and still wins. Needs active, updated_at and pos."""
    found = _best(overrides.filter("active"), ["event_id", "field_name"], F.col("updated_at"), "value")
    return found.select("event_id", "field_name", F.col("best.value").alias("value"))


def best_automatic(values: DataFrame) -> DataFrame:
    """(event_id, field_name, value, confidence) of the accepted value of the highest confidence, the latest extraction of equal ones; empty text counts, null doesn't."""
    found = _best(values.filter("accepted and value is not null"), ["event_id", "field_name"], F.struct("confidence", "extracted_at"), "value", "confidence")
    return found.select("event_id", "field_name", F.col("best.value").alias("value"), F.col("best.confidence").alias("confidence"))


def resolve_fields(wanted: DataFrame, automatic: DataFrame, overrides: DataFrame, fixed: DataFrame) -> DataFrame:
    """(event_id, field_name, value, origin, confidence) of each pair in ``wanted``; origin is override, auto, fixed or missing."""
    keys = ["event_id", "field_name"]
    over = best_override(overrides).select(*keys, F.struct("value", F.lit("override").alias("origin"), F.lit(None).cast("double").alias("confidence")).alias("o"))
    auto = best_automatic(automatic).select(*keys, F.struct("value", F.lit("auto").alias("origin"), "confidence").alias("a"))
    base = fixed.select(*keys, F.struct("value", F.lit("fixed").alias("origin"), F.lit(None).cast("double").alias("confidence")).alias("f"))
    missing = F.struct(F.lit(None).cast("string").alias("value"), F.lit("missing").alias("origin"), F.lit(None).cast("double").alias("confidence"))
    joined = wanted.join(over, keys, "left").join(auto, keys, "left").join(base, keys, "left")
    return joined.select(*keys, F.coalesce("o", "a", "f", missing).alias("r")).select(*keys, "r.*")


def widen(resolved: DataFrame, fields: list[str]) -> DataFrame:
    """One row per event, one column per field."""
    return resolved.groupBy("event_id").pivot("field_name", fields).agg(F.first("value"))
