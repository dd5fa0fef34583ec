"""Change detection over a stream of fetched pages: the last hash of each URL is kept as state, and only pages that differ from it pass."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "url string, outcome string, body string, content_hash string"


def _compare(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    for b in batches:
        rows = []
        for body, digest in zip(b["body"], b["content_hash"], strict=True):
            same = digest == last
            rows.append((key[0], "not_modified" if same else "fetched", None if same else body, digest))
            last = digest
        yield pd.DataFrame(rows, columns=["url", "outcome", "body", "content_hash"])
    state.update((last,))


def changes(fetched: DataFrame) -> DataFrame:
    """(url, outcome, body, content_hash) for a stream of (url, body); pages of one URL in one micro-batch are compared in the order in which they come."""
    hashed = fetched.select("url", "body", F.sha2(F.col("body").cast("binary"), 256).alias("content_hash"))
    return hashed.groupBy("url").applyInPandasWithState(_compare, OUT, "last string", "append", GroupStateTimeout.NoTimeout)


def daily_counts(candidates: DataFrame, time_col: str = "ts", late: str = "1 day") -> DataFrame:
    """Candidates found per source and day, over a stream, with late ones up to ``late``."""
    return candidates.withWatermark(time_col, late).groupBy(F.window(time_col, "1 day").alias("day"), "source_id").agg(F.count("*").alias("n"))
