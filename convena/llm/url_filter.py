"""URL filters as a sort-merge range join.

A host becomes a canonical key: its labels in reverse, each ended by a dot (``www.example.net`` -> ``net.example.www.``), so
a host and all its subdomains are one interval of keys, and the intervals of rules nest. URLs are dealt out by ranges of
(key, path); a rule goes to every range that its interval meets. Each range is then sorted once and swept: a stack holds the rules'
hosts around the current key, and the longest rule of the stack whose path the URL's path starts with decides.
A hot host is split over several ranges, as boundaries are taken from (key, path, row) and not from the key alone.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Sampled keys for each range when boundaries are chosen; boundaries steer the work and never the result.
SAMPLE_PER_RANGE, SAMPLE_MOST = 32, 1 << 15
LEAST, LAST_CHAR = -(1 << 63), "\U0010ffff"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: str) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: str) -> Column:
    """Labels in reverse, each ended by a dot; an empty host has an empty key, which no rule's interval holds."""
    return F.when(F.col(host) == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def reversed_key(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split("."))) if host else ""


def _sweep(batches: Iterable[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (range, key, kind): rules (kind 0) open before the URLs (kind 1) at their key."""
    stack: list[tuple[str, list[tuple[str, str, str]]]] = []  # (key, rules, longest path first) from the outermost host to the innermost
    now = None
    for batch in batches:
        keep, rules, verdicts = [], [], []
        columns = (batch.column(name).to_pylist() for name in ("_range", "_key", "_kind", "path", "_rule", "_verdict"))
        for part, key, kind, path, rule, verdict in zip(*columns, strict=True):
            if part != now:
                now, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            keep.append(kind == 1)
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                stack[-1][1].append((path, rule, verdict))
                stack[-1][1].sort(key=lambda x: (-len(x[0]), x[0], x[2] == "allow"))
                continue
            best = None
            for _, own in reversed(stack):
                fit = next((x for x in own if path.startswith(x[0])), None)
                if fit and (best is None or len(fit[1]) > len(best[1])):
                    best = fit
            rules.append(best[1] if best else None)
            verdicts.append(best[2] if best else default)
        rows = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([rows.column("_own"), rows.column("host"), rows.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["_own", "host", "path", "rule", "verdict"])


def _dealer(bounds: list[tuple[str, str, int]]):
    """Assigns each URL the range that (key, path, salt) falls into."""
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect.bisect_right(bounds, x) for x in zip(b.column("_key").to_pylist(), b.column("path").to_pylist(), b.column("_salt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(at, dtype=np.int32)), *b.columns], names=["_range", *b.schema.names])

    return deal


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; earlier columns of these names, in any case, give way.

    A rule fits its host and all subdomains if the URL's path starts with the rule's. The longest rule (host and path together) wins; of equally
    long ones the one with the longer host, and of the same rule twice ``block``. Without a rule the verdict is ``default``. Null or unparsable URLs have an empty host and path, which no rule
    fits (rules need a host). Repeated rows stay repeated; an empty table or an empty list of rules is allowed.
    """
    spark = pages.sparkSession
    new = {"host", "path", "rule", "verdict"}
    others = [c for c in pages.columns if c.lower() not in new]
    parsed = pages.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_own"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    parsed = parsed.withColumns({"_key": key_of("host"), "_salt": F.xxhash64(F.monotonically_increasing_id())})
    own = parsed.schema["_own"].dataType.simpleString()
    n = partitions(spark)
    # A share of the rows by hash: no task gathers or sorts them, and the driver gets SAMPLE_MOST of them at most, but for chance.
    share = min(min(n * SAMPLE_PER_RANGE, SAMPLE_MOST) / max(pages.count(), 1), 1)
    marks = sorted(map(tuple, parsed.select("_key", "path", "_salt").filter(F.xxhash64("_salt") <= int(LEAST + share * (2**64 - 1))).collect()))
    bounds = [marks[len(marks) * i // n] for i in range(1, n)] if marks else []
    ranged = parsed.mapInArrow(_dealer(bounds), f"_range int, _own {own}, host string, path string, _key string, _salt long")
    none = F.lit(None).cast("string")
    rows = ranged.select("_range", "_key", F.lit(1).alias("_kind"), "_own", "host", "path", none.alias("_rule"), none.alias("_verdict"))
    openers = []
    for r in rules:
        if key := reversed_key(r.host):
            first, last = bisect.bisect_left(bounds, (key, "", LEAST)), bisect.bisect_right(bounds, (key + LAST_CHAR, "", LEAST))
            openers += [(part, key, 0, None, r.host, r.path, r.name, r.verdict) for part in range(first, last + 1)]
    rows = rows.unionByName(spark.createDataFrame(openers, rows.schema))
    dealt = rows.repartitionById(len(bounds) + 1, F.col("_range")).sortWithinPartitions("_range", "_key", "_kind")
    swept = dealt.mapInArrow(lambda batches: _sweep(batches, default), f"_own {own}, host string, path string, rule string, verdict string")
    return swept.select("_own.*", "host", "path", "rule", "verdict")
