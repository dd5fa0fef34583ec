"""Language identification by error-correcting output codes.

Each language has a codeword of bits; each bit is a binary classifier over hashed byte n-grams that tells the languages whose bit is 1 from
the others. A text's bits are decoded to the nearest codeword: the loss of each bit counts by how often its classifier was right on
training texts of that language (loss-weighted decoding). A text whose two nearest codewords are almost equally far is flagged as ambiguous.

Classifiers are log-odds of n-gram counts summed over all training rows; counting and scoring are one pass each, in numpy over Arrow batches,
and what is sent to executors is bounded: ``BUCKETS`` weights for each bit, of which there are 10 log2(languages).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Buckets of hashed n-grams, and the lengths of n-grams in bytes.
BUCKETS, ORDERS = 1 << 15, (2, 3, 4)
#: Up to so many languages a task counts in one dense table and the driver gets all counts; beyond that counts stay rows of (language, bucket), and only sums for each bit reach the driver.
DENSE = 64
#: Up to so many languages the best of 64 random codes is taken; beyond that, the first with distinct words.
COMPARED = 1024
#: Bits that margins are summed for at a time, and numbers that decoding holds at a time.
BITS, DECODED = 16, 1 << 22
#: Up to so many languages every possible bit is used; beyond that 10 log2(languages) random ones.
EXHAUSTIVE = 7
SMOOTHING = 0.5
#: A difference of distances under which a decision is flagged as ambiguous.
AMBIGUOUS = 0.02
CHUNK = 1 << 18  # bytes of text that numpy works on at a time
PAD = 3
UNDETERMINED = "und"
#: Letters in lower case, any other ASCII a space; bytes of other characters as they are.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # (buckets + 1) x bits
    scale: np.ndarray  # of each bit's margin
    trust: np.ndarray  # languages x bits: weights of losses, each row sums to 1


def codewords(n: int) -> np.ndarray:
    """n x bits; no two columns say the same, none is constant."""
    if n == 1:
        return np.ones((1, 1))
    if n <= EXHAUSTIVE:
        columns = [[1, *(1 if c >> i & 1 else -1 for i in range(n - 1))] for c in range(2 ** (n - 1) - 1)]
        return np.array(columns, dtype=float).T
    best, spread = None, -1
    rng = np.random.default_rng(20240101)
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], size=(n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        if n > COMPARED:
            if len(np.unique(code, axis=0)) == n:
                return code
            continue
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]
        if apart.min() > spread:
            best, spread = code, apart.min()
    return best


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, buckets of n-grams order by order, start of each row's n-grams). Whole texts, some at a time."""
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        n = last - first
        starts = offsets[first : last + 1] - offsets[first] + PAD * np.arange(n + 1)
        whole = np.full(starts[-1] + PAD, 32, dtype=np.uint32)
        inside = np.ones(starts[-1], dtype=bool)
        inside[(starts[:-1, None] + np.arange(PAD)).ravel()] = False
        whole[: starts[-1]][inside] = FOLD[data[offsets[first] : offsets[last]]]
        size, found, gram = starts[-1], [], whole
        for k in range(2, max(ORDERS) + 1):
            gram = gram[:-1] << np.uint32(8) | whole[k - 1 :]
            if k in ORDERS:
                hashed = (gram ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
                hashed = (hashed ^ hashed >> np.uint32(15)) * np.uint32(2246822519)
                found.append((hashed >> np.uint32(17))[:size])
        yield first, last, np.stack([np.pad(x, (0, size - len(x))) for x in found]).astype(np.int32), starts[:-1]
        first = last


def _counter(languages: list[str]):
    index = {x: i for i, x in enumerate(languages)}

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([index[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for first, last, buckets, starts in _chunks(batch.column("text")):
                row = np.repeat(of[first:last] * BUCKETS, np.diff(np.append(starts, buckets.shape[1])))
                at, n = np.unique(row + buckets, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((at // BUCKETS).astype(np.int32)), pa.array((at % BUCKETS).astype(np.int32)), pa.array(n)], names=["l", "b", "c"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, dtype=np.int64)
        for batch in batches:
            of = np.array([index[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for first, last, buckets, starts in _chunks(batch.column("text")):
                size = buckets.shape[1]
                row = np.repeat(of[first:last] * BUCKETS, np.diff(np.append(starts, size)))
                for one in buckets:
                    total += np.bincount(row + one, minlength=len(total))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array((at // BUCKETS).astype(np.int32)), pa.array((at % BUCKETS).astype(np.int32)), pa.array(total[at])], names=["l", "b", "c"])

    return count if len(languages) <= DENSE else rows


def _bit_sums(code: np.ndarray, totals: np.ndarray):
    """For each bucket, the sum over languages of its share in a language: of all of them, then of those whose bit is 1, bit by bit. Each bucket's rows are in one task."""
    ones = np.concatenate([np.ones((len(code), 1)), code > 0], axis=1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, ones.shape[1]))
        for batch in batches:
            l, b, c = (batch.column(x).to_numpy() for x in "lbc")
            np.add.at(sums, b, (c / totals[l])[:, None] * ones[l])
        at = np.nonzero(sums[:, 0])[0]
        for a in range(0, len(at), 4096):
            some = at[a : a + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["b", "sums"])

    return run


def _sparse_weights(counts: DataFrame, code: np.ndarray) -> np.ndarray:
    """What ``fit`` computes from a dense table of counts, from rows of them."""
    counts = materialise(counts, "op1-counts")
    totals = np.full(len(code), SMOOTHING * BUCKETS)
    for r in counts.groupBy("l").agg(F.sum("c").alias("c")).collect():
        totals[r["l"]] += r["c"]
    sums = np.zeros((BUCKETS, code.shape[1] + 1))
    got = counts.repartition("b").sortWithinPartitions("b", "l").mapInArrow(_bit_sums(code, totals), "b int, sums array<double>").toArrow()
    sums[got["b"].to_numpy()] = got["sums"].combine_chunks().flatten().to_numpy().reshape(-1, sums.shape[1])
    ones = code > 0
    sums += SMOOTHING * np.append((1 / totals).sum(), (1 / totals) @ ones)
    n = ones.sum(axis=0)
    return (np.log(sums[:, 1:] / n) - np.log(np.maximum(sums[:, :1] - sums[:, 1:], 1e-300) / (len(code) - n))).astype(np.float32)


def _margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """rows x bits: mean log-odds of each row's n-grams."""
    out = np.zeros((len(texts), weights.shape[1]))
    parts, done = [np.ascontiguousarray(weights[:, a : a + BITS]) for a in range(0, weights.shape[1], BITS)], 0
    for first, last, buckets, starts in _chunks(texts):
        size = buckets.shape[1]
        lengths = np.diff(np.append(starts, size))
        for some in parts:
            total = np.zeros((size, some.shape[1]), dtype=np.float32)
            for one in buckets:
                total += some[one]
            out[first:last, done : done + some.shape[1]] = np.add.reduceat(total, starts, axis=0, dtype=np.float64) / (lengths * len(ORDERS))[:, None]
            done = (done + some.shape[1]) % weights.shape[1]
    return out


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest codeword, score from 0 to 1, ambiguous) of each row: the score is the share of the nearest in exp(-bits x distance)."""
    most = max(DECODED // model.code.size, 1)
    if len(margins) > most:
        parts = [decode(model, margins[a : a + most]) for a in range(0, len(margins), most)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    agree = model.code[None] * (margins / model.scale)[:, None]
    distance = (np.logaddexp(0, -4 * agree) * model.trust[None]).sum(axis=2)
    best = distance.argmin(axis=1)
    least = distance.min(axis=1)
    share = 1 / np.exp(-model.code.shape[1] * (distance - least[:, None])).sum(axis=1)
    second = np.sort(distance, axis=1)[:, 1] if distance.shape[1] > 1 else least + 1
    return best, share, second - least < AMBIGUOUS


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the rows with a non-null language and text; None if there are none."""
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    languages = sorted(r["lang"] for r in rows.groupBy("lang").agg(F.lit(1)).collect())
    if not languages:
        return None
    code = codewords(len(languages))
    rows_of_counts = rows.mapInArrow(_counter(languages), "l int, b int, c long").groupBy("l", "b").agg(F.sum("c").alias("c"))
    weights = _dense_weights(rows_of_counts, code) if len(languages) <= DENSE else _sparse_weights(rows_of_counts, code)
    index = {x: i for i, x in enumerate(languages)}

    def right(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, seen, sizes = np.zeros(code.shape), np.zeros(len(languages)), np.zeros(code.shape[1])
        for batch in batches:
            of = np.array([index[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            margins = _margins(batch.column("text"), weights)
            np.add.at(hits, of, margins * code[of] > 0)
            np.add.at(seen, of, 1)
            sizes += np.abs(margins).sum(axis=0)
        for k, i in enumerate(np.nonzero(seen)[0].tolist()):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([seen[i]]), pa.array([hits[i]], pa.list_(pa.float64())), pa.array([sizes * (k == 0)], pa.list_(pa.float64()))], names=["l", "n", "hits", "sizes"])

    bits = range(code.shape[1])
    sums = [F.sum(F.col("hits")[b]).alias(f"h{b}") for b in bits] + [F.sum(F.col("sizes")[b]).alias(f"s{b}") for b in bits]
    said = {r["l"]: r for r in rows.mapInArrow(right, "l int, n double, hits array<double>, sizes array<double>").groupBy("l").agg(F.sum("n").alias("n"), *sums).collect()}
    seen = sum(r["n"] for r in said.values())
    trust = np.array([[(said[i][f"h{b}"] + 1) / (said[i]["n"] + 2) for b in bits] for i in range(len(languages))])
    scale = np.maximum(np.array([sum(r[f"s{b}"] for r in said.values()) / seen for b in bits]), 1e-9)
    return Model(languages, code, weights, scale, trust / trust.sum(axis=1, keepdims=True))


def _dense_weights(rows_of_counts: DataFrame, code: np.ndarray) -> np.ndarray:
    counts = np.zeros((len(code), BUCKETS))
    got = rows_of_counts.toArrow()
    counts[got["l"].to_numpy(), got["b"].to_numpy()] = got["c"].to_numpy()
    likely = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
    weights = np.zeros((BUCKETS, code.shape[1]), dtype=np.float32)
    for bit in range(code.shape[1]):
        ones = code[:, bit] > 0
        if not ones.all():
            weights[:, bit] = np.log(likely[ones].mean(axis=0)) - np.log(likely[~ones].mean(axis=0))
    return weights


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None, text_col: str | tuple[str, str] = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``; earlier columns of these names, in any case, give way. ``text_col`` is a column, or a struct column and its field, so that no text travels twice.

    A null text and one without a letter are ``und`` with score 0, and so is every text if the model is None. Only the text is looked at.
    Rows and their order within a partition stay as they are; an empty table gives an empty result.
    """
    new = {"lang_pred", "score", "ambiguous"}
    kept = [c for c in docs.columns if c.lower() not in new]
    if model is None:
        found = [F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")]
        return docs.select(*[F.col(f"`{c}`") for c in kept], *found)
    path = (text_col,) if isinstance(text_col, str) else text_col
    quoted = ".".join(f"`{x}`" for x in path)
    # A text that the row itself holds is not sent to Python a second time.
    inside = path[0] in kept
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_own"), *([] if inside else [F.col(quoted).alias("_text")]), has_letter(quoted).alias("_letter"))
    named = np.array(model.languages, dtype=object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column("_own"), list(path)) if inside else batch.column("_text")
            best, score, unsure = decode(model, _margins(texts, model.weights))
            letter = batch.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_own"), pa.array(np.where(letter, named[best], UNDETERMINED), pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(unsure & letter)], names=["_own", "lang_pred", "score", "ambiguous"]
            )

    return own.mapInArrow(run, f"_own {own.schema['_own'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean").select("_own.*", "lang_pred", "score", "ambiguous")
