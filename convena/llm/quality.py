"""Document quality by hierarchical empirical Bayes.

Three levels of evidence meet in one posterior. A document's own evidence is a log-likelihood ratio from a logistic classifier over all words and shapes of text that tell good documents from bad ones significantly, fitted to a
bounded sample of labelled documents. A host's posterior shrinks its share of good documents toward the global one, a path's shrinks toward its host's; how strongly is estimated from
how much the groups differ (empirical Bayes). So a sparse site stands near its parent and a well-known one on its own record. All levels are grouped sums with partial aggregation, so a hot host costs what any does.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise
from .jaccard_join import LOWER, SPACE, _word_hashes

#: Buckets of hashed words (a power of two); features of shape follow them, BINS for each.
WORDS, BINS, SHAPES = 1 << 20, 16, 6
FEATURES = WORDS + BINS * SHAPES
#: Features that the classifier weighs: all whose shares in good and bad documents differ by Z standard errors or more, if so many documents have them.
Z, SUPPORT = 4.0, 8
#: Strength of the ridge that holds weights near 0, and the furthest that a document's evidence goes either way.
RIDGE, LIMIT = 1.0, 40.0
#: Weight in the posteriors of hosts and paths of a document that is not labelled: it counts as good by its own probability.
SOFT = 0.1
#: Bounds of the prior strength in labelled documents.
WEAK, STRONG = 2.0, 1000.0
#: Labelled documents that the classifier is fitted to, about; the posteriors of hosts and paths take all labels.
FITTED_ROWS = 1 << 16
TEXT_BYTES = 1 << 20
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
DIGIT = np.array([48 <= b <= 57 for b in range(256)])
PLAIN = LETTER | DIGIT | SPACE | np.isin(np.arange(256), np.frombuffer(b".,;:'\"-?!()", np.uint8))


class Model(NamedTuple):
    chosen: np.ndarray  # features, rising
    weights: np.ndarray  # of each
    offset: float  # log-odds of good = offset + sum of the weights of the features that a document has
    base: float  # log-odds of good in the labelled documents


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) for each feature that a document has."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = LOWER[raw]
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], ends[:-1]])
    # Words are runs of letters and digits here, so that punctuation makes no other word.
    data = np.where(LETTER[data] | DIGIT[data], data, 32).astype(np.uint8)
    hashes = _word_hashes(data)
    space = SPACE[data]
    heads = np.nonzero(~space & np.concatenate([[True], space[:-1]]))[0]
    of = np.searchsorted(ends, heads, side="right")
    pairs = np.unique(of.astype(np.int64) * WORDS + (hashes >> np.uint64(65 - WORDS.bit_length())).astype(np.int64))
    n = len(texts)
    words = np.bincount(of, minlength=n)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[np.append(starts, len(raw))])
    size, solid = np.maximum(ends - starts - 1, 1), np.maximum(total(~space), 1)
    share = lambda x: np.minimum((np.sqrt(x) * BINS).astype(np.int64), BINS - 1)
    shapes = [
        share(total(~PLAIN[raw]) / size),
        share(np.bincount(of[same], minlength=n) / np.maximum(words, 1)),
        share(total(DIGIT[raw]) / solid),
        share(total((raw >= 65) & (raw <= 90)) / solid),
        np.minimum(np.log2(words + 1), BINS - 1).astype(np.int64),
        np.minimum(solid // np.maximum(words, 1), BINS - 1),
    ]
    docs = np.concatenate([pairs // WORDS, np.tile(np.arange(n), SHAPES)])
    return docs, np.concatenate([pairs % WORDS, *(WORDS + BINS * k + x for k, x in enumerate(shapes))])


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        column = b.column("_text").cast(pa.binary()).to_pylist()
        first, size = 0, 0
        for i, t in enumerate(column):
            size += len(t)
            if size >= TEXT_BYTES or i + 1 == len(column):
                yield b.slice(first, i + 1 - first), column[first : i + 1]
                first, size = i + 1, 0


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature, how many good and bad documents have it; the documents themselves are feature -1."""
    good, bad = np.zeros(FEATURES + 1, np.int64), np.zeros(FEATURES + 1, np.int64)
    for part, texts in _texts(batches):
        is_good = part.column("_good").to_numpy(zero_copy_only=False).astype(bool)
        docs, found = features(texts)
        good += np.bincount(found[is_good[docs]] + 1, minlength=FEATURES + 1)
        bad += np.bincount(found[~is_good[docs]] + 1, minlength=FEATURES + 1)
        good[0] += is_good.sum()
        bad[0] += (~is_good).sum()
    at = np.nonzero(good + bad)[0]
    yield pa.RecordBatch.from_arrays([pa.array((at - 1).astype(np.int32)), pa.array(good[at]), pa.array(bad[at])], names=["_f", "_g", "_b"])


def _having(chosen: np.ndarray):
    """The chosen features that each document has, by their place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            docs, found = features(texts)
            at = np.minimum(np.searchsorted(chosen, found), len(chosen) - 1)
            hit = chosen[at] == found
            docs, at = docs[hit], at[hit].astype(np.int32)
            order = np.argsort(docs, kind="stable")
            lists = np.split(at[order], np.searchsorted(docs[order], np.arange(1, len(texts))))
            yield pa.RecordBatch.from_arrays([part.column("_good"), pa.array(lists, pa.list_(pa.int32()))], names=["_good", "_x"])

    return run


def _evidence(models: list[Model]):
    """Log-odds of each aspect by a document's features."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((FEATURES, len(models)), np.float32)
        for i, m in enumerate(models):
            table[m.chosen, i] = m.weights
        for part, texts in _texts(batches):
            docs, found = features(texts)
            sums = np.stack([m.offset + np.bincount(docs, weights=table[found, i], minlength=len(texts)) for i, m in enumerate(models)], axis=1)
            yield pa.RecordBatch.from_arrays([part.column("_own"), pa.array(list(np.clip(sums, -LIMIT, LIMIT)), pa.list_(pa.float64()))], names=["_own", "_logit"])

    return run


def fit(labelled: DataFrame) -> Model | None:
    """A model of (_text, _good), of which there are no more than the driver can hold some numbers each; None if there is not a good and a bad document."""
    counts = labelled.mapInArrow(_count, "_f int, _g long, _b long").groupBy("_f").agg(F.sum("_g").alias("_g"), F.sum("_b").alias("_b"))
    rows = counts.filter((F.col("_g") + F.col("_b") >= SUPPORT) | (F.col("_f") < 0)).toArrow()
    f, g, b = (rows[c].to_numpy().astype(np.int64) for c in ("_f", "_g", "_b"))
    goods, bads = int(g[f < 0].sum()), int(b[f < 0].sum())
    if not goods or not bads:
        return None
    base = float(np.log(goods / bads))
    f, g, b = f[f >= 0], g[f >= 0], b[f >= 0]
    mean = (g + b) / (goods + bads)
    z = np.abs(g / goods - b / bads) / np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / goods + 1 / bads))
    chosen = np.sort(f[z >= Z])
    if not len(chosen):
        return Model(chosen, np.zeros(0), base, base)
    had = labelled.mapInArrow(_having(chosen), "_good boolean, _x array<int>").toArrow()
    y = had["_good"].to_numpy(zero_copy_only=False).astype(float)
    lists = had["_x"].combine_chunks()
    theta = _logistic(y, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), len(chosen), base)
    return Model(chosen, theta[:-1], float(theta[-1]), base)


def _logistic(y: np.ndarray, lengths: np.ndarray, at: np.ndarray, width: int, base: float) -> np.ndarray:
    """Weights of ``width`` features and the offset; row i of the design has a 1 for each of its ``lengths[i]`` places in ``at``, so only those are held. Newton's method, its steps by conjugate gradients."""
    row = np.repeat(np.arange(len(y), dtype=np.int32), lengths)
    ridge = np.append(np.full(width, RIDGE), 1e-6)
    onto = lambda t: np.bincount(row, weights=t[at], minlength=len(y)) + t[-1]
    back = lambda r: np.append(np.bincount(at, weights=r[row], minlength=width), r.sum())
    loss = lambda t, margin: float(np.logaddexp(0, margin).sum() - y @ margin + ridge @ (t * t) / 2)
    theta = np.append(np.zeros(width), base)
    margin = onto(theta)
    now = loss(theta, margin)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        gradient = back(y - p) - ridge * theta
        spread = p * (1 - p)
        scale = back(spread) + ridge
        step, left = np.zeros(width + 1), gradient.copy()
        eased = left / scale
        way, size = eased.copy(), left @ eased
        target = size * 1e-2  # a rough step is enough, as the next starts from a gradient of its own
        for _ in range(200):
            if size <= target:
                break
            bent = back(spread * onto(way)) + ridge * way
            far = size / (way @ bent)
            step += far * way
            left -= far * bent
            eased = left / scale
            size, before = left @ eased, size
            way = eased + size / before * way
        while (new := loss(theta + step, moved := onto(theta + step))) > now and np.abs(step).max() > 1e-6:  # halved until it helps
            step /= 2
        if new > now:
            break
        theta, margin, gain, now = theta + step, moved, now - new, new
        if gain < 1e-6 * len(y):
            break
    return theta


def _strength(groups: DataFrame, n: str, good: str, mean: Column) -> float:
    """Prior strength by moments: the variance of groups' shares about their parents' mean, beyond what chance gives."""
    m = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), mean))
    chance = m * (1 - m)
    row = groups.filter(F.col(n) > 1).agg(F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - m, 2)).alias("v"), F.sum(chance).alias("c"), F.sum(F.col(n) * chance).alias("w")).first()
    if not row["w"]:
        return STRONG
    excess = max(row["v"] - row["c"], 0.0) / max(row["w"] - row["c"], 1e-9)  # share of the variance that is between groups
    return float(min(max((1 - excess) / max(excess, 1e-9), WEAK), STRONG))


def posteriors(docs: DataFrame, labels: DataFrame, training: Column, host_col: str, path_col: str, aspects: tuple[str, ...] = ("good",), id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Per document: the id, ``score`` (posterior probability that every aspect is good), ``doc_score``, ``host_score`` and ``path_score`` (the same of its text, host and path alone), ``<aspect>_score`` of each aspect,
    ``kept`` (every aspect's score >= ``least``) and the host and path as ``host`` and ``path``.

    ``labels`` has the id and a boolean column for each aspect. Aspects have models and posteriors of their own, as what tells one apart says little of another; documents of which ``training`` holds are learnt from. A label that is null
    or whose id is null counts for nothing; an id that is labelled twice is good if every label says so. A null text counts as empty, a null host or path as a group of its own. An aspect without labels of both kinds is passed over; if that leaves
    none, every document scores 0.5 and is kept. Repeated rows stay repeated; an empty table gives an empty result.
    """
    said = labels.select(F.col(id_col).alias("_key"), *[F.col(a).alias(f"_good_{a}") for a in aspects]).filter("_key is not null").groupBy("_key").agg(*[F.bool_and(f"_good_{a}").alias(f"_good_{a}") for a in aspects])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")
    place = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")).alias(n) for c, n in ((host_col, "host"), (path_col, "path"))]
    rows = docs.select(F.col(id_col).alias("_id"), *place, F.coalesce(training, F.lit(False)).alias("_train"), text)
    said = materialise(said, "op4-labels")
    # The classifier takes its labels by a hash of their id, one in so many that the sample can go to every task and texts needn't be shuffled.
    share = -(-said.count() // FITTED_ROWS) or 1
    sample = materialise(said.filter(F.pmod(F.xxhash64("_key"), F.lit(share)) == 0), "op4-sample")
    known = rows.filter("_train").join(bounded(sample), F.col("_id") == F.col("_key"))
    models = {a: fit(known.filter(f"_good_{a} is not null").select(F.col(f"_good_{a}").alias("_good"), "_text")) for a in aspects}
    models = {a: m for a, m in models.items() if m}
    shown = [F.nullif(F.col(c), F.lit("\0")).alias(c) for c in ("host", "path")]
    if not models:
        half = [F.lit(0.5).alias(c) for c in ("score", "doc_score", "host_score", "path_score", *[f"{a}_score" for a in aspects])]
        return rows.select(F.col("_id").alias(id_col), *shown, *half, F.lit(True).alias("kept"))
    own = F.struct("_id", "host", "path", "_train").alias("_own")
    kind = rows.select(own).schema["_own"].dataType.simpleString()
    scored = rows.select(own, "_text").mapInArrow(_evidence(list(models.values())), f"_own {kind}, _logit array<double>").select("_own.*", "_logit")
    scored = materialise(scored.join(said, F.col("_id") == F.col("_key"), "left").drop("_key"), "op4-evidence")
    logit = {a: F.col("_logit")[i] for i, a in enumerate(models)}
    chance = {a: 1 / (1 + F.exp(-x)) for a, x in logit.items()}
    sums = []
    for a in models:
        labelled = F.col("_train") & F.col(f"_good_{a}").isNotNull()
        sums += [F.sum(F.when(labelled, 1.0).otherwise(SOFT)).alias(f"n_{a}"), F.sum(F.when(labelled, F.col(f"_good_{a}").cast("double")).otherwise(SOFT * chance[a])).alias(f"s_{a}")]
    groups = materialise(scored.groupBy("host", "path").agg(*sums), "op4-paths")
    hosts = materialise(groups.groupBy("host").agg(*[F.sum(f"{x}_{a}").alias(f"{x}_{a}") for a in models for x in "ns"]), "op4-hosts")
    total = hosts.agg(*[(F.sum(f"s_{a}") / F.sum(f"n_{a}")).alias(a) for a in models]).first()
    for a in models:
        overall = F.lit(0.5 if total[a] is None else total[a])
        k = _strength(hosts, f"n_{a}", f"s_{a}", overall)
        hosts = hosts.withColumn(f"host_{a}", (F.col(f"s_{a}") + k * overall) / (F.col(f"n_{a}") + k))
    paths = groups.join(hosts.select("host", *[f"host_{a}" for a in models]), "host")
    for a in models:
        k = _strength(paths, f"n_{a}", f"s_{a}", F.col(f"host_{a}"))
        paths = paths.withColumn(f"path_{a}", (F.col(f"s_{a}") + k * F.col(f"host_{a}")) / (F.col(f"n_{a}") + k))
    paths = materialise(paths.select("host", "path", *[f"{x}_{a}" for a in models for x in ("host", "path")]), "op4-posteriors")
    prior = {a: F.log(F.col(f"path_{a}") / (1 - F.col(f"path_{a}"))) for a in models}
    score = {a: 1 / (1 + F.exp(-(prior[a] + logit[a] - F.lit(m.base)))) for a, m in models.items()}
    product = lambda columns: functools.reduce(operator.mul, columns)
    out = scored.join(paths, ["host", "path"])
    whole = [product(score.values()).alias("score"), product(chance.values()).alias("doc_score"), product(F.col(f"host_{a}") for a in models).alias("host_score"), product(F.col(f"path_{a}") for a in models).alias("path_score")]
    each = [score.get(a, F.lit(0.5)).alias(f"{a}_score") for a in aspects]
    return out.select(F.col("_id").alias(id_col), *shown, *whole, *each, functools.reduce(operator.and_, [x >= least for x in score.values()]).alias("kept"))
