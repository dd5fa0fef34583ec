"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

A token's probability is that of its class given the context, times that of the token given its class and the context. The commonest ``CLASSES`` * ``WORDS`` tokens of the training corpus lie in ``CLASSES``
classes by falling count; all other words lie in ``FORMS`` open classes by their last two bytes. Within a class the softmax is factored again, into nested halves: a common class halves down to its
words, an open one by the bits of the word's hash down to leaves, whose number grows with the words met twice or more. A leaf splits by its words' counts, with one more count for
unknown words, which are thus as likely as words met once; so every word, known or not, has a probability, and they sum to one.

Features of a class are the token before, the one before that, the third before, and the first two together, hashed into ``ROWS`` rows of weights. Features of a halving are the word before and the one before that,
each as itself if it is among the ``CONTEXTS`` commonest, hashed with the halving into slots, whose number grows with the training tokens up to 2 ** ``SLOT_BITS``. Tasks take
gradient steps over their own documents in numpy batches and return their weights; means weighted by evidence, summed in two levels, start the next round. Counts cover the whole training corpus, and the exact count of
every token of every document is used: of the commonest (``CACHED`` at most) from a table sent to all tasks, of the others by a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, with_row_id
from .jaccard_join import LOWER, SPACE, _mixed, _word_hashes

#: Classes of common tokens, tokens in each (a power of two), and open classes.
CLASSES, WORDS, FORMS = 16, 64, 32
OUT = CLASSES + FORMS
#: Rows of hashed weights (a power of two).
ROWS = 1 << 13
#: Most commonest tokens whose counts every task gets (4 MB), and of them those that are contexts of their own.
CACHED, CONTEXTS = 1 << 18, 1 << 16
#: Bits of the number of slots, at least and at most (2 ** 21 weights take 8 MB), and halvings of an open class at most (deeper trees told held-out texts no better: gain over base 9.03 % at 8 and at 10 on sf0.1).
LEAST_BITS, SLOT_BITS, DEPTH = 12, 21, 8
#: Bits of a hash that tell where to look it up among the cached ones.
LOOK_BITS = 18
#: Passes over shares of the training documents, tokens of a gradient step, and rates for classes and halvings.
ROUNDS, STEP, RATE, HALF_RATE = 2, 8192, 0.5, 0.15
#: Copies of the weights that are trained at a time for each core, copies whose weights are summed together at the first level, and blocks that the weights are cut into.
COPIES, FAN, BLOCKS = 2, 64, 32
#: Counts below COARSE have a step of their own in the histogram of counts, greater ones STEPS for each doubling.
COARSE, STEPS = 256, 16
TEXT_BYTES = 1 << 20
#: How far back the words are that a halving's features look at.
BACK = (1, 2)
#: Rows of gradients that are added up side by side.
SHORT = 16
#: The end of a text as a token; no word hashes to it but by chance of 2**-64.
END = np.uint64(0x5851F42D4C957F2D)
LN10 = float(np.log(10))
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Tokens(NamedTuple):
    hashes: np.ndarray
    form: np.ndarray  # open class, as if every token were in one
    starts: np.ndarray  # first token of each text; each ends with END


def tokens(texts: list[bytes]) -> Tokens:
    """Tokens of some texts: runs of bytes other than white space (0x20, 0x09-0x0D), A-Z lower-cased, and an end for each text."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    words = _word_hashes(data)
    space = SPACE[data]
    heads = np.nonzero(~space & np.concatenate([[True], space[:-1]]))[0]
    tails = np.nonzero(~space & np.concatenate([space[1:], [True]]))[0]
    last = data[tails].astype(np.int64)
    before = np.where(tails > heads, data[np.maximum(tails - 1, 0)], 0).astype(np.int64)
    counts = np.diff(np.concatenate([[0], np.searchsorted(heads, np.cumsum([len(t) + 1 for t in texts]))]))
    starts = np.cumsum(counts + 1) - (counts + 1)
    n = len(words) + len(texts)
    inside = np.ones(n, dtype=bool)
    inside[starts + counts] = False
    hashes, form = np.full(n, END), np.zeros(n, np.int64)
    hashes[inside] = words
    form[inside] = (last * 31 + before * 17) % FORMS
    return Tokens(hashes, form, starts)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Some rows at a time, whole texts."""
    for b in batches:
        column = b.column("_text").cast(pa.binary()).to_pylist()
        first, size = 0, 0
        for i, t in enumerate(column):
            size += len(t)
            if size >= TEXT_BYTES or i + 1 == len(column):
                yield b.slice(first, i + 1 - first), column[first : i + 1]
                first, size = i + 1, 0


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _texts(batches):
        found = tokens(texts)
        hashes, first, n = np.unique(found.hashes, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(found.form[first].astype(np.int32)), pa.array(n)], names=["_h", "_form", "_n"])


def _halvings(mass: np.ndarray) -> np.ndarray:
    """(class, node): log odds of the right half at each node of a binary tree over the leaves' masses; the root is node 1, the halves of node x are 2x and 2x + 1, and node 0 is none."""
    levels = [mass]
    while levels[-1].shape[1] > 1:
        levels.append(levels[-1].reshape(len(mass), -1, 2).sum(axis=2))
    out = np.zeros(mass.shape, np.float32)
    for level in levels[:-1]:
        k = level.shape[1] // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            odds = np.log(level[:, 1::2]) - np.log(level[:, 0::2])
        out[:, k : 2 * k] = np.clip(np.nan_to_num(odds, nan=0.0), -30, 30)
    return out


class Model:
    """What scoring needs: some tens of MB at most, whatever the corpus."""

    def __init__(self, common: np.ndarray, counts: np.ndarray, total: int, distinct: int, leaf_tokens: np.ndarray):
        """``common``: hashes of the commonest tokens with ``counts``, commonest first; ``leaf_tokens``: tokens of each leaf (open class x leaf), the modelled ones not among them."""
        self.total, self.distinct, self.depth = total, distinct, leaf_tokens.shape[1].bit_length() - 1
        order = np.argsort(common, kind="stable")
        # One more than any hash ends the table; no word has it but by chance of 2**-64.
        self.cached, self.rank, self.by_rank = np.append(common[order], np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(order, CACHED), counts
        self.first = np.searchsorted(self.cached, np.arange(1 << LOOK_BITS, dtype=np.uint64) << np.uint64(64 - LOOK_BITS))
        self.leaf_size = leaf_tokens + 1.0
        own = np.zeros(CLASSES * WORDS)
        own[: len(counts)] = counts[: CLASSES * WORDS]
        own = own.reshape(CLASSES, WORDS)
        with np.errstate(divide="ignore"):
            self.class_bias = np.log(np.concatenate([own.sum(axis=1), self.leaf_size.sum(axis=1)]) / (own.sum() + self.leaf_size.sum())).astype(np.float32)
        # The halvings of all classes, one after the other.
        self.half_bias = np.concatenate([_halvings(own).ravel(), _halvings(self.leaf_size).ravel()])
        self.bits = int(min(max(int(total).bit_length(), LEAST_BITS), SLOT_BITS))
        self.class_weights, self.half_weights = np.zeros((ROWS, OUT), np.float32), np.zeros(1 << self.bits, np.float32)

    def ranks(self, found: Tokens) -> np.ndarray:
        """The place of each token among the commonest; beyond all of them for others. The upper bits of a hash tell where to look from."""
        at = self.first[(found.hashes >> np.uint64(64 - LOOK_BITS)).view(np.int64)]
        met = self.cached[at]
        behind = np.nonzero(met < found.hashes)[0]
        while len(behind):
            at[behind] += 1
            met[behind] = self.cached[at[behind]]
            behind = behind[met[behind] < found.hashes[behind]]
        return np.where(met == found.hashes, self.rank[at], CACHED)

    def symbols(self, found: Tokens, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, class) of each token: a modelled token is its own symbol, any other one is its open class."""
        symbol = np.where(rank < CLASSES * WORDS, rank, CLASSES * WORDS + found.form)
        return symbol, np.where(rank < CLASSES * WORDS, rank // WORDS, CLASSES + found.form)

    def leaves(self, found: Tokens) -> np.ndarray:
        """The leaf of each token, as if it were in an open class."""
        return (found.hashes >> np.uint64(64 - self.depth)).astype(np.int64) if self.depth else np.zeros(len(found.hashes), np.int64)

    def contexts(self, found: Tokens, rank: np.ndarray) -> np.ndarray:
        """The word before each token and the one before that: 2 x tokens."""
        n = len(rank)
        inside = np.arange(n) - np.repeat(found.starts, np.diff(np.append(found.starts, n)))
        own = np.where(rank < CONTEXTS, found.hashes, found.form.astype(np.uint64) + np.uint64(2))
        back = [np.where(inside >= k, np.concatenate([np.zeros(min(k, n), np.uint64), own[: max(n - k, 0)]]), np.uint64(1)) for k in BACK]
        return np.stack([_mixed(x + np.uint64(k << 40)) for k, x in enumerate(back)])

    def halves(self, contexts: np.ndarray, symbol: np.ndarray, of: np.ndarray, leaf: np.ndarray, state: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """Log probability of each token's (or leaf's) halvings given its class; with ``state`` a gradient step for each level, which changes the weights."""
        out, shift = np.zeros(len(of)), np.uint64(64 - self.bits)
        for common in (True, False):
            at = np.nonzero((of < CLASSES) == common)[0]
            depth = WORDS.bit_length() - 1 if common else self.depth
            base = of[at] * WORDS if common else CLASSES * WORDS + ((of[at] - CLASSES) << depth)
            way, some = symbol[at] % WORDS if common else leaf[at], contexts[:, at]
            for level in range(depth):
                ahead = way >> (depth - level - 1)
                node = base + (1 << level) + (ahead >> 1)
                slots = (some + node.view(np.uint64) * K1 >> shift).view(np.int64)
                z = self.half_bias[node]
                for slot in slots:
                    z += self.half_weights[slot]
                right = (ahead & 1).astype(np.float32)
                if state is None:
                    z *= 1 - 2 * right
                    out[at] -= np.log1p(np.exp(np.minimum(z, 80, out=z), out=z), out=z)
                    continue
                with np.errstate(over="ignore"):
                    gradient = 1 / (1 + np.exp(-z)) - right
                squared, gradient = gradient * gradient, -HALF_RATE * gradient
                for slot in slots:
                    np.add.at(state["half_size"], slot, squared)
                    np.add.at(self.half_weights, slot, gradient / np.sqrt(state["half_size"][slot]))
        return out

    def features(self, symbol: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """FEATURES x tokens: rows of weights."""
        n = len(symbol)
        inside = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        back = [np.where(inside >= k, np.concatenate([np.zeros(min(k, n), np.int64), symbol[: max(n - k, 0)] + 1]), 0).astype(np.uint64) for k in (1, 2, 3)]
        keys = (back[0] << np.uint64(2), back[1] << np.uint64(2) | np.uint64(1), back[2] << np.uint64(2) | np.uint64(2), (back[0] << np.uint64(20) | back[1]) << np.uint64(2) | np.uint64(3))
        return np.stack([_row(k) for k in keys])

    def class_probabilities(self, rows: np.ndarray) -> np.ndarray:
        return _softmax(_gathered(self.class_weights, rows) + self.class_bias)


def _row(key: np.ndarray) -> np.ndarray:
    h = (key + np.uint64(1)) * K1
    h = (h ^ h >> np.uint64(32)) * K2
    return (h >> np.uint64(65 - ROWS.bit_length())).astype(np.uint16 if ROWS <= 1 << 16 else np.int64)


def _gathered(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the rows of a table, one from each feature; the mode spares numpy a copy."""
    total, part = np.empty((rows.shape[1], table.shape[1]), np.float32), np.empty((rows.shape[1], table.shape[1]), np.float32)
    np.take(table, rows[0].astype(np.intp), axis=0, out=total, mode="clip")
    for r in rows[1:]:
        total += np.take(table, r.astype(np.intp), axis=0, out=part, mode="clip")
    return total


def _softmax(logits: np.ndarray) -> np.ndarray:
    if logits.max(initial=0) > 60:  # far from overflow there is nothing to take off first
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the rows from each cut to the next: short stretches are added up side by side, long ones one at a time."""
    sizes = np.diff(np.append(cuts, len(values)))
    total = np.take(values, cuts, axis=0, mode="clip")
    for i in range(1, SHORT):
        at = np.nonzero((sizes > i) & (sizes <= SHORT))[0]
        total[at] += np.take(values, cuts[at] + i, axis=0, mode="clip")
    for i in np.nonzero(sizes > SHORT)[0].tolist():
        total[i] = np.ones(sizes[i], np.float32) @ values[cuts[i] : cuts[i] + sizes[i]]
    return total


def _descend(weights: np.ndarray, seen: np.ndarray, size: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """One step: each row by the sum of its tokens' gradients, over the root of the squares so far."""
    for r in rows:
        order = np.argsort(r, kind="stable")
        ordered = r[order]
        cuts = np.nonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))[0]
        at, total = ordered[cuts], _sums(np.take(gradient, order, axis=0, mode="clip"), cuts)
        size[at] += np.einsum("ij,ij->i", total, total)
        seen[at] += np.diff(np.append(cuts, len(r)))
        weights[at] -= (RATE / np.sqrt(size[at]))[:, None] * total


def new_state(model: Model) -> dict[str, np.ndarray]:
    """Sums of squared gradients (from one up), and how often each row was seen."""
    return {"class_seen": np.zeros(ROWS, np.float32), "class_size": np.ones(ROWS, np.float32), "half_size": np.ones(1 << model.bits, np.float32)}


def train_step(model: Model, state: dict[str, np.ndarray], found: Tokens) -> None:
    """Gradient steps over some texts; changes ``model`` and ``state``."""
    rank = model.ranks(found)
    symbol, of = model.symbols(found, rank)
    rows, leaf, contexts = model.features(symbol, found.starts), model.leaves(found), model.contexts(found, rank)
    for a in range(0, len(symbol), STEP):
        part = slice(a, a + STEP)
        gradient = model.class_probabilities(rows[:, part])
        gradient[np.arange(len(gradient)), of[part]] -= 1
        _descend(model.class_weights, state["class_seen"], state["class_size"], rows[:, part], gradient)
        model.halves(contexts[:, part], symbol[part], of[part], leaf[part], state)


class Sums:
    """Weighted sums of one block of the weights of several copies. A payload holds rows of (class weights, evidence) in single precision, then slots' weights, then their evidence, in half precision."""

    ROW_BYTES = ROWS // BLOCKS * (OUT + 1) * 4

    def __init__(self) -> None:
        self.rows, self.slots = None, None

    def add(self, payload: bytes) -> None:
        rows, halves = np.frombuffer(payload[: self.ROW_BYTES], np.float32).reshape(-1, OUT + 1), np.frombuffer(payload[self.ROW_BYTES :], np.float16).reshape(2, -1).astype(np.float32)
        if self.rows is None:
            self.rows, self.slots = np.zeros(rows.shape, np.float32), np.zeros(halves.shape, np.float32)
        self.rows += np.concatenate([rows[:, :OUT] * rows[:, OUT:], rows[:, OUT:]], axis=1)
        self.slots += np.stack([halves[0] * halves[1], halves[1]])

    def means(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows, slots), each with its evidence last; weights without evidence are 0."""
        seen, size = self.rows[:, OUT:], self.slots[1]
        rows = np.concatenate([np.where(seen > 0, self.rows[:, :OUT] / np.maximum(seen, 1e-30), 0), seen], axis=1)
        return rows.astype(np.float32), np.stack([np.where(size > 0, self.slots[0] / np.maximum(size, 1e-30), 0), size])

    def payload(self) -> bytes:
        return packed(*self.means())


def packed(rows: np.ndarray, slots: np.ndarray) -> bytes:
    return rows.astype(np.float32).tobytes() + np.minimum(slots, 60000).astype(np.float16).tobytes()


def _sum_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (group, block): their payloads are added up one at a time."""
    now, total = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int32()), pa.array([total.payload()], pa.binary())], names=["_group", "_block", "_sum"])

    for b in batches:
        for i in range(b.num_rows):
            key = (b.column("_group")[i].as_py(), b.column("_block")[i].as_py())
            if key != now:
                if now:
                    yield done()
                now, total = key, Sums()
            total.add(b.column("_sum")[i].as_py())
    if now:
        yield done()


SUMMED = "_group long, _block int, _sum binary"


def _learn(docs: DataFrame, model: Model) -> Model:
    """One round: every task descends from ``model`` over its documents; weights become means weighted by the evidence that tasks had for them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.__dict__ = model.__dict__ | {"class_weights": model.class_weights.copy(), "half_weights": model.half_weights.copy()}
        state = new_state(model)
        for _, texts in _texts(batches):
            train_step(own, state, tokens(texts))
        if not state["class_seen"].any():
            return
        group = TaskContext.get().partitionId() // FAN
        rows = np.split(np.concatenate([own.class_weights, state["class_seen"][:, None]], axis=1), BLOCKS)
        slots = np.split(np.stack([own.half_weights, state["half_size"] - 1]), BLOCKS, axis=1)
        for i in range(BLOCKS):
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([i], pa.int32()), pa.array([packed(rows[i], slots[i])], pa.binary())], names=["_group", "_block", "_sum"])

    def level(df: DataFrame) -> DataFrame:
        return df.repartition("_group", "_block").sortWithinPartitions("_group", "_block").mapInArrow(_sum_blocks, SUMMED)

    copies = docs.coalesce(COPIES * max(docs.sparkSession.sparkContext.defaultParallelism, 1)).mapInArrow(run, SUMMED)
    found = {}
    for r in level(level(copies).withColumn("_group", F.lit(0).cast("long"))).toLocalIterator():
        total = Sums()
        total.add(bytes(r["_sum"]))
        found[r["_block"]] = total.means()
    if not found:
        return model
    rows, slots = np.concatenate([found[i][0] for i in range(BLOCKS)]), np.concatenate([found[i][1] for i in range(BLOCKS)], axis=1)
    new = Model.__new__(Model)
    new.__dict__ = model.__dict__ | {
        "class_weights": np.where(rows[:, OUT:] > 0, rows[:, :OUT], model.class_weights).astype(np.float32),
        "half_weights": np.where(slots[1] > 0, slots[0], model.half_weights).astype(np.float32),
    }
    return new


def commonest(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the commonest tokens, ``most`` at most, commonest first: a histogram of counts tells the least count of which no more have as many, so no task has to sort them."""
    step = F.when(F.col("_n") < COARSE, F.col("_n")).otherwise(COARSE + F.floor(F.log2(F.col("_n") / COARSE) * STEPS))
    seen, least = 0, None
    for r in sorted(counts.groupBy(step.cast("long").alias("step")).agg(F.count("*").alias("n"), F.min("_n").alias("least")).collect(), reverse=True):
        if seen + r["n"] > most:
            break
        seen, least = seen + r["n"], r["least"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.filter(F.col("_n") >= least).select("_h", "_n").toArrow().sort_by([("_n", "descending"), ("_h", "ascending")])
    return found["_h"].to_numpy().view(np.uint64), found["_n"].to_numpy()


def fit(rows: DataFrame, training: Column) -> tuple[Model, DataFrame]:
    """(model, counts of all training tokens) of the rows (_rid, _text) that ``training`` holds for; learning takes ROUNDS shares of them by turns."""
    own = rows.filter(training)
    counts = own.mapInArrow(_count, "_h long, _form int, _n long").groupBy("_h").agg(F.sum("_n").alias("_n"), F.max("_form").alias("_form"))
    counts = materialise(counts, "op6-counts")
    total = counts.agg(F.sum("_n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("_n") == 1).alias("once")).first()
    hashes, n = commonest(counts, CACHED)
    depth = min(max(((total["v"] - total["once"]) // FORMS).bit_length(), 1), DEPTH)
    modelled = counts.sparkSession.createDataFrame([(int(h),) for h in hashes[: CLASSES * WORDS].view(np.int64)], "_h long")
    place = F.col("_form").cast("long") * (1 << depth) + F.shiftrightunsigned("_h", 64 - depth)
    leaves = counts.join(F.broadcast(modelled), "_h", "left_anti").groupBy(place.alias("place")).agg(F.sum("_n").alias("n")).toArrow()
    sums = np.zeros(FORMS << depth)
    sums[leaves["place"].to_numpy()] = leaves["n"].to_numpy()
    model = Model(hashes, n, total["n"] or 0, total["v"], sums.reshape(FORMS, -1))
    for i in range(ROUNDS):
        model = _learn(own.filter(F.pmod(F.xxhash64("_rid"), F.lit(ROUNDS)) == i), model)
    return model, counts


def _scorer(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            found = tokens(texts)
            rank = model.ranks(found)
            symbol, of = model.symbols(found, rank)
            rows, leaf, contexts = model.features(symbol, found.starts), model.leaves(found), model.contexts(found, rank)
            value = np.zeros(len(symbol))
            for a in range(0, len(symbol), STEP):
                some = slice(a, a + STEP)
                classes = model.class_probabilities(rows[:, some])
                value[some] = np.log10(np.maximum(classes[np.arange(len(classes)), of[some]].astype(np.float64), 1e-30)) + model.halves(contexts[:, some], symbol[some], of[some], leaf[some]) / LN10
            hit, count = rank < CACHED, np.zeros(len(symbol))
            count[hit] = model.by_rank[rank[hit]]
            others = np.nonzero(of >= CLASSES)[0]
            # A token beyond the cached ones counts as unknown until the join finds it.
            value[others] += np.log10(np.where(hit[others], count[others], 1) / model.leaf_size[of[others] - CLASSES, leaf[others]])
            count = np.log10(count + 1)
            ends = np.append(found.starts[1:], len(symbol))
            rare = [found.hashes[a:b][~hit[a:b]].view(np.int64) for a, b in zip(found.starts.tolist(), ends.tolist(), strict=True)]
            sums = [np.add.reduceat(x, found.starts) for x in (value, count, hit.astype(np.int64))]
            columns = [pa.array(ends - found.starts), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), pa.array(rare, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("_rid"), part.column("_own"), *columns], names=["_rid", "_own", "_n", "_known", "_score", "_counts", "_rare"])

    return run


def score(docs: DataFrame, training: Column, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``; earlier columns of these names, in any case, give way.

    Words are runs of bytes other than white space (0x20, 0x09-0x0D), A-Z lower-cased; a text ends with one more token. ``training`` says of each row whether it is learnt from (null: not). ``base_score`` sums
    log10((c + 1) / (N + V + 1)) over tokens, with c the token's count, N all and V the distinct tokens in training; ``score`` is the model's log10 probability of the text. Words are told apart by 64-bit
    hashes. A null text counts as empty and has its end alone. Without a training row all counts are 0 and weights stay as they start. Repeated rows are scored, and learnt from, as often as they come; an empty table gives an
    empty result. ``docs`` is written once if it doesn't come straight from files.
    """
    new = {"n_tokens", "n_known", "train_tokens", "base_score", "score"}
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    rows = with_row_id(docs.select(F.struct(*own).alias("_own"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), F.coalesce(training, F.lit(False)).alias("_train")), "_rid")
    model, counts = fit(rows.select("_rid", "_text", "_train"), F.col("_train"))
    kind = rows.schema["_own"].dataType.simpleString()
    kept = F.struct(*[F.col(f"_own.`{c}`") for c in rows.schema["_own"].dataType.names if c != text_col] or [F.lit(None).alias("_none")])
    scored = rows.select("_rid", kept.alias("_own"), "_text")
    kind = scored.schema["_own"].dataType.simpleString()
    scored = materialise(scored.mapInArrow(_scorer(model), f"_rid long, _own {kind}, _n long, _known long, _score double, _counts double, _rare array<long>"), "op6-scored")
    rare = scored.select("_rid", F.explode("_rare").alias("_h")).join(counts.select("_h", F.col("_n").alias("_c")), "_h")
    rare = rare.groupBy("_rid").agg(F.sum(F.log10(F.col("_c") + 1)).alias("_more"), F.sum(F.log10(F.col("_c"))).alias("_better"), F.count("*").alias("_found"))
    out = scored.drop("_rare").join(rare, "_rid", "left")
    more, better, size = F.coalesce("_more", F.lit(0.0)), F.coalesce("_better", F.lit(0.0)), float(np.log10(model.total + model.distinct + 1))
    return out.select(
        "_own.*", F.col("_n").alias("n_tokens"), (F.col("_known") + F.coalesce("_found", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("_counts") + more - F.col("_n") * size).alias("base_score"), (F.col("_score") + better).alias("score"),
    )
