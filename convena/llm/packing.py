"""Packing of tokenised documents into sequences by the linear grouping scheme.

Only the histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) reaches the driver. There large lengths are cut into groups of
equal cardinality and rounded up to the longest of their group; a linear program over configurations of the few sizes left (columns generated by
a knapsack) says how often each configuration is used. Actual documents then take the places of rounded ones, which leaves known room in each
sequence; what is left, large ones of no whole configuration and all small ones, goes best-fit into the least room that holds it.

The plan is a list of intervals: pieces in falling order of length, so many from here on, go to sequences so many from there on. So every piece
finds its sequence from its length and its rank among equal lengths, which tasks count locally and a sum over tasks shifts.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Groups of large lengths, and the share of the capacity over which a length is large.
GROUPS, LARGE = 128, 0.45
#: Most columns that the linear program generates; it stops earlier when none gains.
COLUMNS = 2000
#: Fixed value: the pattern by which byte-level pre-tokenizers split.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Interval = tuple[int, int, int]  # first place in falling order of length, pieces, first sequence


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many of each size) and how often each is used, rounded down from the linear program's optimum."""
    n = len(sizes)
    size, want = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag((capacity // size).astype(float))
    level = want / np.diag(basis)
    for _ in range(COLUMNS):
        price = np.linalg.solve(basis.T, np.ones(n))
        worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(size.min()), capacity + 1):
            fits = size <= room
            gain = np.where(fits, worth[np.where(fits, room - size, 0)] + price, -1.0)
            best = int(gain.argmax())
            if gain[best] > worth[room - 1]:
                worth[room], last[room] = gain[best], best
            else:
                worth[room] = worth[room - 1]
        if worth[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                column[last[room]] += 1
                room -= size[last[room]]
        step = np.linalg.solve(basis, column)
        ratio = np.full(n, np.inf)
        np.divide(level, step, out=ratio, where=step > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        level = np.maximum(level - ratio[out] * step, 0)
        basis[:, out], level[out] = column, ratio[out]
    return [(basis[:, i].astype(int), int(level[i] + 1e-9)) for i in range(n) if level[i] >= 1]


def plan(counts: np.ndarray, capacity: int) -> tuple[list[Interval], int]:
    """Intervals for ``counts[length]`` pieces of each length, and the number of sequences."""
    lengths = [x for x in range(capacity, 0, -1) if counts[x]]
    start = dict(zip(lengths, np.cumsum([0, *(int(counts[x]) for x in lengths)]).tolist(), strict=False))
    edges, names = [start[x] for x in lengths], lengths
    length_at = lambda place: names[bisect.bisect_right(edges, place) - 1]
    found: list[Interval] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)
    used = 0
    if lengths and lengths[0] == capacity:
        found.append((0, int(counts[capacity]), 0))
        used = int(counts[capacity])
    first, large = used, sum(int(counts[x]) for x in lengths if x > capacity * LARGE)
    groups: list[list[int]] = []  # [size, first place, pieces]
    for i in range(GROUPS):
        a, b = first + (large - first) * i // GROUPS, first + (large - first) * (i + 1) // GROUPS
        if b > a:
            if groups and groups[-1][0] == length_at(a):
                groups[-1][2] += b - a
            else:
                groups.append([length_at(a), a, b - a])
    left: list[tuple[int, int]] = []  # (first place, pieces) of what no configuration takes
    if groups:
        places = [g[1] for g in groups]
        for config, times in configurations([g[0] for g in groups], [g[2] for g in groups], capacity):
            slots = []
            for g in np.nonzero(config)[0]:
                for _ in range(config[g]):
                    n = min(times, groups[g][1] + groups[g][2] - places[g])
                    if n > 0:
                        slots.append((places[g], n))
                        found.append((places[g], n, used))
                        places[g] += n
            cuts = {0, times} | {n for _, n in slots} | {e - p for p, n in slots for e in edges[bisect.bisect_right(edges, p) : bisect.bisect_left(edges, p + n)]}
            cuts = sorted(cuts)
            for a, b in zip(cuts, cuts[1:], strict=False):
                room = capacity - sum(length_at(p + a) for p, n in slots if a < n)
                rooms.setdefault(room, []).append((used + a, b - a))
            used += times
        left = [(p, g[1] + g[2] - p) for g, p in zip(groups, places, strict=True) if p < g[1] + g[2]]
    total = sum(int(counts[x]) for x in lengths)
    if total > large:
        left.append((large, total - large))
    open_rooms = sorted(r for r in rooms if r > 0)
    for p, n in left:
        while n:
            size = length_at(p)
            k = min(n, start[size] + int(counts[size]) - p)
            rest, at = k, p
            while rest:
                i = bisect.bisect_left(open_rooms, size)
                if i == len(open_rooms):
                    more = -(-rest // (capacity // size))
                    rooms[capacity] = [(used, more)]
                    open_rooms.append(capacity)
                    used += more
                    continue
                room = open_rooms[i]
                seq, many = rooms[room].pop()
                m = min(many, rest)
                found.append((at, m, seq))
                if many > m:
                    rooms[room].append((seq + m, many - m))
                if not rooms[room]:
                    del rooms[room], open_rooms[i]
                if room > size:
                    if room - size not in rooms:
                        rooms[room - size] = []
                        bisect.insort(open_rooms, room - size)
                    rooms[room - size].append((seq, m))
                at, rest = at + m, rest - m
            p, n = p + k, n - k
    return sorted(found), used


class Tokens:
    """Ids of texts by a vocabulary file of the library ``tokenizers``.

    Where the file describes plain byte-level BPE with merges in the order of their ids, ``tiktoken`` is set up from the file's own vocabulary and encodes texts in Latin-1,
    which takes a quarter of the time and gives the same ids (tests compare both on all such characters); other texts and other files are left to ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.fast = self._fast(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _fast(spec: dict):
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        special = {x["content"] for x in spec["added_tokens"]}
        vocabulary = {k: i for k, i in model["vocab"].items() if k not in special}
        merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        plain = model["type"] == "BPE" and split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"]
        if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or merged != sorted(merged) or -1 in merged:
            return None
        import tiktoken

        # Byte-level names: printable bytes stand for themselves, the others for the characters from 256 on, in order.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in set(own)]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}
        return tiktoken.Encoding("packing", pat_str=BYTE_LEVEL, mergeable_ranks={bytes(byte_of[c] for c in k): i for k, i in vocabulary.items()}, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.fast is not None:
            try:
                text.encode("latin-1")
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except UnicodeEncodeError:
                pass
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokens(path)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: (id, piece, start, length, ids_crc32, on request ids) with ``_task`` and ``_rank``, the rank among the task's pieces of that length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, ranks = _tokens(tokenizer_path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                rows = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = tokens.encode(text or "") + end
                    n = len(ids) // 4
                    starts = [0, *range(n % capacity or capacity, n, capacity)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        own = ids[4 * a : 4 * b]
                        rows.append((i, k, a, b - a, zlib.crc32(own), *((np.frombuffer(own, "<i4"),) if with_ids else ()), task, ranks[b - a]))
                        ranks[b - a] += 1
                took, *rest = zip(*rows, strict=True)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else []), pa.int32(), pa.int64()]
                columns = [part.column("id").take(pa.array(took)), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *names, "_task", "_rank"])

    names = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, {'ids array<int>, ' * with_ids}_task int, _rank long").withColumnRenamed("id", id_col)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, on request ``ids`` (array of int), then ``sequence_id`` and ``offset``.

    Texts are read whole; each document is its ids and ``end_id``. One longer than ``capacity`` is cut into pieces of that length, of which the first may be shorter;
    others stay whole. Pieces lie in their sequence without gaps from 0, longest first, then by id. A null text counts as empty and is ``end_id`` alone. Repeated rows
    are packed as often as they come; ties in length are told apart by place in the input; other columns are ignored; an empty table gives an empty result.
    """
    cut = materialise(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, with_ids), "op8-pieces")
    by_task = cut.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    before = by_task.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    intervals, _ = plan(counts, capacity)
    longer = counts.sum() - np.cumsum(counts)  # pieces that are longer than each length
    edges, first = (np.array([x[i] for x in intervals], dtype=np.int64) for i in (0, 2))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = longer[b.column("length").to_numpy()] + b.column("_before").to_numpy() + b.column("_rank").to_numpy()
            at = np.searchsorted(edges, place, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(first[at] + place - edges[at])], names=[*b.schema.names[:-2], "sequence_id"])

    rows = cut.join(before.select("length", "_task", "_before"), ["length", "_task"]).select(id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "_before", "_rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    placed = rows.mapInArrow(assign, f"{kinds}, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), id_col, "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
