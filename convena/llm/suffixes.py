"""Repeated substrings by two-stage suffix sorting.

A byte goes if it lies in a string of ``WINDOW`` bytes that starts anywhere else too. Candidates come first: the least hash of the ``GRAM``-byte
strings inside a window is its anchor, equal windows have equal anchors, so only windows whose anchor recurs in the corpus can recur. Successive windows
share an anchor; they make a context, the text that they cover. Equal contexts are counted once with their number (before the shuffle, as far as tasks can), so a
group of copies costs what one copy does.

Contexts with equal anchors meet in one task, and there a two-stage suffix sort decides: suffixes smaller than their successors are sorted directly, the rest
are induced by scanning the buckets of first bytes from the least up, and neighbours in the sorted order are compared. A window recurs if its context does, or if its common prefix with a
neighbour reaches ``WINDOW``. Where one anchor has more contexts than ``HOT``, they are dealt out by single windows instead, counted by a 128-bit fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, dealt_join, materialise, with_row_id

#: Bytes of a string that counts as repeated, and of the strings whose least hash is a window's anchor.
WINDOW, GRAM = 200, 32
#: Distinct contexts of one anchor from which they are dealt out by single windows.
HOT = 2000
#: Bytes that numpy hashes at a time; positions in them take PLACE_BITS bits below the hash.
CHUNK, PLACE_BITS = 1 << 18, 19
#: Bytes of contexts that are suffix-sorted at a time.
SORTED_BYTES = 1 << 20
WORD = 8


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each string of GRAM bytes, with its position in the low bits."""
    h, size, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        size *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(h), dtype=np.uint64)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive hashes; the leftmost of equal ones, as positions stand below."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :])


def contexts_of(rows: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, fingerprint of the context, row, first window, windows) arrays for all windows of the texts."""
    segments: list[tuple[int, int, bytes]] = []  # row, first byte in its text, bytes
    held = 0

    def run() -> tuple[np.ndarray, ...]:
        buffer = b"".join(x for _, _, x in segments)
        sizes = np.array([len(x) for _, _, x in segments])
        starts = np.cumsum(sizes) - sizes
        least = _least(_hashes(np.frombuffer(buffer, np.uint8)), WINDOW - GRAM + 1)
        of = np.repeat(np.arange(len(segments)), sizes - WINDOW + 1)
        counts = sizes - WINDOW + 1
        at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[of]
        value = least[at]
        first = np.nonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])]))[0]
        runs = np.diff(np.append(first, len(of)))
        begin = at[first]
        digest = xxhash.xxh3_64_intdigest
        prints = np.array([digest(buffer[a:b]) for a, b in zip(begin.tolist(), (begin + runs + (WINDOW - 1)).tolist(), strict=True)], dtype=np.uint64)
        own = of[first]
        place = begin - starts[own] + np.array([a for _, a, _ in segments])[own]
        return (value[first] >> np.uint64(PLACE_BITS)).astype(np.int64), prints.view(np.int64), np.array([r for r, _, _ in segments])[own], place, runs

    step = CHUNK - WINDOW
    for row, text in zip(rows, texts, strict=True):
        for a in range(0, max(len(text) - WINDOW + 1, 0), step):
            piece = text[a : a + step + WINDOW - 1]
            if held + len(piece) > CHUNK and segments:
                yield run()
                segments, held = [], 0
            segments.append((row, a, piece))
            held += len(piece)
    if segments:
        yield run()


def _anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            texts = part.column("_text").cast(pa.binary()).to_pylist()
            for found in contexts_of(part.column("_rid").to_pylist(), texts):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["_h", "_c", "_rid", "_pos", "_run"])


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The WORD bytes from each place as one number, in the order of the bytes."""
    return np.ndarray((len(text) - WORD + 1,), "<u8", text, strides=(1,))[at].byteswap()


def _sorted_directly(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in the order of their first WINDOW bytes; ties stay together."""
    if not len(at):
        return at
    key = _words(text, at)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    open_ = np.arange(len(at))
    for depth in range(WORD, WINDOW, WORD):
        own = group[open_]
        alone = np.concatenate([[True], own[1:] != own[:-1]]) & np.concatenate([own[1:] != own[:-1], [True]])
        open_ = open_[~alone]
        if not len(open_):
            break
        own, key = group[open_], _words(text, at[open_] + depth)
        order = np.lexsort((key, own))
        at[open_] = at[open_][order]
        own, key = own[order], key[order]
        new = np.concatenate([[False], (own[1:] == own[:-1]) & (key[1:] != key[:-1])])
        # A group that splits keeps its number in front; the parts behind take fractions of it, as numbers of all places would have to move otherwise.
        group[open_] = own
        split = np.zeros(len(at), dtype=np.int64)
        split[open_] = new
        group = group + np.cumsum(split)
    return at


def suffix_order(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places marked in ``wanted`` in the order of their suffixes' first WINDOW bytes. ``text`` ends each context with a 0 that occurs nowhere else and is padded behind."""
    n = len(wanted)
    step = text[: n - 1].astype(np.int16) - text[1:n]
    # A place has the type of the next place whose byte differs from its successor's.
    differs = np.append(np.nonzero(step)[0], n - 1)
    small = np.repeat(np.append(step, -1)[differs] < 0, np.diff(np.append(-1, differs)))  # smaller than its successor
    small |= text[:n] == 0
    seed = np.nonzero(small)[0]
    # An induced suffix needs those behind it up to the next seed.
    last = np.nonzero(wanted & ~small)[0]
    need = wanted.copy()
    if len(last):
        stop = seed[np.searchsorted(seed, last)]
        change = np.zeros(n + 1, dtype=np.int32)
        np.add.at(change, last, 1)
        np.add.at(change, stop + 1, -1)
        need |= np.cumsum(change[:n]) > 0
    direct = _sorted_directly(text, np.nonzero(small & need)[0])
    first = text[direct]
    edges = np.searchsorted(first, np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced = need & ~small

    def induce(batch: np.ndarray) -> None:
        """What stands before each place goes to the end of its own bucket, if it is to be induced."""
        before = batch - 1
        before = before[before >= 0]
        before = before[induced[before]]
        if len(before):
            bytes_ = text[before]
            order = np.argsort(bytes_, kind="stable")
            before, bytes_ = before[order], bytes_[order]
            cuts = np.nonzero(np.concatenate([[True], bytes_[1:] != bytes_[:-1]]))[0]
            for part, byte in zip(np.split(before, cuts[1:]), bytes_[cuts].tolist(), strict=True):
                buckets[byte].append(part)

    out: list[np.ndarray] = []
    for byte in range(256):
        # Larger than their successors come first in a bucket; it grows while it is scanned where the byte repeats.
        while buckets[byte]:
            batch = np.concatenate(buckets[byte])
            buckets[byte] = []
            induce(batch)
            out.append(batch)
        batch = direct[edges[byte] : edges[byte + 1]]
        induce(batch)
        out.append(batch)
    order = np.concatenate(out)
    return order[wanted[order]]


def repeated_windows(contexts: list[bytes], runs: list[int], many: list[bool]) -> list[np.ndarray]:
    """For each context, which of its windows recur: ``many`` says that the context itself does."""
    sizes = np.array([len(x) + 1 for x in contexts])
    text = np.frombuffer(b"\0".join(contexts) + bytes(1 + WINDOW + WORD), np.uint8).copy()
    n = int(sizes.sum())
    ends = np.cumsum(sizes) - 1
    # UTF-8 has no byte over 0xF4, so bytes can move up by one and leave 0 to the ends.
    text[:n] += 1
    text[ends] = 0
    starts = ends + 1 - sizes
    count = np.array(runs)
    places = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    wanted = np.zeros(n, dtype=bool)
    wanted[places] = True
    order = suffix_order(text, wanted)
    a, b, pair = order[:-1], order[1:], np.arange(len(order) - 1)
    for depth in range(0, WINDOW, WORD):  # common prefixes of neighbours, as far as they last
        equal = _words(text, a + depth) == _words(text, b + depth)
        a, b, pair = a[equal], b[equal], pair[equal]
        if not len(pair):
            break
    hit = np.zeros(n, dtype=bool)
    hit[order[pair]] = hit[order[pair + 1]] = True
    hit[places] |= np.repeat(np.array(many), count)
    return [hit[x : x + k] for x, k in zip(starts.tolist(), runs, strict=True)]


FLAGGED = "_h long, _c long, _run int, _mask binary"


def _sort_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; as many whole anchors as fit are suffix-sorted together."""
    held: list[tuple[int, int, int, bool, bytes]] = []
    size = 0

    def run() -> pa.RecordBatch:
        marks = repeated_windows([x[4] for x in held], [x[2] for x in held], [x[3] for x in held])
        got = [(h, c, r, np.packbits(m).tobytes()) for (h, c, r, _, _), m in zip(held, marks, strict=True) if m.any()]
        columns = list(zip(*got, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["_h", "_c", "_run", "_mask"])

    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in ("_h", "_c", "_run", "_many", "_text")), strict=True):
            if size >= SORTED_BYTES and row[0] != held[-1][0]:
                yield run()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield run()


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each context that a row's document stands for."""
    names = ["_h", "_c", "_run", "_many", "_hot", "_text"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part, rows = batch.slice(start, 200), []
            for text, wanted in zip(part.column("_text").cast(pa.binary()).to_pylist(), part.column("_cuts").to_pylist(), strict=True):
                rows += [(w["_h"], w["_c"], w["_run"], w["_many"], w["_hot"], text[w["_pos"] : w["_pos"] + w["_run"] + WINDOW - 1]) for w in wanted]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows of contexts: their fingerprints."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            rows = []
            for h, c, run, many, text in zip(*(batch.slice(start, 500).column(x).to_pylist() for x in ("_h", "_c", "_run", "_many", "_text")), strict=True):
                rows += [(h, c, run, i, 1 + many, xxhash.xxh3_128_digest(text[i : i + WINDOW])) for i in range(run)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)), kinds, strict=True)], names=["_h", "_c", "_run", "_i", "_n", "_w"])


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of contexts all of whose windows recur."""
    for b in batches:
        masks = [np.packbits(np.ones(run, dtype=bool)).tobytes() for run in b.column("_run").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(masks, pa.binary())], names=["_h", "_c", "_run", "_mask"])


def _masks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks = []
        for run, hits in zip(batch.column("_run").to_pylist(), batch.column("_hits").to_pylist(), strict=True):
            mask = np.zeros(run, dtype=bool)
            mask[hits] = True
            masks.append(np.packbits(mask).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("_h", "_c", "_run")), pa.array(masks, pa.binary())], names=["_h", "_c", "_run", "_mask"])


def _flagged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchors that recur with their places, contexts with a recurring window and which those are)."""
    found = rows.mapInArrow(_anchors, "_h long, _c long, _rid long, _pos long, _run int")
    recurring = materialise(found.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h"), "op5-anchors")
    places = materialise(found.join(bounded(recurring), "_h", "left_semi"), "op5-places")
    distinct = places.groupBy("_h", "_c", "_run").agg(F.count("*").alias("_n"), F.min(F.struct("_rid", "_pos")).alias("_at"))
    distinct = materialise(distinct.select("_h", "_c", "_run", (F.col("_n") > 1).alias("_many"), "_at._rid", "_at._pos"), "op5-distinct")
    crowds = materialise(distinct.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1"), "op5-crowds")
    # A context alone at its anchor recurs as a whole, or its anchor would not.
    sorted_ = distinct.join(crowds.withColumn("_hot", F.col("_n") > HOT).drop("_n"), "_h", "left")
    alone = sorted_.filter("_hot is null").select("_h", "_c", "_run").mapInArrow(_whole, FLAGGED)
    wanted = sorted_.filter("_hot is not null").groupBy("_rid").agg(F.collect_list(F.struct("_h", "_c", "_run", "_many", "_hot", "_pos")).alias("_cuts"))
    wanted = materialise(wanted, "op5-wanted")
    cut = rows.join(bounded(wanted.select("_rid")), "_rid", "left_semi").join(wanted, "_rid").select("_text", "_cuts")
    cut = cut.mapInArrow(_cut, "_h long, _c long, _run int, _many boolean, _hot boolean, _text binary")
    hot = crowds.filter(F.col("_n") > HOT)
    has_hot = not hot.isEmpty()
    cut = materialise(cut, "op5-contexts") if has_hot else cut
    flagged = cut.filter("not _hot").repartition("_h").sortWithinPartitions("_h").mapInArrow(_sort_batches, FLAGGED)
    if has_hot:
        single = cut.filter("_hot").mapInArrow(_windows, "_h long, _c long, _run int, _i int, _n int, _w binary")
        again = single.groupBy("_h", "_w").agg(F.sum("_n").alias("_n")).filter("_n > 1").select("_h", "_w")
        hits = single.join(again, ["_h", "_w"]).groupBy("_h", "_c", "_run").agg(F.collect_list("_i").alias("_hits"))
        flagged = flagged.unionByName(hits.mapInArrow(_masks, FLAGGED))
    return places, materialise(flagged.unionByName(alone), "op5-flagged")


def _starts(marks: pa.ListArray, firsts: np.ndarray) -> np.ndarray:
    """Where the recurring windows of some texts start, if the texts start at ``firsts``."""
    flat = marks.flatten()
    pos, mask = flat.field("_pos").to_numpy(), flat.field("_mask")
    sizes = pa.compute.binary_length(mask).to_numpy().astype(np.int64) * 8  # bits behind a mask's windows are 0
    owner = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
    bits = np.nonzero(np.unpackbits(np.frombuffer(b"".join(mask.to_pylist()), np.uint8)))[0]
    of = np.searchsorted(np.cumsum(sizes), bits, side="right")
    return firsts[owner[of]] + pos[of] + bits - (np.cumsum(sizes) - sizes)[of]


def _remove(batches: Iterable[pa.RecordBatch], characters: bool) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            texts = part.column("_text").cast(pa.binary()).to_pylist()
            sizes = np.array([len(t) + 1 for t in texts])
            firsts = np.cumsum(sizes) - sizes
            data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
            at = _starts(pa.concat_arrays([part.column("_marks")]), firsts)
            change = np.bincount(at, minlength=len(data)) - np.bincount(at + WINDOW, minlength=len(data))[: len(data)]
            gone = np.cumsum(change) > 0
            if characters:  # a character goes if all its bytes do
                lead = np.nonzero((data & 0xC0) != 0x80)[0]
                gone = np.repeat(np.minimum.reduceat(gone, lead), np.diff(np.append(lead, len(data))))
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
            begin, end = np.nonzero(edge > 0)[0], np.nonzero(edge < 0)[0]
            of = np.searchsorted(firsts, begin, side="right") - 1
            offsets = np.searchsorted(of, np.arange(len(texts) + 1))
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - firsts[of]), pa.array(end - firsts[of])], names=["start", "end"]))
            for i in np.unique(of).tolist():
                own = slice(firsts[i], firsts[i] + sizes[i] - 1)
                texts[i] = data[own][~gone[own]].tobytes()
            yield pa.RecordBatch.from_arrays([part.column("_own"), pa.array(texts, pa.binary()), spans.cast(kind)], names=["_own", "kept", "spans"])


def remove_repeats(docs: DataFrame, text_col: str = "text", characters: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``spans`` (removed bytes, as start and end of maximal runs) and ``kept`` (the other bytes, binary); earlier columns of these names, in any case, give way.

    Every byte goes that lies in a string of WINDOW bytes which also starts at another place of the corpus, in the same text or another, whether the occurrences overlap or not; all occurrences
    go. Strings are judged on the input and never cross texts. With ``characters`` a character goes only if all its bytes do, so ``kept`` stays UTF-8. A null text counts as empty; texts under
    WINDOW bytes lose nothing; repeated rows are copies like others; an empty table gives an empty result. ``docs`` is written once if it doesn't come straight from files.
    """
    new = {"n_bytes", "spans", "kept"}
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    numbered = with_row_id(docs.select(F.struct(*own).alias("_own"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")), "_rid")
    places, flagged = _flagged(numbered.select("_rid", "_text"))
    marks = dealt_join(places, flagged, ["_h", "_c", "_run"], "_rid").groupBy("_rid").agg(F.collect_list(F.struct("_pos", "_mask")).alias("_marks"))
    marks = materialise(marks, "op5-marks")
    touched = bounded(marks.select("_rid"))
    kind, none = numbered.schema["_own"].dataType.simpleString(), F.array().cast("array<struct<start:long,end:long>>")
    out = numbered.join(touched, "_rid", "left_semi").join(marks, "_rid").select("_own", "_text", "_marks")
    out = out.mapInArrow(lambda batches: _remove(batches, characters), f"_own {kind}, kept binary, spans array<struct<start:long,end:long>>")
    out = out.unionByName(numbered.join(touched, "_rid", "left_anti").select("_own", F.col("_text").cast("binary").alias("kept"), none.alias("spans")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("_own.*", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), "spans", "kept")
