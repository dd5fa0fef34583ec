"""Jaccard join of word n-gram sets in a metric space, exact.

Jaccard distance is a metric. With threshold t, linked sets lie within e = 1 - t, and their sizes within a factor t: seen from the pivot that holds every shingle, documents lie in rings
of sizes, and one near a ring's lower edge is replicated to the ring below. Pivots drawn from documents can't part a corpus (nearly all texts are at distance 1 from any of them, so triangle
windows would replicate all to all; see the README), hence the first regions are those of projected pivots: the universe of shingles falls into more classes than linked sets of a
ring can differ in shingles, so linked sets agree entirely in a class. Each distinct projection is a pivot, its Voronoi region holds the sets at distance 0 from it there, and linked
sets share regions: so many that a set with fewer recurring regions drops out. Regions that share sets form a cluster.

Clusters join exactly, recursively. A cluster too large for one task is parted: each set goes to the Voronoi region of its nearest pivot document and, if it lies within 2e of the boundary, to those
beyond, and so on while that makes regions smaller; what doesn't get smaller is joined block by block. In a task, each pivot in turn takes the sets within e of it that no pivot before has taken;
by the triangle inequality what they link to lies within 2e of it, and of those only within a window of e round their own distance, by each of the pivots that a large region gets besides. Pairs
whose distances to a pivot sum up to e at most are linked without a look at their shingles; all others in the window are compared. Which sets lie within 2e of a pivot is looked up by its rarest shingles, one of which they must share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, components, materialise, stored, with_row_id, wrapped

#: Ratio of the sizes at a ring's edges.
RING = Fraction(3, 2)
#: A ring has more classes than linked sets can differ in: by a quarter of that number, three at least. So linked sets share many regions, and a set that shares few has no link.
SPARE, SPARE_SHARE = 3, 4
#: Shingles that the sets of a region joined in one task may have together; beyond that it is parted.
REGION_SHINGLES = 1 << 20
#: Pivot documents of a parted region, and how often at most regions are parted again.
PIVOTS, LEVELS = 8, 8
#: Sets that a pivot may have taken before its region gets more pivots, and how many more.
FEW, MORE_PIVOTS = 32, 3
#: Recurring regions that may be sent to every task.
BROADCAST_REGIONS = 1 << 21
#: Where more recur, a Bloom filter of them is sent instead: bits for each region, most bits of it (as a power of 2), bits that a region sets, and parts (as a power of 2) that it is made in.
FILTER_EACH, FILTER_MOST, FILTER_HASHES, FILTER_PARTS = 12, 29, 3, 6
CHUNK = 1 << 19
#: A-Z in lower case; white space is 0x20 and 0x09 to 0x0D.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


class Threshold(NamedTuple):
    """Sets link if ``whole`` * intersection >= ``part`` * union."""

    part: int
    whole: int

    def common(self, total: int) -> int:
        """Least intersection of linked sets whose sizes sum to ``total``."""
        return -(-self.part * total // (self.part + self.whole))

    def differing(self, top: int) -> int:
        """Most shingles that one of two linked sets has and the other has not, if the smaller has up to ``top``."""
        total = top + top * self.whole // self.part
        return max(s - 2 * self.common(s) for s in range(max(total - 40, 0), total + 1))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


UP, DOWN = _powers(FACTOR, CHUNK + 2), _powers(INVERSE, CHUNK + 2)


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word, in order."""
    found: list[np.ndarray] = []
    space = SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.nonzero(edge < 0)[0], np.nonzero(edge > 0)[0]
    first = 0
    while first < len(starts):  # as many whole words at a time as CHUNK bytes hold
        base = starts[first]
        last = max(int(np.searchsorted(ends, base + CHUNK, side="right")), first + 1)
        if ends[first] - base > CHUNK:
            found.append(np.array([xxhash.xxh3_64_intdigest(data[base : ends[first]].tobytes())], dtype=np.uint64))
        else:
            piece = data[base : ends[last - 1]]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * UP[: len(piece)], dtype=np.uint64)])
            a, b = starts[first:last] - base, ends[first:last] - base
            found.append(_mixed((total[b] - total[a]) * DOWN[a] + (b - a).astype(np.uint64)))
        first = last
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The set of each text, as sorted 64-bit hashes; a text of fewer words has its whole sequence as one shingle, one without words none."""
    out, begin = [], 0
    while begin < len(texts):
        # Texts are hashed together, each ended by a byte that is white space.
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= CHUNK):
            size += len(texts[end]) + 1
            end += 1
        data = LOWER[np.frombuffer(b"\n".join(texts[begin:end]), np.uint8)] if size > 1 or texts[begin] else np.zeros(0, np.uint8)
        hashes = _word_hashes(data)
        space = SPACE[data]
        heads = ~space & np.concatenate([[True], space[:-1]]) if len(data) else np.zeros(0, bool)
        before = np.concatenate([[0], np.cumsum(heads)])
        stops = np.cumsum([len(t) + 1 for t in texts[begin:end]]) - 1
        cuts = before[np.minimum(stops, len(data))].tolist()
        rolled = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
        for k in range(words):
            rolled = rolled * np.uint64(FACTOR) + hashes[k : k + len(rolled)]
        rolled = _mixed(rolled)
        first = 0
        for last in cuts:
            n = last - first
            if n >= words:
                out.append(np.unique(rolled[first : last - words + 1]))
            elif n:
                own = np.uint64(n)
                for h in hashes[first:last].tolist():
                    own = np.uint64((int(own) * FACTOR + h) & 0xFFFFFFFFFFFFFFFF)
                out.append(_mixed(np.array([own], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            first = last
        begin = end
    return out


def _rings(threshold: Threshold, largest: int = 1 << 40) -> list[tuple[int, int, int]]:
    """(least size above the ring, shingles that linked sets can differ in, classes) of each ring from the smallest sizes up."""
    rings, low = [], 1
    while low < largest:
        high = max(low + 1, -(-low * RING.numerator // RING.denominator))
        most = threshold.differing(high - 1)
        rings.append((high, most, most + max(SPARE, most // SPARE_SHARE)))
        low = high
    return rings


def regions(own: np.ndarray, threshold: Threshold, rings: list[tuple[int, int, int]]) -> list[tuple[int, int, np.ndarray]]:
    """(ring, least number of regions shared with a linked set, names of regions) of a set, for each ring that it belongs to.

    Sets that link agree in all classes but those that hold a differing shingle; classes that are empty in both name no region. A set with so many empty classes that no region would be left has one more, which all of its kind share.
    """
    n = len(own)
    least = -(-threshold.part * n // threshold.whole)  # size of the smallest set that it can link to
    found = []
    for i, (above, most, classes) in enumerate(rings):
        if above <= least:
            continue
        if most:  # else linked sets of the ring are equal
            of = ((own >> np.uint64(32)) * np.uint64(classes) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            of = of[order]
            cuts = np.nonzero(np.concatenate([[True], of[1:] != of[:-1]]))[0]
            sums = np.add.reduceat(_mixed(own + np.uint64(FACTOR))[order], cuts)
            names = _mixed(sums + _mixed((of[cuts] + (i << 40)).astype(np.uint64)))
            need = len(cuts) - most
            if need <= 0:
                names = np.append(names, _mixed(np.array([i + (1 << 62)], np.uint64)))
            found.append((i, max(need, 1), names))
        if above > n:
            break
    return found


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    for start in range(0, batch.num_rows, 500):
        part = batch.slice(start, 500)
        yield from enumerate(shingles(part.column("_text").cast(pa.binary()).to_pylist(), words), start)


def _fingerprint(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _short(print_: bytes) -> int:
    return int.from_bytes(print_[:8], "little", signed=True)


def _describe(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(len(s), _fingerprint(s)) for _, s in _sets(b, words)]
            columns = [pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary()), pa.array([_short(x) for _, x in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("_rid"), b.column("_id"), *columns], names=["_rid", "_id", "_n", "_set", "_short"])

    return run


def _places(names: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of a filter of 2**``bits`` that each region sets. Names are hashes: the first bits say the part, which all of a region's bits lie in."""
    h = names.view(np.uint64)
    part = (h >> np.uint64(64 - FILTER_PARTS)) << np.uint64(bits - FILTER_PARTS)
    for _ in range(FILTER_HASHES):
        h = _mixed(h + np.uint64(FACTOR))
        yield (part | h >> np.uint64(64 - bits + FILTER_PARTS)).astype(np.int64)


def region_filter(recurring: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the regions in ``recurring`` (materialised, ``count`` rows), as packed bits: 64 MB at most, made part by part in the tasks."""
    bits = min(max((FILTER_EACH * count - 1).bit_length(), FILTER_PARTS + 3), FILTER_MOST)
    size = 1 << bits - FILTER_PARTS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            names = b.column("_key").to_numpy()
            for places in _places(names, bits):
                for part in np.unique(places // size).tolist():
                    made.setdefault(part, np.zeros(size, bool))[places[places // size == part] % size] = True
        for part, own in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    found = np.zeros((1 << FILTER_PARTS, size // 8), np.uint8)
    for r in recurring.repartition(F.shiftrightunsigned("_key", 64 - FILTER_PARTS)).mapInArrow(run, "part long, bits binary").toLocalIterator():
        found[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
    return found.ravel()


def _keys(words: int, threshold: Threshold, named: bool, likely: np.ndarray | None = None):
    """Names of all regions of all sets, or of those in the filter ``likely``; if ``named``, with the ring, the least number of shared regions and the first half of the set's fingerprint."""
    rings = _rings(threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([x for *_, x in held]).view(np.int64))]
            if named:
                counts = [len(x) for *_, x in held]
                columns += [pa.array(np.repeat(np.array([h[k] for h in held], dtype=np.int64), counts)) for k in range(3)]
            found = pa.RecordBatch.from_arrays(columns, names=["_key", "_short", "_ring", "_need"][: len(columns)])
            if likely is not None:
                names = found.column("_key").to_numpy()
                found = found.filter(pa.array(np.logical_and.reduce([likely[x >> 3] >> (x & 7).astype(np.uint8) & 1 for x in _places(names, len(likely).bit_length() + 2)])))
            return found

        held, size = [], 0
        for b in batches:
            for _, own in _sets(b, words):
                if len(own):
                    short = _short(_fingerprint(own)) if named else 0
                    for ring, need, names in regions(own, threshold, rings):
                        held.append((short, ring, need, names))
                        size += len(names)
                    if size > 1 << 18:
                        yield rows()
                        held, size = [], 0
        if held:
            yield rows()

    return run


def _member_sets(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [s.tobytes() for _, s in _sets(b, words)]
            for start in range(0, len(got), 200):
                part = b.slice(start, 200)
                yield pa.RecordBatch.from_arrays([part.column("_region"), part.column("_set"), part.column("_weight"), pa.array(got[start : start + 200], pa.binary())], names=["_region", "_set", "_weight", "_own"])

    return run


def _shared(one: np.ndarray, flat: np.ndarray, starts: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Shingles that ``one`` has in common with each of the sets laid end to end in ``flat``; every set has some."""
    flags[one] = 1
    found = np.add.reduceat(flags[flat], starts, dtype=np.int64)
    flags[one] = 0
    return found


class Region:
    """Sets in the order of their distances to a pivot, laid end to end."""

    def __init__(self, members: np.ndarray, far: np.ndarray, places: np.ndarray, cuts: np.ndarray, sizes: np.ndarray, flags: np.ndarray):
        order = np.argsort(far, kind="stable")
        self.members, self.far, self.flags = members[order], far[order], flags
        self.sizes = sizes[self.members]
        self.cuts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([places[cuts[y] : cuts[y] + sizes[y]] for y in self.members.tolist()])
        self.pivots = self.far[None]

    def own(self, i: int) -> np.ndarray:
        return self.flat[self.cuts[i] : self.cuts[i] + self.sizes[i]]

    def common(self, i: int, some: np.ndarray) -> np.ndarray:
        """Shingles that member ``i`` has in common with some others, given in order."""
        first, last = int(some[0]), int(some[-1])
        if 2 * len(some) > last - first:  # most of a stretch: it lies together already
            flat = self.flat[self.cuts[first] : self.cuts[last] + self.sizes[last]]
            return _shared(self.own(i), flat, self.cuts[first : last + 1] - self.cuts[first], self.flags)[some - first]
        return _shared(self.own(i), np.concatenate([self.own(y) for y in some.tolist()]), np.cumsum(self.sizes[some]) - self.sizes[some], self.flags)

    def add_pivots(self, n: int) -> None:
        """Distances to ``n`` more pivots, each the member farthest from those before."""
        everyone = np.arange(len(self.members))
        for _ in range(n):
            i = int(self.pivots.min(axis=0).argmax())
            both = self.common(i, everyone)
            self.pivots = np.concatenate([self.pivots, (1 - both / (self.sizes + self.sizes[i] - both))[None]])


def join_region(prints: list[bytes], weights: list[int], sets: list[np.ndarray], home: list[bool], threshold: Threshold, side: list[int] | None = None) -> list[tuple[bytes, bytes, int]]:
    """(set, least set that it is linked to within the region, documents that it links to) for each set with a link. A pair counts where its lesser set is at home, and in a region of two blocks (sides 1 and 2) if it has one of each."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, places = np.unique(np.concatenate(sets), return_inverse=True)
    flags = np.zeros(int(places.max()) + 1, np.uint8)
    cuts = np.cumsum(sizes) - sizes
    rows = np.repeat(np.arange(n), sizes)
    by_place = np.argsort(places, kind="stable")
    rarity = np.bincount(places)
    posted, posts = rows[by_place], np.concatenate([[0], np.cumsum(rarity)])
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=prints.__getitem__)] = np.arange(n)
    weight, at_home, sides = np.array(weights, np.int64), np.array(home, bool), np.array(side if side else [0] * n)
    root, links = np.arange(n), np.zeros(n, np.int64)
    # Distances are compared with some slack: exclusion errs on the side of more, inclusion on the side of fewer.
    part, whole, reach, slack = threshold.part, threshold.whole, 1 - threshold.part / threshold.whole, 1e-9

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def link(x: int, linked: np.ndarray) -> None:
        counts = np.where(rank[linked] < rank[x], at_home[linked], at_home[x]) & ((sides[x] == 0) | (sides[linked] != sides[x]))
        linked = linked[counts]
        links[x] += weight[linked].sum()
        links[linked] += weight[x]
        for i in np.unique(root[linked]).tolist():
            a, b = find(i), find(x)
            root[max(a, b)] = min(a, b)
        root[linked] = find(x)

    taken = np.zeros(n, bool)
    for pivot in np.argsort(-sizes, kind="stable").tolist():
        if taken[pivot]:
            continue
        # Sets within 2e of the pivot share this many of its shingles at least, so one of its rarest.
        least = max(-(-(2 * part - whole) * int(sizes[pivot]) // whole), 1)
        own = places[cuts[pivot] : cuts[pivot] + sizes[pivot]]
        if 2 * part > whole:
            rare = own[np.argsort(rarity[own], kind="stable")[: sizes[pivot] - least + 1]]
            met = np.unique(np.concatenate([posted[posts[p] : posts[p + 1]] for p in rare.tolist()]))
        else:  # 2e is the greatest distance there is
            met = np.arange(n)
        met = met[~taken[met] & (sizes[met] >= least)]
        taken[pivot] = True
        if len(met) == 1:
            continue
        both = _shared(own, np.concatenate([places[cuts[y] : cuts[y] + sizes[y]] for y in met.tolist()]), np.cumsum(sizes[met]) - sizes[met], flags)
        far = 1 - both / (sizes[met] + sizes[pivot] - both)
        near = far <= 2 * reach + slack
        if near.sum() == 1:
            continue
        region = Region(met[near], far[near], places, cuts, sizes, flags)
        core = int(np.searchsorted(region.far, reach + slack, side="right"))
        taken[region.members[:core]] = True
        if core > FEW:
            region.add_pivots(MORE_PIVOTS)
        for i in range(core):
            last = int(np.searchsorted(region.far, region.far[i] + reach + slack, side="right"))
            window = np.arange(i + 1, last)
            apart = region.pivots[:, i + 1 : last]
            window = window[(np.abs(apart - region.pivots[:, i : i + 1]) <= reach + slack).all(axis=0) & (whole * region.sizes[i + 1 : last] >= part * region.sizes[i]) & (whole * region.sizes[i] >= part * region.sizes[i + 1 : last])]
            if not len(window):
                continue
            sure = (region.pivots[:, window] + region.pivots[:, i : i + 1]).min(axis=0) <= reach - slack
            open_ = window[~sure]
            if len(open_):
                both = region.common(i, open_)
                open_ = open_[whole * both >= part * (region.sizes[i] + region.sizes[open_] - both)]
            link(int(region.members[i]), region.members[np.concatenate([window[sure], open_])])
    least_of: dict[int, bytes] = {}
    for i in np.nonzero(links)[0].tolist():
        r = find(i)
        least_of[r] = min(least_of.get(r, prints[i]), prints[i])
    return [(prints[i], least_of[find(i)], int(links[i])) for i in np.nonzero(links)[0].tolist()]


def _joiner(threshold: Threshold):
    """Rows come sorted by region."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            got = join_region([x[0] for x in held], [x[1] for x in held], [np.frombuffer(x[2], np.uint64) for x in held], [x[3] for x in held], threshold, [x[4] for x in held]) if len(held) > 1 else []
            columns = list(zip(*got, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["_set", "_least", "_links"])

        for b in batches:
            for region, *rest in zip(*(b.column(c).to_pylist() for c in ("_region", "_set", "_weight", "_own", "_home", "_side")), strict=True):
                if region != now:
                    if held:
                        yield done()
                    now, held = region, []
                held.append(rest)
        if held:
            yield done()

    return run


def _assigner(threshold: Threshold):
    """Voronoi regions of pivot documents, with the sets that lie within 2e of a boundary on either side."""
    reach = 2 * (1 - threshold.part / threshold.whole) + 1e-9

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for region, set_, weight, own, home, pivots in zip(*(b.column(c).to_pylist() for c in ("_region", "_set", "_weight", "_own", "_home", "_pivots")), strict=True):
                mine = np.frombuffer(own, np.uint64)
                far = []
                for p in pivots:
                    other = np.frombuffer(p["_own"], np.uint64)
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    far.append(1 - both / (len(mine) + len(other) - both))
                near = min(range(len(far)), key=lambda i: (far[i], pivots[i]["_set"]))
                rows += [(xxhash.xxh3_64_intdigest(f"{region} {i}") - (1 << 63), set_, weight, own, home and i == near, region) for i in range(len(far)) if far[i] <= far[near] + reach]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["_region", "_set", "_weight", "_own", "_home", "_parent"])

    return run


MEMBER = "_region long, _set binary, _weight long, _own binary, _home boolean"


def _large(members: DataFrame) -> DataFrame:
    sizes = members.groupBy("_region").agg(F.sum(F.octet_length("_own") / 8).alias("_total"))
    return materialise(sizes.filter(F.col("_total") > REGION_SHINGLES).select("_region", F.ceil(F.col("_total") / REGION_SHINGLES).alias("_blocks")), "op7-large")


def _parted(big: DataFrame, threshold: Threshold) -> tuple[DataFrame, DataFrame]:
    """(sets of the regions that parting made smaller, by their new regions; names of those regions as they were). Parting counts if it replicates less than twofold and leaves no part with more than nine tenths; else it would cost more than it saves."""
    first = Window.partitionBy("_region").orderBy(F.xxhash64("_set"))
    chosen = big.select("_region", "_set").withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= PIVOTS).select("_region", "_set")
    pivots = materialise(big.join(chosen, ["_region", "_set"]).groupBy("_region").agg(F.collect_list(F.struct("_set", "_own")).alias("_pivots")), "op7-pivots")
    parted = materialise(big.join(pivots, "_region").mapInArrow(_assigner(threshold), MEMBER + ", _parent long"), "op7-parted")
    copies = parted.groupBy(F.col("_parent").alias("_region"), F.col("_region").alias("_part")).agg(F.count("*").alias("_n"), F.sum(F.octet_length("_own")).alias("_total"))
    copies = copies.groupBy("_region").agg(F.sum("_n").alias("_n"), F.max("_total").alias("_most"))
    whole = big.groupBy("_region").agg(F.count("*").alias("_m"), F.sum(F.octet_length("_own")).alias("_all"))
    good = materialise(copies.join(whole, "_region").filter((F.col("_n") <= 2 * F.col("_m")) & (F.col("_most") <= 0.9 * F.col("_all"))).select("_region"), "op7-good")
    return parted.join(good.withColumnRenamed("_region", "_parent"), "_parent", "left_semi").select("_region", "_set", "_weight", "_own", "_home"), good


def _blocked(rest: DataFrame) -> DataFrame:
    """Regions block by block: the task of the blocks (i, j) holds both, and a pair of one block counts in (i, i) only."""
    rest = rest.withColumn("_b", F.pmod(F.xxhash64("_set"), F.col("_blocks")))
    dealt = rest.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    low, high = F.least("_b", "_o"), F.greatest("_b", "_o")
    return dealt.select(F.xxhash64("_region", low, high).alias("_region"), "_set", "_weight", "_own", "_home", F.when(F.col("_b") == F.col("_o"), F.lit(0)).when(F.col("_b") < F.col("_o"), F.lit(1)).otherwise(F.lit(2)).alias("_side"))


def _links(members: DataFrame, threshold: Threshold) -> DataFrame:
    """(_set, _least, _links) of all regions; those with too many shingles are parted first, again and again while that helps."""
    now, parts = members, []
    for _ in range(LEVELS):
        large = _large(now)
        if large.isEmpty():
            break
        parts.append(now.join(bounded(large.select("_region")), "_region", "left_anti"))
        big = now.join(bounded(large), "_region")
        now, good = _parted(big.drop("_blocks"), threshold)
        parts.append(_blocked(big.join(good, "_region", "left_anti")))
    else:
        large = _large(now)
        parts.append(_blocked(now.join(bounded(large), "_region")))
        now = now.join(bounded(large.select("_region")), "_region", "left_anti")
    rows = now
    for part in parts:
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows = rows if "_side" in rows.columns else rows.withColumn("_side", F.lit(0))
    rows = rows.withColumn("_side", F.coalesce("_side", F.lit(0)))
    return rows.repartition("_region").sortWithinPartitions("_region").mapInArrow(_joiner(threshold), "_set binary, _least binary, _links long")


def near_groups(docs: DataFrame, words: int, threshold: Threshold, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id``, ``n_links``, the row's place ``_rid`` and ``_group``, the least set of its component, which tells components apart whatever their ids are (null without a set).

    Words are runs of bytes other than white space (0x20, 0x09-0x0D), A-Z lower-cased; a document's set holds its distinct shingles of ``words`` words, or, if it has fewer, its whole sequence as one. Documents link
    if their sets do by ``threshold``; a null text, an empty one and one of white space have an empty set and link with nothing. ``component_id`` is the least id reachable by links, itself included;
    nulls are passed over, so it is null only if all ids reached are. ``n_links`` counts the rows linked directly, equal ones included. Shingles and sets are told apart by hashes of 64 and 128 bits. Repeated rows are copies;
    other columns are ignored; an empty table gives an empty result. ``docs`` is written once if it doesn't come straight from files.
    """
    rows = with_row_id(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_rid")
    kind = rows.schema["_id"].dataType.simpleString()
    described = materialise(rows.mapInArrow(_describe(words), f"_rid long, _id {kind}, _n long, _set binary, _short long"), "op7-sets")
    sets = described.filter("_n > 0").groupBy("_set", "_short").agg(F.min("_rid").alias("_rid"), F.count("*").alias("_weight"), F.min("_id").alias("_least_id"))
    sets = materialise(sets, "op7-distinct")
    copies = materialise(described.filter("_n > 0").join(sets.select("_rid"), "_rid", "left_anti").select("_rid"), "op7-copies")
    single = rows.join(bounded(copies), "_rid", "left_anti").select("_text")
    recurring = single.mapInArrow(_keys(words, threshold, False), "_key long").groupBy("_key").agg(F.count("*").alias("_c")).filter("_c > 1").select("_key")
    recurring = materialise(recurring, "op7-regions")
    # Regions of one set only are most of all. Where those that recur are too many to be sent to all tasks, a filter keeps nearly all others out of the shuffle; the join decides.
    few = bounded(recurring, BROADCAST_REGIONS)
    likely = region_filter(recurring, recurring.count()) if few is recurring else None
    named = single.mapInArrow(_keys(words, threshold, True, likely), "_key long, _short long, _ring long, _need long")
    inside = materialise(named.join(few, "_key", "left_semi"), "op7-inside")
    likely = inside.groupBy("_short", "_ring").agg(F.count("*").alias("_c"), F.max("_need").alias("_need")).filter("_c >= _need").select("_short", "_ring")
    inside = materialise(inside.join(likely, ["_short", "_ring"], "left_semi").select("_key", "_short"), "op7-likely")
    stars = inside.join(inside.groupBy("_key").agg(F.min("_short").alias("_first")), "_key").select(F.col("_first").alias("_a"), F.col("_short").alias("_b"))
    clusters = materialise(components(stars, "op7-clusters"), "op7-clustered")
    wanted = sets.withColumnRenamed("_short", "_node").join(clusters, "_node").select("_rid", "_set", "_weight", F.col("_root").alias("_region"))
    wanted = materialise(wanted, "op7-wanted")
    texts = rows.select("_rid", "_text").join(bounded(wanted.select("_rid")), "_rid", "left_semi").join(wanted, "_rid").select("_region", "_set", "_weight", "_text")
    members = materialise(texts.mapInArrow(_member_sets(words), "_region long, _set binary, _weight long, _own binary").withColumn("_home", F.lit(True)), "op7-members")
    links = materialise(_links(members, threshold), "op7-links")
    joined = components(links.select(F.col("_set").alias("_a"), F.col("_least").alias("_b")), "op7-components")
    own = links.groupBy("_set").agg(F.sum("_links").alias("_links"))
    groups = joined.join(sets.select(F.col("_set").alias("_node"), "_least_id"), "_node")
    least = groups.groupBy("_root").agg(F.min("_least_id").alias("_group_id"))
    found = sets.join(joined.withColumnRenamed("_node", "_set"), "_set", "left").join(least, "_root", "left").join(own, "_set", "left")
    found = found.select("_set", F.coalesce("_root", "_set").alias("_group"), F.coalesce("_group_id", "_least_id").alias("_component"), (F.col("_weight") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"))
    out = described.join(materialise(found, "op7-found"), "_set", "left")
    lone = F.col("_n") == 0
    return out.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.when(lone, F.col("_id")).otherwise(F.col("_component")).alias("component_id"), F.when(lone, F.lit(0)).otherwise(F.col("_links")).cast("long").alias("n_links"), "_rid", "_group"
    )


def drop_near_copies(docs: DataFrame, words: int, threshold: Threshold, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked documents: the one with the least id (of equal ids, the first in the input). Documents with an empty set all stay."""
    docs = stored(docs)
    found = near_groups(docs, words, threshold, id_col, text_col).filter("n_shingles > 0 and n_links > 0")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "_rid")
    first = found.groupBy("_group").agg(F.min(order).alias("first")).select("first._rid")
    dropped = materialise(found.select("_rid").join(materialise(first, "op7-first"), "_rid", "left_anti"), "op7-dropped")
    return with_row_id(wrapped(docs), "_rid").join(bounded(dropped), "_rid", "left_anti").select("doc.*")
