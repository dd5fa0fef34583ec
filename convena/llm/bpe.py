"""Byte-level BPE by a hierarchical-bitmap rank queue.

A pre-token is a linked list of its bytes. Each adjacent pair that can merge puts the position of its left part into the bucket of the
merge's rank; a bitmap of two levels says which buckets hold anything, and find-first-set on it gives the least rank in two steps,
whatever the length. Positions of a bucket are taken from left to right; an entry is stale, and skipped, if its pair has changed since.
Each merge costs constant time, so a pre-token of n bytes takes O(n) steps (O(n log n) where a bucket is re-filled out of order).
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens that a Python worker remembers, in two generations of half as many; bounds its memory to some 250 MB.
REMEMBERED = 1_200_000
#: Pre-tokens over so many bytes are not remembered.
REMEMBERED_BYTES = 256
WORD_BITS, WORD_MASK = 8, 255  # a word of the bitmap has 256 ranks


class Encoder:
    """``pieces``: byte string -> rank; each single byte has one."""

    def __init__(self, pieces: dict[bytes, int], pattern: str):
        self.pieces, self.pattern = pieces, regex.compile(pattern)
        self.bytes_of: list[bytes] = [b""] * (max(pieces.values()) + 1)
        for piece, rank in pieces.items():
            self.bytes_of[rank] = piece
        self.words = Remembered(self)
        self.sizes = [len(x) for x in self.bytes_of]
        self.words_of_bitmap = (len(self.sizes) >> WORD_BITS) + 1

    def ids(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the pair of least rank merges, the leftmost of equal ones first."""
        get, sizes = self.pieces.get, self.sizes
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = [*range(1, n + 1), 0]  # where the part that starts here ends; 0: no part starts here any more
        start = [*range(-1, n)]  # where the part that ends here starts
        buckets: dict[int, list[int]] = {}
        words, top = [0] * self.words_of_bitmap, 0
        for at in range(n - 1):
            rank = get(piece[at : at + 2])
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(at)  # in rising order, which is a heap
                else:
                    buckets[rank] = [at]
                    words[rank >> WORD_BITS] |= 1 << (rank & WORD_MASK)
                    top |= 1 << (rank >> WORD_BITS)
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            bit = bits & -bits
            rank = (word << WORD_BITS) + bit.bit_length() - 1
            bucket = buckets[rank]
            at = heappop(bucket)
            if not bucket:
                words[word] = bits ^ bit
                if bits == bit:
                    top ^= 1 << word
            middle, stop = end[at], at + sizes[rank]
            if not middle or end[middle] != stop:
                continue  # stale: one of the parts has merged with another since
            end[at], end[middle], start[stop] = stop, 0, at
            before, after = start[at], end[stop]
            for left, right in ((before, stop), (at, after)):
                if left >= 0 and right and (new := get(piece[left:right])) is not None:
                    if buckets.get(new):
                        heappush(buckets[new], left)
                    else:
                        buckets[new] = [left]
                        words[new >> WORD_BITS] |= 1 << (new & WORD_MASK)
                        top |= 1 << (new >> WORD_BITS)
        out, at = [], 0
        while at < n:
            out.append(get(piece[at : end[at]]))
            at = end[at]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; a lone surrogate, which UTF-8 can't hold, counts as U+FFFD."""
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Remembered(dict):
    """Pre-token -> its ids as bytes; when half of what may be remembered is young, the older half goes."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            piece = word.encode("utf-8", "replace")
            ids = struct.pack(f"<{len(found := self.encoder.ids(piece))}I", *found)
            if len(piece) > REMEMBERED_BYTES:
                return ids
        if len(self) >= REMEMBERED // 2:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """A rank file: on each line a piece in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as f:  # noqa: PTH123
        return Encoder(read_ranks(f), pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: the id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, on request, ``ids`` (array of int).

    ``ranks_path`` names the vocabulary where every executor has it installed; texts are read whole. A null text counts as empty and gives no
    ids. Other columns are ignored; repeated rows stay repeated; an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                counts, hashes, decoded, lists = [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = encoder.encode(text or "")
                    counts.append(len(ids) // 4)
                    hashes.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                    if with_ids:
                        lists.append(np.frombuffer(ids, dtype="<i4"))
                columns = [part.column("id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, pa.list_(pa.int32()))] if with_ids else columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)
