"""Approximate nearest neighbours by collision-counting hashing with query-aware windows.

Each vector is projected on ``PROJECTIONS`` random directions. A part holds up to ``PART`` vectors and, for each projection alone, their projections in sorted
order. A query opens a window around its own projection in every sorted array; a vector in the window collides with it there, and one that collides in
``THRESHOLD`` of the projections or more is verified by its true distance. Virtual rehashing widens all windows by ``WIDEN`` until the k-th best
verified distance lies within the half-width: then each true neighbour collides in one projection with probability 0.68 or more, and misses the threshold with a chance under 1 %.

Every vector is indexed, where it is read: the table isn't shuffled, and sorting a part costs little beside searching it. Queries go round in waves of ``WAVE_BYTES``, each sent to the tasks
of one scan, which pass on the k best of each query over all their parts. So what is shuffled is k rows for each query and task, whatever the number of vectors; tasks are ``TASKS`` for each core at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, new_table

#: Vectors sorted and searched together.
PART = 4096
PROJECTIONS, THRESHOLD = 40, 20
WIDEN = 1.3
#: Bytes of query vectors sent to every task at a time, and tasks of a scan for each core.
WAVE_BYTES, TASKS = 1 << 25, 4
SEED = 20240601


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(_id, _v as array<double>) of the vectors that take part, and their length: the commonest length (the longer of equally common ones)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")).filter("_id is not null and size(_v) > 0")
    rows = rows.filter(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0))
    top = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = top[0]["d"] if top else 0
    return rows.filter(F.size("_v") == dim), dim


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS))


def _parts(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of up to PART rows at a time."""
    ids, vectors, held = [], [], 0
    for b in batches:
        for start in range(0, b.num_rows, PART):
            part = b.slice(start, PART)
            ids.append(part.column("_id").to_numpy())
            vectors.append(_matrix(part, dim))
            held += part.num_rows
            if held >= PART:
                i, v = np.concatenate(ids), np.concatenate(vectors)
                yield i[:PART], v[:PART]
                ids, vectors, held = [i[PART:]], [v[PART:]], held - PART
    if held:
        yield np.concatenate(ids), np.concatenate(vectors)


def _search(ids: np.ndarray, vectors: np.ndarray, arrays: np.ndarray, order: np.ndarray, own: int, query: np.ndarray, at: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (distances, ids) of ``best`` and this index row for one query."""
    n = len(ids)
    verified = ids == own
    left = n - int(verified.sum())
    near, who = best
    # The first windows hold a sixteenth of the vectors on either side, or reach as far as the k-th best distance of earlier rows.
    reach = max(k, n // 16)
    place = np.array([a.searchsorted(x) for a, x in zip(arrays, at, strict=True)])
    spread = np.minimum(arrays[np.arange(len(at)), np.minimum(place + reach, n - 1)] - at, at - arrays[np.arange(len(at)), np.maximum(place - reach, 0)])
    half = max(float(np.median(np.abs(spread))), 1e-12)
    half = max(half, near[-1]) if len(near) == k else half
    low, high, hits = place.copy(), place.copy(), np.zeros(n, dtype=np.int64)
    while left:
        below = np.array([a.searchsorted(x - half, side="left") for a, x in zip(arrays, at, strict=True)])
        above = np.array([a.searchsorted(x + half, side="right") for a, x in zip(arrays, at, strict=True)])
        entered = [o[a:b] for o, a, b in zip(order, below, low, strict=True)] + [o[a:b] for o, a, b in zip(order, high, above, strict=True)]
        hits += np.bincount(np.concatenate(entered), minlength=n)
        low, high = below, above
        new = np.nonzero((hits >= THRESHOLD) & ~verified)[0]
        if len(new):
            verified[new] = True
            left -= len(new)
            near = np.concatenate([near, np.sqrt(((vectors[new] - query) ** 2).sum(axis=1))])
            who = np.concatenate([who, ids[new]])
            first = np.lexsort((who, near))[:k]
            near, who = near[first], who[first]
        if len(near) == k and near[-1] <= half:
            break
        half = max(half * WIDEN, near[-1] if len(near) == k and near[-1] <= half * WIDEN**2 else 0)
    return near, who


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row of ``queries`` its ``k`` nearest rows of ``vectors`` found, without those of its own id.

    Score is the Euclidean distance in double precision on the original vectors; nearest first, ties to the smaller id; all candidates if there are fewer than k. Vectors that are null,
    empty, zero, of another length than most, or that hold a null or non-finite component take no part, nor do null ids. Equal vectors are all candidates. Repeated rows of one id count as
    candidates each, and a repeated query is answered once. Other columns are ignored; an empty table gives an empty result.
    """
    out = f"query_id long, rank int, `{id_col}` long, score double"
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_col, vector_col)
    if not dim:
        return spark.createDataFrame([], out)
    asked = usable(queries, id_col, vector_col)[0].filter(F.size("_v") == dim).dropDuplicates(["_id"])
    asked = materialise(asked, "op9-queries")
    waves = max(-(-asked.count() * 8 * dim // WAVE_BYTES), 1)
    rows = rows.coalesce(TASKS * max(spark.sparkContext.defaultParallelism, 1))
    path, schema = new_table(spark, "op9-found"), "query_id long, rank int, _w long, score double"
    spark.createDataFrame([], schema).write.parquet(path)
    for wave in range(waves):  # distinct ids, so that a wave is as large as the others but for chance
        own = asked.filter(F.pmod(F.xxhash64("_id"), F.lit(waves)) == wave).toArrow()
        if not own.num_rows:
            continue
        sent = spark.sparkContext.broadcast((own["_id"].to_numpy(), own["_v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)))
        found = rows.mapInArrow(_searcher(sent, dim, k), "query_id long, _w long, score double")
        merged = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "_w"))).filter(F.col("rank") <= k)
        merged.select("query_id", "rank", "_w", "score").write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(schema).parquet(path).select("query_id", "rank", F.col("_w").alias(id_col), "score")


def _searcher(sent, dim: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = sent.value
        directions = _directions(dim)
        asked = queries @ directions
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for have, vectors in _parts(batches, dim):
            projected = vectors @ directions
            order = np.argsort(projected, axis=0, kind="stable")
            arrays, order = np.ascontiguousarray(np.take_along_axis(projected, order, axis=0).T), np.ascontiguousarray(order.T.astype(np.int32))
            best = [_search(have, vectors, arrays, order, own, query, at, found, k) for own, query, at, found in zip(ids.tolist(), queries, asked, best, strict=True)]
        sizes = [len(who) for _, who in best]
        if sum(sizes):
            columns = (np.repeat(ids, sizes), np.concatenate([who for _, who in best]), np.concatenate([near for near, _ in best]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "_w", "score"])

    return run
