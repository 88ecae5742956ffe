"""Exact top-k inner-product search by distributed histogram selection.

Vector components x become ``floor(scale * x)`` with x as double. Vectors that are null or hold null or
non-finite components take no part; neither do rows with a null id. Scores are exact integers, held to a
long's range before they are ranked. Queries meet only candidates of their own dimension.

Queries go to the tasks in broadcast blocks of bounded size; the candidates are read where they lie and
never copied or shuffled. The first passes build, for each query, a histogram of all its scores: bins
between a lower and an upper bound, refined around the bin that holds the k-th largest score until a
bin is one score wide. A task sends only its topmost bins up to its own k-th score: lower ones can't hold
the global k-th. The last pass keeps scores above the k-th value, and of those equal to it the k smallest
ids of each task, which is all that ties can need; ranks follow from (score descending, id ascending).

Rows that repeat an id: each is a candidate, and a repeated query's results are given once, from the
smallest of its vectors. Fewer than k candidates: all are returned. Other columns are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.llm.scratch import shared_dir

CANDIDATE_ROWS, QUERY_ROWS, BINS = 4096, 1024, 1024
#: Bounds of a block of queries: rows, and bytes of their components as doubles.
BLOCK_ROWS, BLOCK_BYTES = 8192, 16 << 20
LOW, HIGH = -(1 << 63), (1 << 63) - 1
TOP = np.uint64(1 << 63)
#: Rows whose integers are below this are scored in doubles.
SMALL = 1 << 20


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    number = lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))  # noqa: E731  NaN is over infinity
    fine = F.coalesce(F.forall("embedding", number), F.lit(False))
    return vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def whole(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is no double."""
    y = scale * x
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def exact_scores(queries: np.ndarray, candidates: np.ndarray, scale: int) -> np.ndarray:
    """Integer inner products: in doubles or longs where they hold every partial sum, else in Python's integers."""
    with np.errstate(over="ignore"):
        q, c = (np.floor(scale * x) for x in (queries, candidates))
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 53:
        return (q @ c.T).astype(np.int64)
    if most < 1 << 62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    a, b = (np.array([[whole(float(x), scale) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (queries, candidates))
    return np.array([[min(max(sum(x * y for x, y in zip(r, s)), LOW), HIGH) for s in b] for r in a], dtype=np.int64).reshape(len(a), len(b))


class QueryBlock:
    """Queries of one dimension with the place in the block of each."""

    def __init__(self, place: np.ndarray, ids: np.ndarray, matrix: np.ndarray, scale: int):
        self.scale = scale
        # Vectors of large integers apart, so that they don't slow the others down.
        large = (np.abs(matrix) >= SMALL / scale).any(axis=1)
        self.parts = [(place[large == w], ids[large == w], matrix[large == w]) for w in (False, True) if (large == w).any()]

    def scored(self, ids: np.ndarray, matrix: np.ndarray):
        """(places of queries, ids of candidates, scores, own) in pieces; own marks a query itself."""
        large = (np.abs(matrix) >= SMALL / self.scale).any(axis=1)
        for w in (False, True):
            cid, rows = ids[large == w], matrix[large == w]
            for a in range(0, len(cid), CANDIDATE_ROWS):
                for place, qid, queries in self.parts:
                    for b in range(0, len(qid), QUERY_ROWS):
                        yield (
                            place[b : b + QUERY_ROWS], cid[a : a + CANDIDATE_ROWS], exact_scores(queries[b : b + QUERY_ROWS], rows[a : a + CANDIDATE_ROWS], self.scale),
                            qid[b : b + QUERY_ROWS, None] == cid[None, a : a + CANDIDATE_ROWS],
                        )


def vectors_by_size(batch: pa.RecordBatch):
    """(size, ids, matrix) of the vectors of each size in a batch of (vec_id, embedding)."""
    sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    for d in np.unique(sizes):
        own = batch.filter(pa.array(sizes == d)) if (sizes != d).any() else batch
        flat = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield int(d), own.column(0).to_numpy(), flat.reshape(own.num_rows, int(d))


def blocks_of(rows: list, scale: int) -> dict[int, QueryBlock]:
    """The query blocks of (vec_id, embedding) rows by dimension."""
    by: dict[int, list[int]] = {}
    for i, (_, v) in enumerate(rows):
        by.setdefault(len(v), []).append(i)
    return {d: QueryBlock(np.array(i), np.array([rows[j][0] for j in i], np.int64), np.array([rows[j][1] for j in i], np.float64).reshape(len(i), d), scale) for d, i in by.items()}


def offsets(scores: np.ndarray, low: int) -> np.ndarray:
    """How far scores lie over ``low``, unsigned."""
    return (scores.view(np.uint64) ^ TOP) - np.uint64(low - LOW)


def block_top_k(candidates: DataFrame, rows: list, k: int, scale: int, bound: int) -> DataFrame:
    """The top k of a block of queries (vec_id, embedding), bounded in size."""
    sc = candidates.sparkSession.sparkContext
    shared = sc.broadcast((rows, scale))
    low, n = max(-bound, LOW), len(rows)
    bits = BINS.bit_length() - 1
    shift = bits * max(0, -(-(min(bound, HIGH) - low).bit_length() // bits) - 1)
    # Per query: scores of interest lie from base on (as offsets over low); need: how many of them are wanted.
    base, need = np.zeros(n, np.uint64), np.full(n, k, np.int64)

    def held() -> tuple[dict[int, QueryBlock], int]:
        rows, scale = shared.value
        return blocks_of(rows, scale), len(rows)

    while shift >= 0:
        state = sc.broadcast((base, need, shift))

        def count(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            blocks, n = held()
            base, need, shift = state.value
            hist = np.zeros((n, BINS), np.int32)
            for batch in batches:
                for d, ids, matrix in vectors_by_size(batch):
                    for place, _, s, own in blocks[d].scored(ids, matrix) if d in blocks else ():
                        u, b = offsets(s, low), base[place][:, None]
                        bins = ((u - b) >> np.uint64(shift)).astype(np.int64)
                        bins[own | (u < b) | (bins >= BINS)] = BINS  # those above the base's bins are counted already
                        m = len(place)
                        hist[place] += np.bincount((bins + np.arange(m)[:, None] * (BINS + 1)).ravel(), minlength=m * (BINS + 1)).reshape(m, BINS + 1)[:, :BINS].astype(np.int32)
            for a in range(0, n, QUERY_ROWS):
                part = hist[a : a + QUERY_ROWS]
                above = np.cumsum(part[:, ::-1], axis=1)[:, ::-1] - part
                i, j = np.nonzero((part > 0) & (above < need[a : a + QUERY_ROWS, None]))
                yield pa.record_batch([pa.array(i + a), pa.array(need[i + a]), pa.array(j), pa.array(part[i, j].astype(np.int64))], names=["query", "need", "bin", "n"])

        counts = candidates.mapInArrow(count, "query long, need long, bin long, n long").groupBy("query", "need", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin")))
        # The bin of the k-th score; with fewer scores than wanted, the lowest bin with any.
        found = (
            counts.select("query", "need", "bin", (upto - F.col("n")).alias("above")).where(F.col("above") < F.col("need"))
            .groupBy("query").agg(F.min("bin").alias("bin"), F.min_by("above", "bin").alias("above"))
        )
        for query, b, above in found.collect():  # a row for each query of the block
            base[query] += np.uint64(b << shift)
            need[query] -= above
        shift -= bits
    state = sc.broadcast(base)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, _ = held()
        asked = np.array([r[0] for r in shared.value[0]], np.int64)
        base, kept, waiting = state.value, np.zeros((3, 0), np.int64), 0
        new: list[np.ndarray] = []

        def best() -> np.ndarray:
            every = np.concatenate((kept, *new), axis=1)
            every = every[:, np.lexsort((every[1], ~every[2], every[0]))]
            first = np.searchsorted(every[0], every[0])
            return every[:, np.arange(every.shape[1]) - first < k]

        for batch in batches:
            for d, ids, matrix in vectors_by_size(batch):
                for place, cid, s, own in blocks[d].scored(ids, matrix) if d in blocks else ():
                    i, j = np.nonzero((offsets(s, low) >= base[place][:, None]) & ~own)
                    new.append(np.stack((place[i], cid[j], s[i, j])))
                    waiting += len(i)
                    if waiting > 500_000:
                        kept, new, waiting = best(), [], 0
        out = best()
        yield pa.record_batch([pa.array(asked[out[0]]), pa.array(out[1]), pa.array(out[2])], names=["query_id", "vec_id", "score"])

    best = candidates.mapInArrow(pick, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of the rows for which ``queries`` holds,
    against every row but their own."""
    spark = vectors.sparkSession
    candidates = usable(vectors)
    asked = candidates.where(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    largest = F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))
    size, dim = candidates.agg(largest, F.max(F.size("embedding"))).first()
    n, widest = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    bound = (whole(float(size or 0.0), scale) + 1) ** 2 * max(1, dim or 0)
    n_blocks = max(1, -(-(n or 0) // min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(1, widest or 1))))))
    path = f"{shared_dir(spark)}/top"
    out = None
    for b in range(n_blocks):
        rows = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).orderBy("vec_id").collect()]  # bounded, as above
        out = block_top_k(candidates, rows, k, scale, bound)
        if n_blocks > 1:
            out.write.mode("append").parquet(path)
    return out if n_blocks == 1 else spark.read.schema(out.schema).parquet(path)
