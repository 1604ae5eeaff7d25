"""Approximate nearest neighbours with an inverted multi-index.

Two halves of the vectors are quantised separately, so K centroids each make K * K
cells.  A query walks the centroid pairs in descending order of their summed inner
products, with a heap over the two sorted lists, until the cells walked hold enough
rows; those are reranked exactly.

The codebooks are fitted on a bounded sample (``SAMPLE_FLOATS``); every row is
indexed.  How large a share of the rows a walk must cover is measured on the same
sample, as what ``recall`` of the true neighbours of sampled queries needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._scratch import store
from .vectors import best, matrix, packed, stretches, top, usable

#: Numbers in the sample; centroids a half at least (if the sample has four times as many rows) and at most; rows a shard holds in memory; queries a task walks.
SAMPLE_FLOATS, LEAST_CENTROIDS, MOST_CENTROIDS, SHARD_ROWS, TASK_QUERIES = 1_300_000, 128, 1_024, 8_192, 200


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        for j in range(x.shape[1]):
            c[:, j] = np.where(n, np.bincount(near, x[:, j], minlength=len(c)) / np.maximum(n, 1), c[:, j])
        if (empty := np.flatnonzero(n == 0)).size:
            c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    norms = (c**2).sum(axis=1)[None, :]
    parts = [(norms - 2 * (x[i : i + 4096] @ c.T)).argmin(axis=1) for i in range(0, len(x), 4096)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, so that equal rows score equally wherever they lie."""
    out = np.zeros(len(rows))
    for column, x in zip(rows.T, q):
        out += column * x
    return out


def best_exact(rows: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, at: np.ndarray | None = None, largest: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k largest ``products`` of the rows ``at`` (all if None), ties to the smaller id.

    A matrix product over all rows, whose sums may differ in their last bits, leaves
    only those that its rounding could put among the k largest; ``largest`` is the
    largest squared norm of ``rows``, if it is known.
    """
    at = np.arange(len(rows)) if at is None else at
    if len(at) > k:
        quick = (rows @ q)[at]
        norm = float((rows**2).sum(axis=1).max()) if largest is None else largest
        slack = 4 * len(q) * np.finfo(float).eps * np.sqrt(norm * (q**2).sum())
        at = at[quick >= np.partition(quick, len(quick) - k)[len(quick) - k] - slack]
    score = products(rows[at], q)
    order = top(score, ids[at], k)
    return at[order], score[order]


class MultiIndex:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.cut = first, second, first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.cut], self.first) * len(self.second) + nearest(x[:, self.cut :], self.second)

    def walk(self, q: np.ndarray, counts: np.ndarray, enough: float) -> np.ndarray:
        """Cells in descending order of summed inner products, until they hold ``enough`` rows.

        The heap has one entry for each centroid of the first half: its next pair, of
        the second half's in their order, whose cell isn't empty.
        """
        a, b = self.first @ q[: self.cut], self.second @ q[self.cut :]
        by_a, by_b = np.argsort(-a), np.argsort(-b)
        table = counts.reshape(len(a), len(b))[by_a][:, by_b]
        i, j = np.nonzero(table)
        held, total = table[i, j].tolist(), (-a[by_a[i]] - b[by_b[j]]).tolist()
        ends = np.searchsorted(i, np.arange(len(a)), "right").tolist()
        heap = [(total[p], p, end) for p, end in zip([0, *ends[:-1]], ends) if p < end]
        heapify(heap)
        out, have = [], 0
        while heap and have < enough:
            _, p, end = heap[0]
            out.append(p)
            have += held[p]
            if p + 1 < end:
                heapreplace(heap, (total[p + 1], p + 1, end))
            else:
                heappop(heap)
        return by_a[i[out]] * len(b) + by_b[j[out]] if out else np.zeros(0, np.int64)

    def needed(self, x: np.ndarray, k: int, recall: float) -> float:
        """Share of the rows to walk, so that this part of the sampled queries' true neighbours is met."""
        cell = self.cells(x)
        counts = np.bincount(cell, minlength=len(self.first) * len(self.second))
        shares = []
        for i in range(0, len(x), max(1, len(x) // 200)):
            score = x @ x[i]
            score[i] = -np.inf
            true = top(score, np.arange(len(x)), min(k, len(x) - 1))
            total = ((self.first @ x[i, : self.cut])[:, None] + (self.second @ x[i, self.cut :])[None, :]).ravel()
            order = np.argsort(-total, kind="stable")
            before = np.empty(len(order))
            before[order] = np.cumsum(counts[order]) - counts[order]
            shares.append(before[cell[true]] / len(x))
        return float(np.quantile(np.concatenate(shares), recall)) if shares and len(x) > 1 else 1.0


def fit(rows: DataFrame, n: int, k: int, recall: float) -> tuple[MultiIndex, float]:
    """Codebooks and the share of rows to walk; a vector of one component gets an empty half."""
    d = len(rows.first()["v"])
    share = min(1.0, SAMPLE_FLOATS / d / n)
    h = F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.lit(1 << 30))
    near = rows.select("vec_id", "v", h.alias("h")).filter(F.col("h") <= int(min(1.0, 1.3 * share) * (1 << 30)))
    drawn = near.orderBy("h", "vec_id", "v").limit(SAMPLE_FLOATS // d + 1).collect()  # the least hashes
    x = np.array([r["v"] for r in drawn])
    x = x[np.random.default_rng(1).permutation(len(x))]
    width = int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, math.sqrt(n / 3)), max(1, len(x) // 4)))
    index = MultiIndex(kmeans(x[:, : d // 2], width), kmeans(x[:, d // 2 :], width))
    return index, index.needed(x, k, recall)


def _assign(index: MultiIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index.cells(x)), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "cell", "v"])

    return run


#: So that rows of one id needn't share a shard.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_NAMES = ["shard", "is_query", "vec_id", "cells", "v"]


def _deal(first: np.ndarray, split: np.ndarray):
    """Each row to its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            shard = first[cell] + (B.mix(ids.astype(np.uint64) + _SPREAD * np.arange(len(ids), dtype=np.uint64)) % split[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.zeros(len(ids), bool)), batch.column(0), pa.array([x.tobytes() for x in cell.astype(np.int32)], pa.binary()), batch.column(2)], _NAMES)

    return run


def _visit(index: MultiIndex, counts: np.ndarray, first: np.ndarray, split: np.ndarray, enough: float):
    """Each query to the shards of the cells it walks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for who, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                walked = index.walk(np.frombuffer(raw), counts, enough).astype(np.int32)
                walked = walked[np.argsort(first[walked], kind="stable")]
                one = walked[split[walked] == 1]
                cut = np.flatnonzero(np.r_[True, np.diff(first[one]) != 0, True]) if len(one) else []
                out += [(int(first[one[a]]), True, who, one[a:b].tobytes(), raw) for a, b in zip(cut[:-1], cut[1:])]
                out += [(int(first[c] + s), True, who, np.int32(c).tobytes(), raw) for c in walked[split[walked] > 1] for s in range(split[c])]
                if len(out) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], _NAMES)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], _NAMES)

    return run


def _rerank(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, cells, rows, ready = None, [], [], [], None
        for batch in batches:
            out: list[list] = [[], [], []]
            shard, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            who, v = batch.column(2).to_numpy(), packed(batch.column(4))
            for a, b in stretches(shard, query):
                if shard[a] != last:
                    last, ids, cells, rows, ready = shard[a], [], [], [], None
                cell = batch.column(3).slice(a, b - a)
                if not query[a]:
                    ids.append(who[a:b].copy())
                    cells.append(np.frombuffer(b"".join(cell.to_pylist()), np.int32))
                    rows.append(v[a:b].copy())
                    continue
                if ready is None:
                    if not ids:
                        continue
                    all_rows = np.concatenate(rows)
                    ready = (np.concatenate(ids), np.concatenate(cells), all_rows, float((all_rows**2).sum(axis=1).max()))
                    rows = []
                for i, own in zip(range(a, b), cell):
                    at = np.flatnonzero(np.isin(ready[1], np.frombuffer(own.as_buffer(), np.int32)) & (ready[0] != who[i]))
                    if not len(at):
                        continue
                    place, score = best_exact(ready[2], ready[0], v[i], k, at, ready[3])
                    out[0].append(np.full(len(place), who[i], np.int64))
                    out[1].append(ready[0][place])
                    out[2].append(score)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(table: DataFrame, every: int = 20, k: int = 20, recall: float = 0.94, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each row whose id ``every`` divides.

    Candidates are all rows but those with the query's own id; ties go to the
    smaller id, and equal vectors have equal scores; a walk goes on until it holds k
    rows besides the query, if there are.  ``recall`` is what the walked share is
    measured for on the sample.
    Rows with a null id, and vectors null, empty, zero, of another than the commonest
    length, or holding null or non-finite components, take no part.  Rows with equal
    ids are separate candidates, and the one least in bytes is the query.  Other
    columns are not read.
    """
    spark = table.sparkSession
    rows = usable(table, id_col, vector_col, nonzero=True)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, share = fit(rows, n, k, recall)
    coded = store(rows.mapInArrow(_assign(index), "vec_id long, cell long, v binary"))
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for cell, c in coded.groupBy("cell").count().collect():  # at most MOST_CENTROIDS squared
        counts[cell] = c
    split = np.maximum(1, -(-counts // SHARD_ROWS))
    first, free, held = np.zeros(len(counts), np.int64), 0, 0
    for cell, c in enumerate(counts.tolist()):
        if split[cell] > 1 or held + c > SHARD_ROWS:
            free, held = free + (held > 0), 0
        first[cell] = free
        if split[cell] > 1:
            free += int(split[cell])
        else:
            held += c
    ask = coded.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("copies"))
    asked, copies = ask.agg(F.count("*"), F.max("copies")).first()
    enough = max(share * n, k + (copies or 1))
    ask = ask.repartition(max(1, math.ceil(asked / TASK_QUERIES)))  # a walk costs far more than its row's bytes tell
    schema = "shard long, is_query boolean, vec_id long, cells binary, v binary"
    work = coded.mapInArrow(_deal(first, split), schema).union(ask.select("vec_id", "v").mapInArrow(_visit(index, counts, first, split, enough), schema))
    found = work.repartition("shard").sortWithinPartitions("shard", "is_query").mapInArrow(_rerank(k), "query_id long, vec_id long, score double")
    return best(found, k)
