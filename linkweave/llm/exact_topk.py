"""Exact top-k inner products by columnar branch-and-bound.

Rows are dealt into shards of bounded size.  In a shard they lie vertically, one
array per dimension.  A query adds up its blocks of dimensions, heaviest first;
after each, what is left of a row's and the query's squared norm bounds the rest of
the product (Cauchy-Schwarz), rows that can't reach the k-th best known score are
compacted away, and the next block touches survivors only.

Every query visits every shard, in batches of the stream: shards hold their rows in
memory (``SHARD_ROWS``), queries pass by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best, matrix, stretches, usable

SHARD_ROWS, BLOCK_DIMS = 16_384, 8


class Shard:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.exact = ids, rows
        self.columns = np.ascontiguousarray(rows.T.astype(np.float64))
        self.blocks = [slice(i, i + BLOCK_DIMS) for i in range(0, len(self.columns), BLOCK_DIMS)]
        self.mass = np.stack([(self.columns[b] ** 2).sum(axis=0) for b in self.blocks])
        self.total = self.mass.sum(axis=0)
        self.largest = float(np.abs(self.columns).max(initial=0))

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than the query's own, of 64-bit integer products."""
        bound = self.largest * float(np.abs(q.astype(np.float64)).max(initial=0)) * len(q)
        if bound >= 2.0**62:  # 64-bit sums may wrap, so no bound holds
            score = self.exact @ q
            keep = np.flatnonzero(self.ids != own)
            at = keep[_top_int(score[keep], self.ids[keep], k)]
            return self.ids[at], score[at]
        slack = 1e-3 + bound * 2.0**-46  # more than the sums of doubles are off
        f = q.astype(np.float64)
        heavy = sorted(self.blocks, key=lambda b: -float((f[b] ** 2).sum()))
        left = float((f**2).sum())
        live, partial, rest = np.arange(len(self.ids)), np.zeros(len(self.ids)), self.total.copy()
        if (mine := np.flatnonzero(self.ids == own)).size:
            live, partial, rest = (np.delete(x, mine) for x in (live, partial, rest))
        least = -np.inf
        for n, b in enumerate(heavy):
            columns = self.columns[b]
            partial += f[b] @ (columns if len(live) == columns.shape[1] else columns[:, live])
            rest -= self.mass[self.blocks.index(b)][live]
            left -= float((f[b] ** 2).sum())
            if len(live) <= k or n + 1 == len(heavy):
                continue
            lead = np.argpartition(partial, len(partial) - k)[len(partial) - k :]
            known = f @ self.columns[:, live[lead]]
            least = max(least, float(known.min()))
            keep = partial + np.sqrt(np.maximum(rest, 0) * max(left, 0)) * (1 + 1e-9) + 2 * slack >= least
            if keep.sum() < 0.8 * len(live):
                live, partial, rest = live[keep], partial[keep], rest[keep]
        score = np.rint(partial).astype(np.int64) if bound < 2.0**52 else self.exact[live] @ q
        at = _top_int(score, self.ids[live], k)
        return self.ids[live[at]], score[at]


def _top_int(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], np.invert(score[at])))[:k]]


def _work(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, rows, shard = None, [], [], None
        for batch in batches:
            key, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            who, v = batch.column(2).to_numpy(), matrix(batch.column(3))
            out: list[list] = [[], [], []]
            for a, b in stretches(key, query):
                if key[a] != last:
                    last, ids, rows, shard = key[a], [], [], None
                if not query[a]:
                    ids.append(who[a:b].copy())
                    rows.append(v[a:b].copy())
                    continue
                if shard is None:
                    if not ids:
                        continue
                    shard = Shard(np.concatenate(ids), np.concatenate(rows))
                    rows = []
                for i in range(a, b):
                    found, score = shard.search(int(who[i]), v[i], k)
                    out[0].append(np.full(len(found), who[i], np.int64))
                    out[1].append(found)
                    out[2].append(score)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    return run


def exact_topk(table: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each row whose id ``every`` divides.

    Components become floor(scale * x) as 64-bit integers (beyond that range they
    saturate) and products beyond it wrap.  Candidates are all rows but those with the query's own id; ties go
    to the smaller id; rows with equal ids are separate candidates.  Rows with a
    null id, and vectors null, empty, of another than the commonest length, or
    holding null or non-finite components, take no part.  Other columns are not read.
    """
    rows = usable(table, id_col, vector_col, nonzero=False).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    # rows of one id needn't share a shard
    data = rows.select(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("is_query"), "vec_id", "v")
    ask = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"), "vec_id", "v")
    work = data.unionByName(ask).repartition("shard").sortWithinPartitions("shard", "is_query")
    return best(work.mapInArrow(_work(k), "query_id long, vec_id long, score long"), k)
