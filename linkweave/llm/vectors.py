"""What both vector searches share: usable vectors, and the last top-k merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(table: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """(vec_id, v) of the rows that take part, v as array<double>.

    Left out are null ids, null and empty vectors, vectors that hold null or
    non-finite components (or only zeros, if ``nonzero``), and vectors of another
    length than the commonest.
    """
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad)
    if nonzero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (length["d"] if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as the rows of an array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def packed(column: pa.Array) -> np.ndarray:
    """Binary values of equally many doubles as the rows of an array."""
    if not len(column):
        return np.zeros((0, 0))
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float64).reshape(len(column), -1)


def stretches(shard: np.ndarray, is_query: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the stretches of rows that agree in both."""
    if not len(shard):
        return []
    edge = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (is_query[1:] != is_query[:-1]), True])
    return list(zip(edge[:-1].tolist(), edge[1:].tolist()))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller id, ranked from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]
