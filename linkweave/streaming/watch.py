"""Watching: a leading-edge throttle over change events, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.cache import filter_cached


def _fires(times: np.ndarray, last: int | None, gap: int) -> tuple[list[int], int | None]:
    """Places of ascending times that fire, and the last time that did: a jump for each, not a step for each event."""
    places, i = [], 0 if last is None else int(np.searchsorted(times, last + gap))
    while i < len(times):
        places.append(i)
        last = int(times[i])
        i = max(i + 1, i + int(np.searchsorted(times[i:], last + gap)))
    return places, last


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


def throttled(events: DataFrame, key: str, ts: str, seconds: float, order: str) -> DataFrame:
    """Events that fire: the first of a key, then each at least ``seconds`` after the last that fired; the others are dropped.

    Ties in time go by ``order``; null keys are one key, and a null time never fires.  A
    group passes its task as a sorted stream, with the last firing time as the only state.
    """
    gap = int(seconds * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = object(), None
        for batch in batches:
            times, kinds = _micros(batch[ts]), pd.factorize(batch[key])[0]
            cut, keep = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1], True]) if len(kinds) else [], []
            for a, b in zip(cut[:-1], cut[1:]):
                own = batch[key].iloc[a]
                own = None if pd.isna(own) else own
                last = last if own == last_key else None
                places, last = _fires(times[a:b], last, gap)
                keep += [a + p for p in places]
                last_key = own
            yield batch.iloc[keep]

    return events.filter(F.col(ts).isNotNull()).repartition(key).sortWithinPartitions(key, ts, order).mapInPandas(run, events.schema)


class Throttle(StatefulProcessor):
    """The same for a stream: one state value a key, the last firing time in microseconds."""

    def __init__(self, ts: str, seconds: float):
        self.ts, self.gap = ts, int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        last = self.last.get()[0] if self.last.exists() else None
        for batch in rows:
            batch = batch[batch[self.ts].notna()].sort_values(self.ts, kind="stable")
            places, last = _fires(_micros(batch[self.ts]), last, self.gap)
            yield batch.iloc[places]
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def throttled_stream(events: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """``throttled`` over a streaming DataFrame; needs the RocksDB state store."""
    return events.groupBy(key).transformWithStateInPandas(Throttle(ts, seconds), events.schema, "Append", "none")


def on_change(changes: DataFrame, action: Callable[[DataFrame], None], checkpoint: str):
    """Start a query that calls ``action`` with each batch of changes that isn't empty."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            action(batch)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental(files: DataFrame, cache_path: str) -> DataFrame:
    """Files that changed since the cache at ``cache_path`` (none yet: all)."""
    spark = files.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return files.withColumn("state", F.lit("new"))
    return filter_cached(files, spark.read.parquet(cache_path)).filter("state in ('new', 'changed')")
