"""The incremental file filter: what changed since a cache of (path, hash, mtime) was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``files`` (path, hash, mtime) with state: unchanged, touched (same hash, other mtime), changed or new.

    An equal mtime is believed without looking at the hash.
    """
    old = cache.select("path", F.col("hash").alias("old_hash"), F.col("mtime").alias("old_mtime"))
    state = F.when(F.col("old_mtime").isNull(), "new").when(F.col("mtime") == F.col("old_mtime"), "unchanged").when(F.col("hash") == F.col("old_hash"), "touched").otherwise("changed")
    return files.join(old, "path", "left").withColumn("state", state).drop("old_hash", "old_mtime")


def refreshed(states: DataFrame) -> DataFrame:
    """The next cache: (path, hash, mtime) of files still there."""
    return states.select("path", "hash", "mtime")
