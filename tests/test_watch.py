"""The throttle, in batch and as a stream, and the file cache."""

import datetime as dt

from linkweave.operators.cache import filter_cached, refreshed
from linkweave.streaming.watch import incremental, throttled, throttled_stream

T0 = dt.datetime(2024, 1, 1)
ROWS = [("a", T0 + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 1, 5, 9, 10, 11, 21])] + [("b", T0 + dt.timedelta(seconds=3), 7)]
FIRES = {0, 4, 6, 7}


def test_batch(spark):
    df = spark.createDataFrame(ROWS, "k string, ts timestamp_ntz, n int")
    assert {r["n"] for r in throttled(df, "k", "ts", 10, "n").collect()} == FIRES
    assert throttled(df.limit(0), "k", "ts", 10, "n").isEmpty()


def test_batch_of_many_keys_null_keys_and_null_times(spark):
    rows = [(k, None if s is None else T0 + dt.timedelta(seconds=s), n) for n, (k, s) in enumerate((k, s) for k in ["x", "y", None] for s in [None, 0, 0, 3, 10, 10, 12, 20, 31])]
    out = throttled(spark.createDataFrame(rows, "k string, ts timestamp_ntz, n int"), "k", "ts", 10, "n")
    assert sorted(r["n"] for r in out.collect()) == [9 * k + n for k in range(3) for n in (1, 4, 7, 8)]
    assert throttled(spark.createDataFrame(rows, "k string, ts timestamp_ntz, n int"), "k", "ts", 0, "n").count() == 24


def test_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        spark.createDataFrame(ROWS, "k string, ts timestamp_ntz, n int").coalesce(1).write.parquet(str(tmp_path / "in"))
        events = spark.readStream.schema("k string, ts timestamp_ntz, n int").parquet(str(tmp_path / "in"))
        q = throttled_stream(events, "k", "ts", 10).writeStream.format("memory").queryName("fires").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert {r["n"] for r in spark.sql("select * from fires").collect()} == FIRES
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_cache(spark, tmp_path):
    now = spark.createDataFrame([("same", "h", 1), ("touched", "h", 2), ("edited", "x", 2), ("new", "h", 1), ("believed", "x", 1)], "path string, hash string, mtime long")
    then = spark.createDataFrame([("same", "h", 1), ("touched", "h", 1), ("edited", "h", 1), ("gone", "h", 1), ("believed", "h", 1)], "path string, hash string, mtime long")
    states = filter_cached(now, then)
    assert {r["path"]: r["state"] for r in states.collect()} == {"same": "unchanged", "touched": "touched", "edited": "changed", "new": "new", "believed": "unchanged"}
    assert incremental(now, str(tmp_path / "cache")).count() == 5
    refreshed(states).write.parquet(str(tmp_path / "cache"))
    assert incremental(now, str(tmp_path / "cache")).count() == 0
