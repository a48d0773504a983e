"""The rolling buffer and the latest values as streams: restarts, repeats, expiry."""

import os

import pytest
from pyspark.sql import functions as F

from metrifold.streaming import buffer as B

SEC = 1_000_000_000
ROWS = "metric string, series string, ts_ns long, value double"


def _put(spark, path, name, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def _run(spark, src, path, state):
    q = B.rolling_buffer(spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(src), path, state, 10 * SEC, 60 * SEC)
    q.awaitTermination()


def test_a_restart_loses_and_repeats_nothing_and_old_slots_go(spark, tmp_path):
    src, path, state = (str(tmp_path / x) for x in ("src", "buffer", "state"))
    rows = [("m", "a", i * SEC, float(i)) for i in range(100)]
    _put(spark, src, "one", rows[:50])
    _run(spark, src, path, state)
    _put(spark, src, "two", rows[50:])
    _run(spark, src, path, state)
    read = lambda **x: sorted(r.ts_ns // SEC for r in B.buffer_snapshot(spark, path, ROWS, 10 * SEC, **x).collect())
    assert read() == list(range(30, 100))  # the slot that holds 99 - 60 s and those after it
    assert read(lookback_ns=60 * SEC) == list(range(40, 100)) and read(last=5 * SEC) == list(range(94, 100))
    assert read(start=42 * SEC, end=57 * SEC) == list(range(42, 58))
    kept = {s for b in os.listdir(path) if b.startswith("batch=") for s in os.listdir(f"{path}/{b}") if s.startswith("slot=")}
    assert kept == {f"slot={i}" for i in range(3, 10)}
    B.store_batch(spark.createDataFrame(rows[50:], ROWS), 1, path, 10 * SEC, 60 * SEC)  # the second batch runs again
    assert read() == list(range(30, 100))
    late = [("m", "b", 35 * SEC, 1.0), ("m", "b", 5 * SEC, 1.0)]
    _put(spark, src, "three", late)
    _run(spark, src, path, state)
    assert read() == sorted([*range(30, 100), 35])  # of late rows those beyond the lookback go at once
    plan = B.buffer_snapshot(spark, path, ROWS, 10 * SEC, start=42 * SEC, end=57 * SEC)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "slot" in plan.split("PartitionFilters")[1].split("]")[0]


def test_latest_values_expire_with_their_state(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", B.ROCKSDB)
    held = []

    def run():
        sdf = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(src)
        d = B.latest_stream(sdf, ["metric", "series"], 100_000, reserved=("hidden",), delay="1 second")
        q = d.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])

    try:
        _put(spark, src, "one", [("m", f"s{i}", t * SEC, float(10 * i + t)) for i in range(5) for t in (3, 1, 2)] + [("hidden", "x", 5 * SEC, 1.0)])
        run()
        _put(spark, src, "two", [("m", "s0", 50 * SEC, 7.0), ("m", "s1", 2 * SEC, 99.0)])
        run()
        _put(spark, src, "three", [("m", "s9", 120 * SEC, 1.0)])
        run()
        _put(spark, src, "four", [("m", "s9", 121 * SEC, 2.0)])
        run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    changes = spark.read.parquet(out)
    got = sorted(((r.series, r.ts_ns // SEC, r.value, r.expired) for r in changes.collect()), key=str)
    gone = [(f"s{i}", 3, None, True) for i in range(1, 5)]
    want = [(f"s{i}", 3, float(10 * i + 3), False) for i in range(5)] + [("s0", 50, 7.0, False), ("s9", 120, 1.0, False), ("s9", 121, 2.0, False)] + gone
    assert [(s, t, None if v is None or v != v else v, e) for s, t, v, e in got] == sorted(want, key=str)
    assert [(r.series, r.value) for r in B.newest_capped(changes, ["metric", "series"], 5).collect()] == [("s9", 2.0), ("s0", 7.0)]
    assert [r.series for r in B.newest_capped(changes, ["metric", "series"], 1).collect()] == ["s9"]
    assert held[-1] < held[0], held  # the state of what expired is gone


@pytest.mark.parametrize("name", ["metric", "series"])
def test_the_buffer_of_nothing(spark, tmp_path, name):
    d = spark.createDataFrame([], ROWS)
    B.store_batch(d, 0, str(tmp_path / "b"), SEC, SEC)
    assert spark.createDataFrame([], ROWS).select(F.col(name)).count() == 0 and not [x for x in os.listdir(tmp_path / "b") if x.startswith("slot")]
