"""Recordings written by Arrow with field metadata: labels, exact counters, bucket lists and windows come back."""

import collections

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from metrifold.operators import histogram as H
from metrifold.operators import rates as R
from metrifold.sources import recording as S

GP, MVP = 2, 6
SECOND = 1_000_000_000
BIG = 2**53 + 1


def _field(name, kind, metric_type, **meta):
    return pa.field(name, kind, metadata={"metric_type": metric_type, **{k: str(v) for k, v in meta.items()}})


@pytest.fixture(scope="module")
def where(tmp_path_factory):
    """Two segments; the second has a column more. One counter with its own windows, one under the table's; a histogram without a layout."""
    path = tmp_path_factory.mktemp("recording")
    lists = [[i * j for j in range(H.bucket_count(GP, MVP))] for i in (1, 2, 4, 7)]
    for part, rows in enumerate(([0, 1], [2, 3])):
        ts = [(10 + i) * SECOND for i in rows]
        columns = {
            pa.field("timestamp", pa.uint64(), False, {"metric_type": "timestamp", "unit": "nanoseconds"}): ts,
            pa.field("duration", pa.uint64()): [SECOND] * 2,
            pa.field(":wall_offset", pa.int64()): [None, 5 + part],
            pa.field(":window_begin", pa.int64()): [-100, -100],
            pa.field(":window_width", pa.uint64()): [10, 10],
            _field("cpu/0", pa.uint64(), "counter", metric="cpu_cycles", id=0, op="user"): [BIG + 3 * i for i in rows],
            pa.field("cpu/0:window_begin", pa.int64()): [-1000 - i for i in rows],
            pa.field("cpu/0:window_width", pa.uint64()): [100 + i for i in rows],
            _field("cpu/1", pa.uint64(), "counter", metric="cpu_cycles", id=1, op="user"): [2**64 - 5, 2**64 - 1] if part == 0 else [7, None],
            _field("depth", pa.int64(), "gauge"): [-1, 2],
            _field("late:buckets", pa.list_(pa.uint64()), "histogram", metric="latency", grouping_power=GP, max_value_power=MVP, op="read"): [lists[i] for i in rows] if part == 0 else [None, lists[3]],
            _field("lost:buckets", pa.list_(pa.uint64()), "histogram", metric="lost", grouping_power="x"): [[1], [2]],
        }
        if part:
            columns[_field("n7::temp", pa.int64(), "gauge", node="n7", source="web")] = [3, 4]
        schema = pa.schema(list(columns))
        pq.write_table(pa.Table.from_arrays([pa.array(v, f.type) for f, v in columns.items()], schema=schema), path / f"part{part}.parquet")
    return str(path)


def test_catalog_comes_from_the_footers(spark, where):
    foot = S.footers(spark, where)
    got = {(r.metric, r.kind, tuple(r.label_names), r.series) for r in S.series_catalog(S.catalog_of(foot)).collect()}
    assert got == {("cpu_cycles", "counter", ("id", "op"), 2), ("depth", "gauge", (), 1), ("latency", "histogram", ("op",), 1), ("temp", "gauge", ("node", "source"), 1)}
    assert sorted((r.rows, r.columns, r.start_ns, r.end_ns) for r in S.tables_of(foot).collect()) == [(2, 12, 10 * SECOND, 11 * SECOND), (2, 13, 12 * SECOND, 13 * SECOND)]


def test_counters_are_exact_and_windows_fall_back_to_the_table(spark, where):
    got = sorted((r.labels["id"], r.ts_ns // SECOND, int(r.value), r.window_begin_ns - r.ts_ns, r.window_width_ns, r.wall_offset) for r in S.read_recording(spark, where).counters.collect())
    want = [("0", 10 + i, BIG + 3 * i, -1000 - i, 100 + i, (None, 5, None, 6)[i]) for i in range(4)]
    want += [("1", 10 + i, v, -100, 10, (None, 5, None)[i]) for i, v in enumerate((2**64 - 5, 2**64 - 1, 7))]
    assert got == want


def test_rates_and_bands_of_a_file_equal_a_loop(spark, where):
    c = S.read_recording(spark, where, ["cpu_cycles"]).counters.withColumn("id", F.col("labels")["id"])
    got = {(r.id, r.ts_ns // SECOND): (r.value, r.lo, r.hi) for r in R.rate_raw(c.select("id", "ts_ns", "value", "window_begin_ns", "window_width_ns"), ["id"]).collect()}
    points = {"0": [(10 + i, BIG + 3 * i, -1000 - i, 100 + i) for i in range(4)], "1": [(10, 2**64 - 5, -100, 10), (11, 2**64 - 1, -100, 10), (12, 7, -100, 10)]}
    want = {}
    for key, rows in points.items():
        for (t0, v0, b0, w0), (t1, v1, b1, w1) in zip(rows, rows[1:]):
            dv, x0, x1 = v1 - v0 if v1 >= v0 else v1, t0 * SECOND + b0, t1 * SECOND + b1
            want[key, t1] = (dv / (t1 - t0), dv / ((x1 + w1 - x0) / 1e9), dv / ((x1 - x0 - w0) / 1e9))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert got["0", 11][0] == 3.0 and got["1", 11][0] == 4.0  # neither difference survives a cast to double first


def test_quantiles_of_a_file_equal_a_loop(spark, where):
    h = S.read_recording(spark, where, ["latency"]).histograms
    assert {(r.gp, r.mvp, r.labels["op"]) for r in h.collect()} == {(GP, MVP, "read")}
    got = {(r.ts_ns // SECOND, r.quantile): r.value for r in H.quantiles(S.sparse(H.delta(h.select("metric", "ts_ns", "buckets"), ["metric"]), ["metric"]), ["metric"], GP, (0.5, 0.99)).collect()}
    ends = [int(r.e) for r in spark.range(H.bucket_count(GP, MVP)).select("id", H.bucket_bounds(F.col("id"), GP)[1].alias("e")).orderBy("id").collect()]
    want = {}
    for t, by in ((11, 1), (13, 5)):
        counts = [by * j for j in range(H.bucket_count(GP, MVP))]
        for q in (0.5, 0.99):
            rank, at = max(1, -(-int(q * 1000) * sum(counts) // 1000)), 0
            while sum(counts[: at + 1]) < rank:
                at += 1
            want[t, q] = float(ends[at])
    assert got == want


def test_only_the_columns_of_the_named_metrics_are_read(spark, where):
    plan = S.read_recording(spark, where, ["depth"]).gauges._jdf.queryExecution().executedPlan().toString()
    read = [line for line in plan.splitlines() if "ReadSchema" in line and "depth" in line]
    assert read and all("cpu" not in line.split("ReadSchema")[1] and "late" not in line.split("ReadSchema")[1] for line in read)
    assert sorted(r.value for r in S.read_recording(spark, where, ["depth"]).samples().collect()) == [-1.0, -1.0, 2.0, 2.0]


def test_tables_in_segments(spark, where):
    r = S.read_tables(spark, one=where, two=where)
    seen = collections.Counter((x.table, x.segment, x.ts_ns // SECOND) for x in r.gauges.where("metric = 'depth'").collect())
    assert seen == {(t, i // 2, 10 + i): 1 for t in ("one", "two") for i in range(4)}
    from metrifold.sources.readers import metrics_in_two_tables

    assert {x.metric for x in metrics_in_two_tables(r.catalog).collect()} == {"cpu_cycles", "depth", "latency", "temp"}
    node = r.gauges.where("metric = 'temp'").select(F.col("labels")["node"].alias("n"), F.col("labels")["source"].alias("s")).distinct().collect()
    assert [tuple(x) for x in node] == [("n7", "web")]


def test_described_columns_come_back_and_unnamed_tables_have_no_layout(spark, tmp_path):
    df = spark.range(3).select((F.col("id") * SECOND).alias("timestamp"), S.described((F.col("id") + 2**62).cast("decimal(20,0)"), "x/1", "reads", "counter", {"disk": "sda"}), F.col("id").cast("double").alias("plain"), F.array(F.col("id")).alias("list"))
    df.coalesce(1).write.parquet(str(tmp_path / "r"))
    r = S.read_recording(spark, str(tmp_path / "r"))
    assert sorted((x.metric, x.labels["disk"], int(x.value)) for x in r.counters.collect()) == [("reads", "sda", i + 2**62) for i in range(3)]
    assert sorted((x.metric, x.value) for x in r.gauges.collect()) == [("plain", float(i)) for i in range(3)] and r.histograms.count() == 0
