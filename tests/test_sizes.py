"""What only shows on larger tables or with parts made small."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from metrifold.operators import anomaly as N
from metrifold.operators import exhaustive as E
from metrifold.operators import rates as R
from metrifold.operators import scan
from metrifold.operators import stability as S
from metrifold.operators.joins import annotate_samples
from metrifold.plans import catalog
from metrifold.streaming import live as L

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def _same_as_sql(spark, path, name):
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{path}/events.parquet'")
    df = QUERIES[name](spark, path)
    cols = ", ".join(df.columns)
    want = sorted(map(repr, c.execute(f"select {cols} from ({SQL[name]})").fetchall()))
    assert sorted(repr(tuple(r)) for r in df.collect()) == want
    return df


def _events(spark, path, rows):
    """``rows``: a frame with ts_us, user_id, event_type, value."""
    e = rows.select(F.monotonically_increasing_id().alias("event_id"), F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
    e.coalesce(1).write.parquet(f"{path}/rows")
    (path / "rows").rename(path / "events.parquet")
    return str(path)


@pytest.fixture(scope="module")
def one_long_series(spark, tmp_path_factory):
    """Long enough for taus that the SQL does not list."""
    n = spark.range(630_000)
    rows = n.select((1_704_067_200_000_000 + F.col("id") * 1_000_000).alias("ts_us"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), (F.pmod(F.hash("id"), F.lit(1000)) / 10.0).alias("value"))
    return _events(spark, tmp_path_factory.mktemp("long"), rows)


@pytest.mark.parametrize("name", ["d01_allan", "d02_hadamard", "d03_mod_allan", "d04_noise_class"])
def test_taus_of_the_sql_on_a_long_series(spark, one_long_series, name):
    if name == "d04_noise_class":
        c = duckdb.connect()
        c.execute(f"create view events as select * from '{one_long_series}/events.parquet'")
        want = c.execute(SQL[name]).fetchall()
        assert [tuple(r) for r in QUERIES[name](spark, one_long_series).select("metric", "slope", "noise").collect()] == want
    else:
        assert max(r.tau for r in _same_as_sql(spark, one_long_series, name).collect()) == 138_255


@pytest.mark.parametrize("kind", ["allan", "hadamard"])
def test_deviations_over_small_blocks_and_tiles(spark, monkeypatch, kind):
    """Blocks and tiles far shorter than the series, points that lack a value and places that lack a point."""
    monkeypatch.setattr(S, "_CHUNK", 8)
    monkeypatch.setattr(S, "_LAYOUT", (8, 2, 1, 4), raising=False)
    rng = np.random.default_rng(5)
    n = 700
    values = np.cumsum(rng.normal(size=n))
    full = [("full", i, float(v)) for i, v in enumerate(values)]
    holes = [("holes", i, None if i % 97 == 3 else float(v)) for i, v in enumerate(values) if not 200 <= i < 210]
    rows = full + holes + [("short", 0, 1.0), ("short", 1, 4.0)]
    got = {(r.k, r.tau): r.dev for r in S.DEVIATIONS[kind](spark.createDataFrame(rows, "k string, idx long, value double"), ["k"]).collect()}
    order, scale, steps = {"allan": (2, 2.0, (1, -2, 1)), "hadamard": (3, 6.0, (-1, 3, -3, 1))}[kind]
    want = {}
    for name in ("full", "holes"):
        points = {i: v for k, i, v in rows if k == name}
        for tau in S.taus_up_to(len(points)):
            sets = [[points[i + j * tau] for j in range(order + 1)] for i in points if all(i + j * tau in points for j in range(order + 1))]
            squares = [sum(c * v for c, v in zip(steps, s, strict=True)) ** 2 for s in sets if None not in s]
            if sets:
                want[name, tau] = float(np.sqrt(sum(squares) / (scale * tau * tau * len(sets))))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_jitter_of_equal_times(spark, tmp_path):
    """Two samples of a series at one time are 0 ms apart, as in the SQL."""
    at = [(10, 1), (10, 2), (25, 1), (40, 1), (40, 2), (40, 3)]
    rows = spark.createDataFrame([(1_704_067_200_000_000 + 1000 * t, u, "view", float(u)) for t, u in at], "ts_us long, user_id long, event_type string, value double")
    assert sorted(r.gap_ms for r in _same_as_sql(spark, _events(spark, tmp_path, rows), "st08_stream_jitter").collect()) == [0.0, 0.0, 0.0, 15.0, 15.0]


def _stream_of(spark, path, rows, schema, parts):
    """A stream with a micro-batch for each of ``parts``; what a form gives of it is written and read."""
    for i, part in enumerate(parts):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.parquet(f"{path}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def _given(spark, path, sdf):
    q = sdf.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.read.schema(sdf.schema).parquet(f"{path}/out").collect()]


def test_state_goes_on_over_micro_batches_in_pieces(spark, tmp_path, monkeypatch):
    """Snapshots and gaps given in pieces of three rows, over three micro-batches."""
    monkeypatch.setattr(L, "_PIECE", 3)
    rng = np.random.default_rng(3)
    rows = [(k, 10 * i, int(b)) for k in ("a", "b") for i, b in enumerate(rng.integers(0, 4, 20))]
    parts = [[j for j in range(40) if lo <= rows[j][1] < lo + 70][::-1] for lo in (0, 70, 140)]
    src = _stream_of(spark, tmp_path, rows, "series string, ts_ns long, bucket int", parts)
    got = {(k, ts): b for k, ts, b in _given(spark, tmp_path / "h", L.cumulative_histograms(src, "series", 4))}
    want = {(k, ts): [sum(1 for x, t, b in rows if x == k and t <= ts and b == n) for n in range(4)] for k, ts, _ in rows}
    assert got == want
    gaps = _given(spark, tmp_path / "j", L.stream_jitter(src))
    assert sorted(gaps) == sorted((k, ts, 10 / 1e6) for k, ts, _ in rows if ts > 0)


def test_cliffs_over_chunk_ends(spark, monkeypatch):
    """Chunks of 8 rows give the cliffs of one chunk; no window is over a series alone."""
    rng = np.random.default_rng(11)
    v = rng.normal(10, 1, 400) + 30 * (np.arange(400) % 23 == 0) + 12 * (np.arange(400) // 40 % 2) + 8 * (np.arange(400) % 50 < 2)
    d = spark.createDataFrame([(k, i, float(x)) for k in ("a", "b") for i, x in enumerate(v) if k == "a" or i % 9 != 4], "k string, idx long, value double")
    want = sorted(map(tuple, N.cliffs(d, ["k"]).collect()))
    monkeypatch.setattr(scan, "ROWS", 8)
    found = N.cliffs(d, ["k"])
    got = sorted(map(tuple, found.collect()))
    assert len(got) > 20 and [(*g[:2], *g[3:]) for g in got] == [(*w[:2], *w[3:]) for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_series_statistics_join_by_chunk(spark):
    """A join by series alone would leave a series' rows in one task."""
    d = spark.createDataFrame([("a", i, float(i)) for i in range(300)], "k string, idx long, value double")
    for df in (S.smooth(d, ["k"], 4), S.all_noise_transitions(d, ["k"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "__c" in plan and not re.search(r"Join \w+, \(k#\d+ = k#\d+\)\s*$", plan, re.M)


@pytest.mark.parametrize("durations", [[None, 5, 7], [0, 900, 3], []])
def test_annotations_in_slots_of_the_longest(spark, durations):
    """Slots are as narrow as the longest annotation allows, and the rows do not go by them."""
    d = spark.createDataFrame([(t, float(t)) for t in range(-50, 1000, 3)], "ts_ns long, value double")
    at = [(100 * i - 20, n, str(i)) for i, n in enumerate(durations)]
    a = spark.createDataFrame(at, "ts_ns long, duration_ns long, id string").selectExpr("*", "'x' as description", *[f"cast(null as string) as {c}" for c in ("source", "node", "instance")])
    found = annotate_samples(d, a, 400)
    want = sorted((t, i) for t in range(-50, 1000, 3) for s, n, i in at if s <= t <= s + (n or 0))
    assert sorted((r.ts_ns, r.id) for r in found.collect()) == want
    assert "max(duration_ns" in found._jdf.queryExecution().optimizedPlan().toString() or not durations


def test_no_null_arrays_go_to_the_folds(spark, monkeypatch):
    """Spark writes a column of null arrays to Arrow in a time quadratic in a batch's rows."""
    seen = []
    folded = N.folded
    monkeypatch.setattr(N, "folded", lambda d, *a: seen.append(d.where("begins is null").count()) or folded(d, *a))
    monkeypatch.setattr(scan, "ROWS", 16)
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(k, i, float(x)) for k in ("a", "b") for i, x in enumerate(rng.normal(size=100) + 3 * (np.arange(100) > 50))], "k string, idx long, value double")
    long = sorted(map(tuple, N.cusum(d, ["k"], N.CUSUM_LEVELS).collect()))
    assert len(seen) > 1 and not any(seen)
    monkeypatch.setattr(scan, "ROWS", 1000)
    assert long == sorted(map(tuple, N.cusum(d, ["k"], N.CUSUM_LEVELS).collect())) and long


def test_transitions_in_small_tiles(spark, monkeypatch):
    """Each point goes once to a window, and tiles of 8 residues give the transitions of whole windows."""
    rng = np.random.default_rng(7)
    v = [rng.normal(size=n) * (1 + 9 * (np.arange(n) // (n // 5) % 2)) for n in (900, 130, 400)]
    d = spark.createDataFrame([(k, i, None if k == 2 and i % 50 == 7 else float(x)) for k, n in enumerate(v) for i, x in enumerate(n) if k < 2 or not 60 <= i < 64], "k long, idx long, value double")
    want = sorted(map(tuple, S.all_noise_transitions(d, ["k"]).collect()))
    monkeypatch.setattr(S, "_CHUNK", 8)
    found = S.all_noise_transitions(d, ["k"])
    got = sorted(map(tuple, found.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and len(got) > 5 and [g[:3] for g in got] == [w[:3] for w in want]
    assert [x for g in got for x in g[3:]] == pytest.approx([x for w in want for x in w[3:]])


def test_rates_of_series_that_share_a_bucket(spark, tmp_path, monkeypatch):
    """Few calls serve many series; older and equal times are passed over, over three micro-batches, as in a fold of each series."""
    monkeypatch.setattr(L, "BUCKETS", 2)
    rng = np.random.default_rng(4)
    rows = [(k, int(t), float(v)) for k in (None, *"abcdef") for t, v in zip(rng.permutation(40)[:25] * 10, rng.integers(0, 9, 25), strict=True)]
    parts = [list(range(i, len(rows), 3)) for i in range(3)]
    src = _stream_of(spark, tmp_path, rows, "series string, ts_ns long, value double", parts)
    found = L.stream_rate(src)
    assert "pmod" in found._jdf.queryExecution().analyzed().toString()
    got = _given(spark, tmp_path / "r", found)
    want, last = [], {}
    for part in parts:
        for k, t, v in sorted((rows[j] for j in part), key=lambda r: r[1]):
            before = last.get(k)
            if before is None or t > before[0]:
                if before:
                    want.append((k, t, (v if v < before[1] else v - before[1]) / ((t - before[0]) / 1e9)))
                last[k] = (t, v)
    by = lambda r: (r[0] or "", r[1])
    assert sorted(got, key=by) == sorted(want, key=by) and len(got) > 20


@pytest.mark.parametrize("rows", [scan.ROWS, 16])
def test_rates_without_sliding_frames(spark, monkeypatch, rows):
    """A sliding frame goes through a whole range for each sample: quadratic in how dense samples are."""
    monkeypatch.setattr(scan, "ROWS", rows)
    rng, span = np.random.default_rng(6), 50
    points = {k: [(int(t), int(v)) for t, v in zip(sorted(rng.choice(np.arange(-300, 900), n, replace=False)), rng.integers(low, 1000, n), strict=True)] for k, n, low in ((None, 200, 0), ("dense", 700, 0), ("sparse", 9, 0), ("falls", 90, -50))}
    points["ends"] = [(0, 4), (span - 1, 6), (span, 9), (2 * span - 1, 10), (3 * span, 10), (-span, 1)]
    points["ends"].sort()
    d = spark.createDataFrame([(k, t, v) for k, p in points.items() for t, v in p], "k string, ts_ns long, value long")
    want = {}
    for k, p in points.items():
        grown = [0] + [b if b < a else b - a for (_, a), (_, b) in zip(p, p[1:])]
        adj = np.cumsum(grown)
        for t, _ in p:
            inside = [i for i, (x, _) in enumerate(p) if t - span < x <= t]
            since = t - p[inside[0]][0]
            want[k, t] = float(max(adj[inside]) - min(adj[inside])) / (since / 1e9) if since else -1.0
    found = R.rate(d, ["k"], span)
    assert {(r.k, r.ts_ns): -1.0 if r.value is None else r.value for r in found.collect()} == pytest.approx(want, rel=1e-12)
    assert not re.search(r"RangeFrame, -\d+", found._jdf.queryExecution().optimizedPlan().toString())


def test_detection_reads_its_series_once(spark):
    """Anomalies get their times from the written series; the given frame is not worked out again."""
    rng = np.random.default_rng(8)
    v = rng.normal(10, 1, 300) + 40 * (np.arange(300) == 150)
    given = spark.createDataFrame([("m", "gauge", i * 1000, float(x)) for i, x in enumerate(v)], "metric string, form string, ts_ns long, value double")
    found = E.detect_all(given)
    assert "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert (150, 150_000) in {(r.idx, r.ts_ns) for r in found.collect()}


def test_ratios_read_written_rates(spark):
    """The ratios need the summed rates a second time, and not the rates."""
    counters = spark.createDataFrame([(m, u, t * 10**9, t * (u + 2)) for m in ("cpu_instructions", "cpu_cycles") for u in range(2) for t in range(5)], "metric string, usr int, ts_ns long, value long")
    none = spark.createDataFrame([], "metric string, ts_ns long, value double")
    histograms = spark.createDataFrame([], "metric string, ts_ns long, bucket long, count long")
    found = E.all_series(counters, ["usr"], none, histograms, 3)
    assert [r.value for r in found.where("form = 'derived'").collect()] == [1.0] * 4
    plan = found.where("metric like 'cpu%'")._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan
