"""The anomaly operators against plain loops, and on a recording with a known step."""

import math

import numpy as np
import pytest

from metrifold.operators import anomaly as N
from metrifold.operators import exhaustive as E
from metrifold.operators import overview as O
from metrifold.operators import rates as R
from metrifold.operators import stability as T
from tests import twins

SEC = 1_000_000_000
RNG = np.random.default_rng(11)
SERIES = {
    "step": [10.0] * 60 + [1000.0] * 60,
    "shift": [50 + 5 * math.sin(i) + (30 if i > 150 else 0) for i in range(300)],
    "spike": [10 + math.sin(i) + (490 if i == 60 else 0) for i in range(121)],
    "noisy": [10 + math.sin(i * 1.7) * (0.1 if i < 200 else 8.0) for i in range(403)],
    "walk": list(100 + np.cumsum(RNG.normal(0, 1, 350))),
    "white": list(RNG.normal(20, 3, 500)),
    "cyclic": [30 + 10 * math.sin(2 * math.pi * i / 20) + float(RNG.normal()) for i in range(400)],
    "flat": [5.0] * 80,
    "short": [1.0, 2.0, 1.0, 9.0, 1.0, 2.0, 3.0, 1.0, 2.0, 1.0, 2.0, 4.0],
    "negative": list(-40 + RNG.normal(0, 2, 150) - np.repeat([0, 25], 75)),
    "zero_mean": [(-1.0) ** i * (1 + (i % 7 == 0) * 4) for i in range(140)],
}


@pytest.fixture(scope="module")
def all_of(spark):
    rows = [(k, i, float(x)) for k, v in SERIES.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "k string, idx long, value double").persist()


def test_deviations_and_tau_equal_loops(all_of):
    devs = T.allan(all_of, ["k"])
    got = {}
    for r in devs.collect():
        got.setdefault(r.k, {})[r.tau] = r.dev
    taus = {r.k: (r.noise, r.tau) for r in T.smoothing_tau(devs, ["k"]).collect()}
    for k, v in SERIES.items():
        want = twins.deviations(v)
        assert got[k] == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert taus[k] == twins.noise_and_tau(want), k


@pytest.mark.parametrize("kind", ["allan", "hadamard", "mod_allan"])
def test_chunks_of_a_residue_join_up(spark, monkeypatch, kind):
    v = list(RNG.normal(0, 1, 900))
    d = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "k string, idx long, value double")
    monkeypatch.setattr(T, "_CHUNK", 16)
    got = {r.tau: r.dev for r in T.DEVIATIONS[kind](d, ["k"]).collect()}
    assert got == pytest.approx({m: want for m in T.taus_up_to(900) if (want := twins.deviation(v, m, kind)) is not None}, rel=1e-7)


@pytest.mark.parametrize("w", [2, 5, 16, 30])
def test_smooth_equals_a_loop(all_of, w):
    got = {(r.k, r.idx): r.smoothed for r in T.smooth(all_of, ["k"], w).collect()}
    for k, v in SERIES.items():
        assert [got[k, i] for i in range(len(v))] == pytest.approx(twins.smooth(v, w), abs=1e-6), k


def test_cliffs_equal_a_loop(all_of):
    got = {}
    for r in N.cliffs(all_of, ["k"]).collect():
        got.setdefault(r.k, {})[r.idx] = (r.kind, round(r.magnitude, 6))
    for k, v in SERIES.items():
        assert got.get(k, {}) == {i: (kind, round(d, 6)) for i, (kind, d) in twins.cliffs(v).items()}, k


def test_cusum_equals_a_loop_at_every_level(all_of):
    got = sorted((r.k, r.level, r.idx, r.side) for r in N.cusum(all_of, ["k"], N.CUSUM_LEVELS).collect())
    assert got == sorted((k, level, i, side) for k, v in SERIES.items() for level, (a, b) in enumerate(twins.LEVELS) for i, side in twins.cusum(v, a, b))


def test_sides_alarm_apart():
    v = np.array([9.0, -3.0, -9.0, 9.0, 9.0] * 40)
    assert N._alarms(v, 0.0, 8.0) == N._alarms(v[:130], 0.0, 8.0)[:0] + N._alarms(v, 0.0, 8.0)
    first, s = N._alarms(v[:77], 0.0, 8.0)
    rest, end = N._alarms(v[77:], s, 8.0)
    assert (first + [77 + i for i in rest], end) == N._alarms(v, 0.0, 8.0)


def test_change_points_equal_a_loop(all_of):
    devs = T.allan(all_of, ["k"])
    got = {}
    for r in N.change_points(all_of, ["k"], devs, 1.0, T.smoothing_tau(devs, ["k"])).collect():
        got.setdefault(r.k, {})[r.idx] = r.confidence
    for k, v in SERIES.items():
        own = twins.deviations(v)
        assert got.get(k, {}) == pytest.approx(twins.changes(v, twins.noise_and_tau(own)[1], own), rel=1e-6), k


@pytest.mark.parametrize("kind", ["allan", "hadamard", "mod_allan"])
def test_transitions_equal_a_loop(all_of, kind):
    got = {}
    for r in T.noise_transitions(all_of.where("k not in ('step', 'flat')"), ["k"], kind).collect():
        got.setdefault(r.k, {})[r.idx] = r.confidence
    for k in SERIES.keys() - {"step", "flat"}:
        assert got.get(k, {}) == pytest.approx({i: c for i, (_, c) in twins.transitions(SERIES[k], kind).items()}), k


def test_detect_equals_loops(all_of):
    got = {}
    for r in N.detect(all_of.where("k not in ('step', 'flat')"), ["k"])["anomalies"].collect():
        got.setdefault(r.k, {})[r.idx] = (r.type, r.confidence, r.severity)
    for k in SERIES.keys() - {"step", "flat"}:
        assert got.get(k, {}) == twins.anomalies(SERIES[k]), k


def test_a_step_in_a_recording_is_found(spark):
    """121 samples a second apart: one counter by 100 each, one by 10 and from 60 s on by 1000, and a steady gauge."""
    rows = [(m, i * SEC, v) for i in range(121) for m, v in (("requests", 100.0 * i), ("stepped", 10.0 * min(i, 60) + 1000.0 * max(0, i - 60)))]
    rates = R.rate_raw(spark.createDataFrame(rows, "metric string, ts_ns long, value double"), ["metric"]).select("metric", "ts_ns", "value")
    depth = spark.createDataFrame([("depth", i * SEC, 5.0) for i in range(121)], "metric string, ts_ns long, value double")
    d = R.indexed(rates.unionByName(depth), ["metric"])
    assert [(r.metric, r.idx, r.kind, r.direction) for r in N.cliffs(d, ["metric"]).collect()] == [("stepped", 60, "step", "Increase")]
    f = O.extract_features(d)
    metrics = {r.metric: r for r in f["metrics"].collect()}
    assert {m: r.status for m, r in metrics.items()} == {"requests": "Constant", "stepped": "Analyzed", "depth": "Constant"}
    assert metrics["stepped"].tier == "Full" and metrics["stepped"].promotion == "anomalous" and metrics["depth"].tier == "Summary"
    assert 60 in {r.idx for r in f["anomalies"].collect()}
    # windows of 30 stand 15 apart: those at 45 and 75 straddle the step, and 60 is too near to the first of them
    shifts = f["shifts"].where("metric = 'stepped'").collect()
    assert [(r.idx, r.direction, r.before, r.after) for r in shifts] == [(45, "Increase", 10.0, 505.0), (75, "Increase", 505.0, 1000.0)]
    assert [r.pct_change for r in shifts] == pytest.approx([4950.0, 100 * 495 / 505])


def test_confidence_falls_with_the_share_of_anomalies(spark):
    a = spark.createDataFrame([("x", 0.8)] * 3 + [("y", 0.9)], "k string, confidence double")
    n = spark.createDataFrame([("x", 10), ("y", 100), ("z", 5)], "k string, n long")
    got = {r.k: r.confidence for r in N.confidence_score(a, n, ["k"]).collect()}
    assert got == pytest.approx({"x": 0.8 * 0.8, "y": 0.9, "z": 1.0})


def test_all_series_of_a_recording(spark):
    """Ratios need both counters; raw parts are skipped; percentiles come from histograms."""
    rows = [(m, c, i * SEC, float(f * i)) for i in range(30) for m, f in (("cpu_aperf", 30), ("cpu_mperf", 10), ("cpu_cycles", 7), ("disk", 2)) for c in (0, 1)]
    counters = spark.createDataFrame(rows, "metric string, cpu int, ts_ns long, value double")
    gauges = spark.createDataFrame([("memory_numa_hit", 0, 1.0), ("depth", 0, 2.0), ("depth", 0, 3.0)], "metric string, ts_ns long, value double")
    histograms = spark.createDataFrame([("latency", 0, b, 10) for b in range(10)], "metric string, ts_ns long, bucket long, count long")
    got = E.all_series(counters, ["cpu"], gauges, histograms, 3)
    assert sorted({(r.metric, r.form) for r in got.select("metric", "form").distinct().collect()}) == [
        ("cpu_cycles", "counter"), ("cpu_frequency_ratio", "derived"), ("depth", "gauge"), ("disk", "counter"), ("latency", "histogram_p50"), ("latency", "histogram_p90"), ("latency", "histogram_p99"),
    ]
    assert {round(r.value, 9) for r in got.where("form = 'derived'").collect()} == {3.0}
    assert [r.value for r in got.where("form = 'gauge'").collect()] == [5.0]
    assert {round(r.value, 9) for r in got.where("metric = 'disk'").collect()} == {4.0}


def test_truth_checks(spark):
    signals = spark.createDataFrame(
        [("e", "a", "RegimeShiftIncreaseInWindow", 10, 20), ("e", "b", "RegimeShiftIncreaseInWindow", 10, 20), ("e", "b", "ElevatedInWindow", 10, 20), ("e", "c", "ElevatedInWindow", 10, 20), ("e", "d", "SubsystemPresent", 0, 9), ("e", "gone", "SubsystemPresent", 0, 9)],
        "experiment string, metric string, check string, from_idx long, to_idx long",
    )
    metrics = spark.createDataFrame([("a", "Full", 1.0, 1.5, "s"), ("b", "Full", 1.0, 1.5, "s"), ("c", "Summary", 1.0, 2.5, "s"), ("d", "Summary", 1.0, 1.0, "s")], "metric string, tier string, p50 double, p99 double, sampler string")
    findings = spark.createDataFrame([("a", "shift", "Increase", 20), ("b", "shift", "Decrease", 15), ("c", "anomaly", None, 30)], "metric string, kind string, direction string, idx long")
    got = {(r.metric, r.check): r.passed for r in O.verify(signals, metrics, findings, spark.createDataFrame([("s",)], "sampler string")).collect()}
    assert got == {("a", "RegimeShiftIncreaseInWindow"): True, ("b", "RegimeShiftIncreaseInWindow"): False, ("b", "ElevatedInWindow"): True, ("c", "ElevatedInWindow"): True, ("d", "SubsystemPresent"): True, ("gone", "SubsystemPresent"): False}


def test_assessments(spark):
    truth = spark.createDataFrame([(e, "cpu", "saturation", "up") for e in "abcd"], "experiment string, subsystem string, mechanism string, direction string")
    f = spark.createDataFrame(
        [("a", "High", "bottleneck", "cpu", "saturation", "up"), ("b", "High", "bottleneck", "cpu", "saturation", "up"), ("b", "Low", "bottleneck", "io", "x", "up"), ("c", "High", "bottleneck", "cpu", "saturation", "down"), ("a", "High", "needs_metric", "m", "x", "y")],
        "experiment string, priority string, kind string, subsystem string, mechanism string, direction string",
    )
    assert {r.experiment: r.matches for r in O.matches_assessment(truth, f).collect()} == {"a": True, "b": False, "c": False, "d": False}
    findings = spark.createDataFrame([(1, "High", "ok"), (2, "High", "none"), (3, "High", "text"), (4, "Low", " "), (5, "High", "band"), (6, "Low", "range")], "finding int, confidence string, summary string")
    evidence = spark.createDataFrame([(1, "m", 0, None, None), (1, None, None, None, None), (3, None, None, None, None), (5, "w", None, None, None), (6, "m", 7, None, None), (6, "gone", None, None, 1)], "finding int, metric string, anomaly_index int, shift_index int, correlation_index int")
    metrics = spark.createDataFrame([("m", 2, 0, False), ("w", 0, 0, True)], "metric string, anomalies int, shifts int, within_band boolean")
    got = {r.finding: list(r.why) for r in O.validate_assessment(findings, evidence, metrics).collect()}
    assert got == {2: ["evidence"], 3: ["pointer"], 4: ["summary"], 5: ["within_band"], 6: ["metric", "index"]}


def test_stream_cusum_equals_a_loop(spark, tmp_path):
    """Against a frozen baseline, over two micro-batches."""
    from metrifold.streaming import live as L

    v = SERIES["shift"]
    rows = [("a", i * SEC, float(x)) for i, x in enumerate(v)]
    for part in (rows[:170], rows[170:]):
        spark.createDataFrame(part, "series string, ts_ns long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("series string, ts_ns long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    base = spark.createDataFrame([("a", float(np.mean(v)), float(np.std(v)))], "series string, mean double, sd double")
    q = L.stream_cusum(src, base, k=0.5, h=5.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.ts_ns // SEC, r.side) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(twins.cusum(v, 0.5, 5.0)) and got
