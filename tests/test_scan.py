"""Two-level scans, chunked folds and selection against plain loops, at chunk sizes from one row to all."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrifold.operators import anomaly as N
from metrifold.operators import rates as R
from metrifold.operators import ranks, scan
from metrifold.operators import stability as T
from tests import twins
from tests.test_anomaly import SERIES

SEC = 1_000_000_000


@pytest.fixture(scope="module")
def counters():
    """Counters with resets, gaps and a null key: {key: [(ts, value)]}."""
    rnd, out = random.Random(2), {}
    for key in ("a", "b", None, "one"):
        ts, v, rows = 0, 0, []
        for _ in range(1 if key == "one" else 90):
            ts += rnd.choice([1, 1, 2, 40]) * SEC
            v = rnd.randrange(9) if rnd.random() < 0.1 else v + rnd.randrange(20)
            rows.append((ts, v))
        out[key] = rows
    return out


def _frame(spark, counters):
    return spark.createDataFrame([(k, t, v) for k, rows in counters.items() for t, v in rows], "k string, ts_ns long, value long")


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_counters_without_resets_equal_a_loop(spark, monkeypatch, counters, rows):
    monkeypatch.setattr(scan, "ROWS", rows)
    d = _frame(spark, counters)
    got = {(r.k, r.ts_ns): (r.prev, r.prev_ts, r.delta, r.adj) for r in R.adjusted(d, ["k"]).collect()}
    want = {}
    for k, points in counters.items():
        total, before = 0, (None, None)
        for t, v in points:
            delta = None if before[1] is None else v - before[1] if v >= before[1] else v
            total += delta or 0
            want[k, t] = (before[1], before[0], delta, total)
            before = (t, v)
    assert got == want
    places = {(r.k, r.ts_ns): r.idx for r in R.indexed(d, ["k"]).collect()}
    assert places == {(k, t): i for k, points in counters.items() for i, (t, _) in enumerate(points)}
    c = scan.chunked(d, ["k"])
    sums = {(r.k, r.ts_ns): (r.s, r.p) for r in scan.previous(scan.prefix_sums(c, {"s": F.col("value")}), {"p": "value"}).collect()}
    assert sums == {(k, t): (sum(v for _, v in points[: i + 1]), points[i - 1][1] if i else None) for k, points in counters.items() for i, (t, _) in enumerate(points)}


@pytest.mark.parametrize("rows", [1, 7])
def test_grid_rates_do_not_depend_on_chunks(spark, monkeypatch, counters, rows):
    d = _frame(spark, counters)
    want = {(r.k, r.ts_ns): r.value for r in R.rate_grid(d, ["k"], 3 * SEC).collect()}
    monkeypatch.setattr(scan, "ROWS", rows)
    got = {(r.k, r.ts_ns): r.value for r in R.rate_grid(d, ["k"], 3 * SEC).collect()}
    assert got.keys() == want.keys() and len(got) > 200 and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)


def test_rows_are_dealt_by_chunks(spark, counters):
    """No window over the rows of a whole series: every window is keyed by chunk, or stands over one row for each chunk."""
    for df in (R.adjusted(_frame(spark, counters), ["k"]), R.indexed(_frame(spark, counters), ["k"])):
        df.collect()
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("__c#" in line for line in windows)
        over_rows = [line for line in windows if line.rstrip().split("], [")[-2].startswith("__k") and "__c" in line.split("], [")[-2]]
        assert over_rows


@pytest.mark.parametrize("rows", [1, 7, 100])
def test_chunked_cusum_equals_a_loop(spark, monkeypatch, rows):
    """Eleven kinds of series, and a drift whose paths do not meet."""
    monkeypatch.setattr(scan, "ROWS", rows)
    monkeypatch.setattr(N, "ROUNDS", 1 if rows == 7 else 3)
    drift = {"drift": [0.01 * i for i in range(300)], "nan": [1.0, float("nan"), 1.0, 2.0] * 20 + [30.0] * 40}
    kinds = {**SERIES, **drift}
    d = spark.createDataFrame([(k, i, float(x)) for k, v in kinds.items() for i, x in enumerate(v)], "k string, idx long, value double")
    got = sorted((r.k, r.level, r.idx, r.side) for r in N.cusum(d, ["k"], N.CUSUM_LEVELS).collect())
    want = []
    for k, v in kinds.items():
        at = [i for i, x in enumerate(v) if x == x]
        want += [(k, level, at[i], side) for level, (a, b) in enumerate(twins.LEVELS) for i, side in twins.cusum([v[i] for i in at], a, b)]
    assert got == sorted(want) and any(x[0] == "nan" for x in got)


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_double_exponential_smoothing_equals_a_fold(spark, monkeypatch, rows):
    monkeypatch.setattr(scan, "ROWS", rows)
    kinds = {**{k: list(v) for k, v in SERIES.items()}, "holes": [1.0, None, 5.0, float("nan"), 2.0], "one": [3.0], "none": [None]}
    d = spark.createDataFrame([(k, i * SEC, None if x is None else float(x)) for k, v in kinds.items() for i, x in enumerate(v)], "k string, ts_ns long, value double")
    got = {r.k: r.value for r in R.double_exp(d, ["k"], 0.3, 0.1).collect()}
    for k, v in kinds.items():
        v = [x for x in v if x is not None and x == x]
        if len(v) < 2:
            assert got.get(k) is None
            continue
        level, slope = v[0], v[1] - v[0]
        for x in v[1:]:
            level, before = 0.3 * x + 0.7 * (level + slope), level
            slope = 0.1 * (level - before) + 0.9 * slope
        assert got[k] == pytest.approx(level, rel=1e-9), k


@pytest.mark.parametrize("rows", [3, 50])
def test_sums_of_chunks_serve_smoothing_and_deviations(spark, monkeypatch, rows):
    monkeypatch.setattr(scan, "ROWS", rows)
    d = spark.createDataFrame([("walk", i, float(x)) for i, x in enumerate(SERIES["walk"])], "k string, idx long, value double")
    got = {r.idx: r.smoothed for r in T.smooth(d, ["k"], 16).collect()}
    assert [got[i] for i in range(len(got))] == pytest.approx(twins.smooth(SERIES["walk"], 16))
    devs = {r.tau: r.dev for r in T.mod_allan(d, ["k"]).collect()}
    assert devs == pytest.approx({m: w for m in T.taus_up_to(350) if (w := twins.deviation(SERIES["walk"], m, "mod_allan")) is not None}, rel=1e-7)


@pytest.mark.parametrize("accuracy, spare", [(10_000, 2e-4), (40, 0.06)])
def test_order_statistics_are_exact(spark, monkeypatch, accuracy, spare):
    """Ties, signed zeros, infinities and a null key, bracketed by the summary and by the ends."""
    monkeypatch.setattr(ranks, "_ACCURACY", accuracy)
    monkeypatch.setattr(ranks, "_SPARE", spare)
    rnd = random.Random(9)
    kinds = {"ties": [rnd.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(501)], None: [rnd.gauss(0, 1) for _ in range(1000)], "zero": [-0.0, 0.0, -0.0, 1.0] * 40, "far": [float("inf"), -float("inf"), 1.0, 2.0, 3.0] * 30, "one": [7.0], "same": [4.0] * 300}
    d = spark.createDataFrame([(k, x) for k, v in kinds.items() for x in v], "k string, value double")
    got = {r.k: r.m for r in N.medians(d, ["k"], F.col("value"), "m").collect()}
    assert got == {k: statistics.median(v) for k, v in kinds.items()}
    tail = {r.k: (r.n, r.p90, r.p10) for r in ranks.order_statistics(d, ["k"], F.col("value"), (0.1, 0.9), {"p90": F.ceil(0.9 * F.col("n")), "p10": F.ceil(0.1 * F.col("n"))}).collect()}
    rank = lambda v, q: sorted(v)[max(0, math.ceil(round(q * len(v), 9)) - 1)]
    assert tail == {k: (len(v), rank(v, 0.9), rank(v, 0.1)) for k, v in kinds.items()}
    finite = {k: v for k, v in kinds.items() if k not in ("far", None)}
    mads = {r.k: (r.median, r.mad) for r in N.mad_stats(d.where("k is not null and k <> 'far'"), ["k"]).collect()}
    assert mads == {k: (statistics.median(v), statistics.median([abs(x - statistics.median(v)) for x in v])) for k, v in finite.items()}
    assert np.isfinite(list(x for p in mads.values() for x in p)).all()
