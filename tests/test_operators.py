"""Operators on small hand-made frames."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrifold.functions import scalar as S
from metrifold.operators import anomaly as N
from metrifold.operators import correlate as C
from metrifold.operators import joins as J
from metrifold.operators import overview as O
from metrifold.operators import rates as R
from metrifold.operators import stability as T
from metrifold.sources import readers as I
from metrifold.sources import writers as W

SEC = 1_000_000_000


def samples(spark, values, key="a", step=SEC):
    return spark.createDataFrame([(key, i * step, float(v)) for i, v in enumerate(values)], "k string, ts_ns long, value double")


def test_rate_raw_takes_a_fall_as_a_reset(spark):
    got = R.rate_raw(samples(spark, [0, 10, 30, 5, 8]), ["k"]).orderBy("ts_ns").collect()
    assert [r.value for r in got] == [10, 20, 5, 3]


def test_rate_grid_equals_raw_on_aligned_samples(spark):
    d = samples(spark, [0, 10, 30, 60])
    raw = [r.value for r in R.rate_raw(d, ["k"]).orderBy("ts_ns").collect()]
    assert [r.value for r in R.rate_grid(d, ["k"], SEC).orderBy("ts_ns").collect()] == raw


def test_rate_band_holds_the_nominal(spark):
    d = samples(spark, [0, 10, 30]).withColumns({"window_begin_ns": F.col("ts_ns") - 5_000_000, "window_width_ns": F.lit(50_000_000)})
    for r in R.rate_raw(d, ["k"]).collect():
        assert r.lo <= r.value <= r.hi


def test_double_exp_needs_two_samples(spark):
    assert R.double_exp(samples(spark, [4]), ["k"], 0.5, 0.5).first().value is None
    assert R.double_exp(samples(spark, [1, 2, 3, 4]), ["k"], 0.5, 0.5).first().value == pytest.approx(4.0)


def test_a_level_shift_is_a_change_point(spark):
    v = [10 + (i % 3) * 0.1 for i in range(100)] + [20 + (i % 3) * 0.1 for i in range(100)]
    d = R.indexed(samples(spark, v), ["k"])
    got = N.change_points(d, ["k"], step_s=1.0, tau=15).collect()
    assert any(abs(r.idx - 100) <= 15 and r.after > r.before for r in got)


def test_r_band_is_nominal_for_points_and_wider_for_boxes(spark):
    rows = [("p", float(i), float(i), float(i), 2.0 * i, 2.0 * i, 2.0 * i) for i in range(20)] + [("q", float(i), i - 3.0, i + 3.0, i + (-1.0) ** i, i - 4.0, i + 4.0) for i in range(20)]
    got = {r.pair: r for r in C.r_band(spark.createDataFrame(rows, "pair string, x double, xlo double, xhi double, y double, ylo double, yhi double")).collect()}
    assert got["p"].r_min == pytest.approx(1) and got["p"].r_max == pytest.approx(1)
    assert got["q"].r_min < got["q"].r < got["q"].r_max <= 1


def test_constant_series_have_no_correlation(spark):
    j = spark.createDataFrame([("p", 0, 1.0, float(i)) for i in range(10)], "pair string, lag long, x double, y double")
    assert C.xcorr(j).first().r == 0


def test_division_has_no_band_where_the_divisor_may_be_zero(spark):
    a = samples(spark, [1]).withColumns({"lo": F.lit(0.5), "hi": F.lit(2.0)})
    b = samples(spark, [1]).withColumns({"lo": F.lit(-1.0), "hi": F.lit(2.0)})
    r = J.binop(a, b, "/").first()
    assert r.value == 1 and r.lo is None and r.hi is None


def test_durations_and_times(spark):
    d = spark.createDataFrame([("1m30s",), ("250ms",), ("77",), ("x",)], "c string")
    assert [r[0] for r in d.select(S.to_duration_ns(F.col("c"))).collect()] == [90 * SEC, 250_000_000, 77, None]
    t = spark.createDataFrame([("1970-01-01T00:00:01Z",), ("1970-01-01 00:01",), ("1970-01-01T01:00:00+01:00",), ("1969-12-31T00:00:00Z",), ("no",)], "c string")
    assert [r[0] for r in t.select(S.to_ts_ns(F.col("c"))).collect()] == [SEC, 60 * SEC, 0, None, None]


def test_quantile_labels(spark):
    d = spark.createDataFrame([("0.5",), ("50",), ("p99",), ("0.999",), ("z",)], "c string")
    assert [r[0] for r in d.select(S.quantile_label(F.col("c"))).collect()] == ["p50", "p50", "p99", "p999", None]


def test_prometheus_text(spark):
    text = ["# TYPE reqs counter", 'reqs{op="re\\"ad",x="1"} 5', "# TYPE lat summary", 'lat{quantile="0.5"} 0.2', "lat_sum 9", "lat_count 3", "up:now 1", "bad NaN", "odd_total 4"]
    d = spark.createDataFrame([("s", 1, t) for t in text], "scrape string, ts_ns long, value string")
    got = {r.metric: r for r in I.read_prometheus_text(d).collect()}
    assert got["reqs"].kind == "counter" and got["reqs"].labels == {"op": 're"ad', "x": "1"}
    assert got["lat"].kind == "gauge" and got["lat"].labels == {"quantile": "0.5"}
    assert got["lat_sum"].kind == got["lat_count"].kind == got["odd_total"].kind == "counter"
    assert got["up_now"].kind == "gauge" and "bad" not in got


def test_line_protocol(spark):
    text = ['# SESSION run="7" op="none"', "# a comment", 'q{op="read"} gauge:3.5', "n counter:8", "h histogram:3,20:1 0 2"]
    d = spark.createDataFrame([("f", 1, t) for t in text], "file string, ts_ns long, value string")
    got = {r.metric: r for r in I.read_line_protocol(d).collect()}
    assert got["q"].value == 3.5 and got["q"].labels == {"run": "7", "op": "read"}
    assert got["n"].kind == "counter" and got["n"].labels["op"] == "none"
    assert got["h"].gp == 3 and got["h"].mvp == 20 and got["h"].buckets == [1, 0, 2]


def test_annotations_and_templates(spark, tmp_path):
    doc = {"overall": {"summary": "s", "confidence": "High", "evidence": [], "status": "Actionable"}, "findings": [{"summary": "f", "confidence": "High", "priority": "High", "kind": {"type": "Bottleneck", "subsystem": "cpu"}, "evidence": [{"metric": "m", "anomaly_index": 3}]}], "ruled_out": []}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = I.read_assessments(spark, str(tmp_path / "a.json")).first()
    assert got.findings[0].evidence[0].anomaly_index == 3 and got.findings[0].kind.subsystem == "cpu" and got.overall.status == "Actionable"


def test_overview_is_deterministic(spark):
    v = [10 + (i % 3) * 0.1 for i in range(70)] + [30 + (i % 3) * 0.1 for i in range(70)]
    d = R.indexed(samples(spark, v).withColumnRenamed("k", "metric"), ["metric"])
    flat = R.indexed(samples(spark, [5] * 70, "flat").withColumnRenamed("k", "metric"), ["metric"])
    f = O.extract_features(d.unionByName(flat))["metrics"].orderBy("metric").collect()
    assert [(r.metric, r.status) for r in f] == [("a", "Analyzed"), ("flat", "Constant")]
    assert f[0].tier == "Full" and f[1].tier == "Summary" and f[1].anomalies == 0
    rank = spark.createDataFrame([("cpu", 1, "x")], "domain string, rank long, name string")
    corr = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, r double")
    docs = [O.overview_document(spark.createDataFrame(rows, "metric string, status string"), rank, corr).first()[0] for rows in ([("a", "x"), ("b", "y")], [("b", "y"), ("a", "x")])]
    assert docs[0] == docs[1]


def test_labels_that_are_missing_match_and_doubles_are_an_error(spark):
    from metrifold.operators import joins as J

    a = spark.createDataFrame([("x", None, 1, 2.0), ("y", "r", 1, 3.0)], "id string, op string, ts_ns long, value double")
    b = spark.createDataFrame([("x", None, 1, 4.0), ("y", "r", 1, 5.0)], "id string, op string, ts_ns long, value double")
    assert sorted((r.id, r.value) for r in J.binop(a, b, "*").collect()) == [("x", 8.0), ("y", 15.0)]
    twice = b.unionByName(b.where("id = 'y'"))
    for args in ((a, twice, {}), (twice, a, {}), (a, twice, {"on": ["op"], "many": "left"})):
        with pytest.raises(Exception, match="several samples"):
            J.binop(args[0], args[1], "+", **args[2]).collect()
    many = spark.createDataFrame([("x", None, 1, 1.0), ("z", None, 1, 2.0)], "id string, op string, ts_ns long, value double")
    assert sorted((r.id, r.value) for r in J.binop(many, b.drop("id"), "+", on=["op"], many="left").collect()) == [("x", 5.0), ("z", 6.0)]


def test_alignment_keeps_bands_and_windows(spark):
    from metrifold.operators import joins as J

    cols = "k string, ts_ns long, value double, lo double, hi double, window_begin_ns long, window_end_ns long"
    a = spark.createDataFrame([("a", 12, 10.0, 9.0, 11.0, 5, 7)], cols)
    b = spark.createDataFrame([("a", 17, 2.0, 1.0, 4.0, 6, 9)], cols)
    r = J.binop(a, b, "*", align=10, widen=True).collect()
    spread = (44.0 - 9.0) * 4 / 1e9
    assert [(x.ts_ns, x.value) for x in r] == [(20, 20.0)] and r[0].lo == pytest.approx(9.0 - spread) and r[0].hi == pytest.approx(44.0 + spread)


def test_decimated_bins_keep_the_edges_of_their_bands(spark):
    from metrifold.operators import compare as M

    d = spark.createDataFrame([("a", i, float(i), float(i) - 1 if i else None, float(i) + 2 if i else None) for i in range(10)], "k string, ts_ns long, value double, lo double, hi double")
    got = {r.bin: (r.min, r.median, r.max, r.unc_lo, r.unc_hi) for r in M.boxplot(d, ["k"], 2).collect()}
    assert got == {0: (0.0, 2.0, 4.0, 0.0, 6.0), 1: (5.0, 7.0, 9.0, 4.0, 11.0)}


def test_the_best_lag_is_chosen_before_its_points_are_counted(spark):
    from metrifold.operators import correlate as C

    r = spark.createDataFrame([("p", -2, 0.9, 4), ("p", 1, 0.8, 50), ("q", 1, -0.7, 9), ("q", -1, 0.7, 9), ("q", 0, 0.1, 9), ("z", 0, 0.0, 99)], "pair string, lag long, r double, n long")
    assert [tuple(x) for x in C.best_lag(r, 2.5).collect()] == [("q", -1, -2, 0.7, 9)]
    far = spark.createDataFrame([("p", 0, 1e9 + i, 1e9 + (i * 7) % 11) for i in range(200)], "pair string, lag long, x double, y double")
    want = np.corrcoef(range(200), [(i * 7) % 11 for i in range(200)])[0, 1]
    assert C.xcorr(far).first().r == pytest.approx(want, abs=1e-6)  # sums of squares of 1e9 would have no digit left


def test_le_bounds_are_cut_and_share_a_layout(spark):
    from metrifold.operators import histogram as H

    rows = [("m", 0, -1.0, 1), ("m", 0, 0.0, 3), ("m", 0, 0.004, 6), ("m", 0, 1.5, 10), ("m", 0, float("inf"), 12), ("t_seconds", 0, 2e-9, 4), ("t_seconds", 0, 3.7e-9, 9)]
    got = {(r.metric, r.bucket): (r["count"], r.mvp) for r in H.from_le(spark.createDataFrame(rows, "metric string, ts_ns long, le double, cum long"), ["metric"]).collect()}
    index = spark.range(1).select(H.bucket_index(F.lit(1500), 7).alias("i")).first().i
    assert got == {("m", 0): (3, 12), ("m", 4): (3, 12), ("m", index): (4, 12), ("t_seconds", 2): (4, 8), ("t_seconds", 3): (5, 8)}


def test_views_take_series_whose_clocks_differ_to_a_grid(spark):
    from metrifold.plans import views as V

    rows = [("cpu_usage", {"id": str(h)}, 10 * t * SEC + h * 7, 10 * t * 500_000_000) for h in (0, 1) for t in range(5)]
    cores = [("cpu_cores", {}, t * SEC, 4) for t in range(0, 60, 20)]
    kind = "metric string, labels map<string,string>, ts_ns long, value long"
    on = V.on_grid(spark.createDataFrame(rows, kind), spark.createDataFrame(cores, kind), 10 * SEC)
    got = {r.ts_ns // SEC: r.value for r in V.view(on, "cpu.busy").collect()}
    assert got == {t: pytest.approx(0.125 if t == 10 else 0.25) for t in (10, 20, 30, 40)}  # at 10 s the second has no rate yet


def test_selected_cgroups_and_the_rest(spark):
    from metrifold.plans import views as V

    d = spark.createDataFrame([("cgroup_cpu_usage", {"name": n} if n else {}, 1, v) for n, v in (("/a", 1e9), ("/ab", 2e9), ("/b", 4e9), (None, 8e9))], "metric string, labels map<string,string>, ts_ns long, value double")
    got = {(r.view, r.grp): r.value for r in V.evaluate(d, V.cgroup_views("/a|/b")).where("value <> 0").collect() if r.view.startswith("cores")}
    assert got == {("cores_selected", "/a"): 1.0, ("cores_selected", "/b"): 4.0, ("cores_rest", None): 10.0}
