"""Templates compiled to one aggregation, their failures, and the A/B report of all of them."""

import json

import pytest
from pyspark.sql import functions as F

from metrifold.operators import compare as M
from metrifold.operators import histogram as H
from metrifold.plans import templates as T

DAY = 86_400_000_000_000
SHOP = {"service": "shop", "kpis": [{"title": "sales", "kind": "counter", "select": ["sold"], "scale": 2.0}, {"title": "share", "kind": "gauge", "select": ["used"], "over": ["used"], "plus": ["free"], "by": "disk"}, {"title": "wait", "kind": "histogram", "select": ["delay{op=read}"], "quantiles": [0.5, 1.0], "scale": 10.0}]}


def _write(folder, name, text):
    (folder / name).write_text(text if isinstance(text, str) else json.dumps(text))


@pytest.fixture
def samples(spark):
    rows = [("sold", {}, t, float(v)) for t, v in ((1, 3), (2, 4))] + [("used", {"disk": d}, 1, v) for d, v in (("a", 1.0), ("b", 3.0))] + [("free", {"disk": d}, 1, 1.0) for d in "ab"]
    return spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ns long, value double")


@pytest.fixture
def increments(spark):
    rows = [("delay", {"op": op}, 1, b, n) for op, b, n in (("read", 1, 5), ("read", 3, 5), ("write", 7, 99))]
    return spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ns long, bucket long, count long")


def test_a_file_more_is_a_kpi_more(spark, tmp_path, samples, increments):
    _write(tmp_path, "a.json", SHOP)
    c = T.read_templates(spark, str(tmp_path))
    got = {(r.service, r.title, r.grp, r.ts_ns, r.stat): r.value for r in T.run_kpis(c, samples, increments, 3).collect()}
    want = {("shop", "sales", None, 1, "value"): 6.0, ("shop", "sales", None, 2, "value"): 8.0, ("shop", "share", "a", 1, "value"): 0.5, ("shop", "share", "b", 1, "value"): 0.75, ("shop", "wait", None, 1, "0.5"): 10.0, ("shop", "wait", None, 1, "1.0"): 30.0}
    assert got == want
    _write(tmp_path, "b.json", {"service": "more", "kpis": [{"title": "sales", "kind": "counter", "select": ["sold"]}]})
    more = T.run_kpis(T.read_templates(spark, str(tmp_path)), samples, increments, 3)
    assert {(r.service, r.title, r.ts_ns): r.value for r in more.where("service = 'more'").collect()} == {("more", "sales", 1): 3.0, ("more", "sales", 2): 4.0}
    assert more.count() == len(want) + 2


def test_one_aggregation_serves_all_kpis(spark, samples, increments):
    many = [{"service": f"s{i}", "kpis": [{"title": "k", "kind": "counter", "select": ["sold"], "scale": float(i)}]} for i in range(40)]
    out = T.run_kpis(T.compile_templates(many), samples, increments, 3)
    assert {(r.service, r.ts_ns): r.value for r in out.collect()} == {(f"s{i}", t): i * v for i in range(40) for t, v in ((1, 3.0), (2, 4.0))}
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # as planned and as run


def test_what_cannot_be_compiled_is_a_row_with_its_reason(spark, tmp_path, samples, increments):
    bad = [{"title": "a", "kind": "gauge", "select": []}, {"title": "b", "kind": "none", "select": ["x"]}, {"kind": "gauge", "select": ["x"]}, {"title": "c", "kind": "gauge", "select": ["x{y=~(}"]}, {"title": "d", "kind": "gauge", "select": ["x{"]}, {"title": "e", "kind": "gauge", "select": ["x"], "fn": "median"}, {"title": "f", "kind": "histogram", "select": ["x"], "quantiles": [2.0]}, {"title": "g", "kind": "gauge", "select": ["unheard"]}, {"title": "g", "kind": "gauge", "select": ["sold"]}]
    _write(tmp_path, "bad.json", {"service": "bad", "kpis": bad})
    _write(tmp_path, "shop.json", SHOP)
    _write(tmp_path, "torn.json", '{"service": "torn", "kpis": [')
    c = T.read_templates(spark, str(tmp_path))
    got = {(r.service, r.title): r.status for r in T.statuses(spark, c, T.run_kpis(c, samples, increments, 3)).where("status not in ('ok')").collect()}
    assert got.pop(("bad", "g")) in ("empty", "title given twice")
    assert got == {("bad", "a"): "nothing selected", ("bad", "b"): "unknown kind", ("bad", ""): "no title", ("bad", "c"): "pattern (", ("bad", "d"): "selector x{", ("bad", "e"): "unknown function", ("bad", "f"): "one selector and quantiles of 0 to 1 for a histogram", ("torn.json", ""): "no template"}
    assert T.run_kpis(T.compile_templates([{"service": "x", "kpis": SHOP["kpis"][2:]}]), samples, increments, 3).count() == 2


def test_the_report_has_figures_boxes_and_spectra(spark):
    c = T.compile_templates([SHOP])
    rows = [(arm, "sold", {}, 10 * DAY * k + t * DAY, float(t + k)) for k, arm in enumerate(("baseline", "experiment")) for t in range(12)]
    s = spark.createDataFrame(rows, "arm string, metric string, labels map<string,string>, ts_ns long, value double")
    inc = spark.createDataFrame([(arm, "delay", {"op": "read"}, t, t % 5 + k, 1 + t) for k, arm in enumerate(("baseline", "experiment")) for t in range(9)], "arm string, metric string, labels map<string,string>, ts_ns long, bucket long, count long")
    doc = T.ab_document(c, s, inc, 3, DAY, points=4).persist()
    kpi = {r.stat: r.value for r in doc.where("part = 'kpi' and title = 'sales'").collect()}
    assert (kpi["steps"], kpi["baseline"], kpi["experiment"], kpi["delta"], kpi["higher"]) == (12.0, 11.0, 13.0, 2.0, 1.0)
    box = {(r.arm, r.x, r.stat): r.value for r in doc.where("part = 'box'").collect()}
    assert box["baseline", 0.0, "min"] == 0.0 and box["experiment", 3.0, "max"] == 24.0 and len(box) == 2 * 4 * 5
    spectrum = {(r.arm, round(r.x, 2)): r.value for r in doc.where("part = 'spectrum'").collect()}
    alone = inc.where("arm = 'baseline'").groupBy("bucket").agg(F.sum("count").alias("count")).withColumn("ts_ns", F.lit(0).cast("long"))
    want = {round(r.quantile, 2): r.value * 10 for r in H.spectrum(alone, [], 3).collect()}
    assert {x: v for (a, x), v in spectrum.items() if a == "baseline"} == want and len(spectrum) == 200
    apart = {round(r.x, 2): r.value for r in doc.where("part = 'difference'").collect()}
    assert apart == {x: spectrum["experiment", x] - spectrum["baseline", x] for x in want} and set(apart.values()) == {10.0}
    assert M.boxplot(s.where("arm = 'baseline'"), ["metric"], 4).count() == 4


def test_packaged_templates_compile():
    c = T.packaged()
    assert not c.failures and len(c.views) == 8 and len(c.panels) == 3 and all(kind == "counter" for _, kind in c.views)
