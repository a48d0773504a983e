"""Queries: selection, rates and functions over time, aggregation, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrifold.functions import scalar as S
from metrifold.operators import aggregate as A
from metrifold.operators import base as B
from metrifold.operators import rates as R
from metrifold.operators import select as P
from metrifold.plans.registry import C, G, QUERIES, SQL, X, counters, gauges, query, r6, series, table

U = ["metric", "usr"]
D1, H6 = B.DAY, 6 * B.HOUR


@query("flagship_rate_by_type_hourly", f"""WITH {C}, r AS (SELECT metric, ts_ns, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END * 1e9 / (ts_ns - lag(ts_ns) OVER w) AS rate FROM c WINDOW w AS (PARTITION BY metric, usr ORDER BY ts_ns))
SELECT metric, ts_ns // 3600000000000 AS hour, count(*) AS n, round(sum(rate), 6) AS rate FROM r WHERE rate IS NOT NULL GROUP BY ALL""")
def flagship(s, d):
    r = R.rate_raw(counters(s, d).select(*U, "ts_ns", "value"), U)
    return r.groupBy("metric", B.idiv(F.col("ts_ns"), B.HOUR).alias("hour")).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("rate"))


# --- selection -----------------------------------------------------------------------------------------------------
_SEL = "SELECT metric, usr, ts_ns, value FROM g WHERE "


def _sel(name, where, **how):
    @query(name, f"WITH {G} {_SEL}{where}")
    def f(s, d):
        return P.select(gauges(s, d), **how).select(*U, "ts_ns", "value")


_sel("p01_label_equal", "metric='click' AND usr=7", metric="click", eq={"usr": "7"})
_sel("p02_label_regex", "regexp_full_match(usr::VARCHAR, '1[0-4]|2.')", re={"usr": "1[0-4]|2."})
_sel("p03_label_not_regex", "NOT regexp_full_match(usr::VARCHAR, '.|1.')", not_re={"usr": ".|1."})
_sel("p04_label_not_equal", "metric='view' AND usr<>7", metric="view", ne={"usr": "7"})


@query("p05_time_range_last", f"WITH {G} SELECT metric, usr, ts_ns, value FROM g WHERE ts_ns >= (SELECT max(ts_ns) FROM g) - {3 * D1}")
def p05(s, d):
    return P.time_range(gauges(s, d), last=3 * D1).select(*U, "ts_ns", "value")


@query("p05_time_range_between", f"WITH {G} SELECT metric, usr, ts_ns, value FROM g WHERE ts_ns BETWEEN 1704412800000000000 AND 1704672000000000000")
def p05b(s, d):
    return P.time_range(gauges(s, d), 1704412800000000000, 1704672000000000000).select(*U, "ts_ns", "value")


@query("p06_keep_kpi_series", f"WITH {G} SELECT metric, usr, ts_ns, value FROM g WHERE metric IN ('click','view') OR usr % 5 = 0")
def p06(s, d):
    kpis = table(s, d, "events").where("event_type in ('click','view')").select(F.concat("event_type", F.lit(":p99")).alias("metric")).distinct()
    g = gauges(s, d).withColumn("source", F.when(F.col("usr") % 5 == 0, "agent").otherwise("svc"))
    return P.keep_kpi_series(g, kpis).select(*U, "ts_ns", "value")


@query("p07_keep_samplers", f"WITH {G} SELECT metric, usr, ts_ns, value FROM g WHERE metric IN ('click','error')")
def p07(s, d):
    g = gauges(s, d).withColumn("table", F.concat("metric", F.lit("/"), F.col("usr").cast("string")))
    return P.keep_samplers(g, ["click", "error"]).select(*U, "ts_ns", "value")


@query("p08_filter_descriptions", "SELECT p_type AS metric, min(p_name) AS description FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size < 10) GROUP BY ALL")
def p08(s, d):
    part = table(s, d, "part")
    desc = part.groupBy(F.col("p_type").alias("metric")).agg(F.min("p_name").alias("description"))
    return P.filter_descriptions(desc, part.where("p_size < 10").select(F.col("p_type").alias("metric"))).select("metric", "description")


@query("p09_scope", f"WITH {G} SELECT metric, usr, ts_ns, value FROM g WHERE usr IN (1,2,3) AND metric = 'view'")
def p09(s, d):
    return P.scope(gauges(s, d), usr=["1", "2", "3"], metric="view").select(*U, "ts_ns", "value")


@query("p10_drop_metrics", f"WITH {G} SELECT metric, count(*) AS n FROM g WHERE metric NOT IN ('click','signup') GROUP BY ALL")
def p10(s, d):
    return P.drop_metrics(gauges(s, d), ["click", "signup"]).groupBy("metric").agg(F.count("*").alias("n"))


@query("p11_only_finite", f"WITH {G} SELECT metric, count(*) AS n, round(sum(value),4) AS total, round(sum(CASE WHEN value > 1 THEN value ELSE 0 END),4) AS filled FROM g WHERE value > 1 GROUP BY ALL")
def p11(s, d):
    g = gauges(s, d).withColumn("value", F.when(F.col("value") > 1, F.col("value")).when(F.col("usr") % 2 == 0, F.lit(float("nan"))).when(F.col("usr") % 3 == 0, F.lit(float("inf"))))
    return P.only_finite(g).groupBy("metric").agg(F.count("*").alias("n"), r6(F.sum("value"), 4).alias("total"), r6(F.sum(B.finite_or_zero(F.col("value"))), 4).alias("filled"))


@query("p12_scale_with_band", f"WITH {G} SELECT metric, usr, ts_ns, round(1-value,6) AS value, round(1-(value+2),6) AS lo, round(1-(value-1),6) AS hi FROM g")
def p12(s, d):
    g = gauges(s, d).withColumns({"lo": F.col("value") - 1, "hi": F.col("value") + 2})
    return P.scale(g, "-", 1, left=True).select(*U, "ts_ns", r6("value").alias("value"), r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("p14_domain_base_names", "SELECT DISTINCT p_type AS metric, CASE WHEN split_part(lower(replace(p_type,' ','_')),'_',1)='drive' THEN 'drivehealth' ELSE split_part(lower(replace(p_type,' ','_')),'_',1) END AS domain, lower(replace(p_type,' ','_')) AS base FROM part")
def p14(s, d):
    m = F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))
    return table(s, d, "part").select(F.col("p_type").alias("metric"), S.domain_of(F.concat(F.lit("cgroup_"), m)).alias("domain"), S.base_name(F.concat(m, F.lit(":p99"))).alias("base")).distinct()


@query("p16_consumer_name", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE 'segment=' || c_mktsegment END AS name FROM customer")
def p16(s, d):
    labels = F.when(F.col("c_nationkey") % 2 == 0, F.create_map(F.lit("name"), "c_name", F.lit("zone"), "c_mktsegment")).otherwise(F.create_map(F.lit("zone"), "c_mktsegment", F.lit("segment"), "c_mktsegment"))
    return table(s, d, "customer").select("c_custkey", S.consumer_name(labels).alias("name"))


@query("p17_kpi_available", "SELECT p_brand AS title, count(*) FILTER (p_size > 49) AS rows, count(*) FILTER (p_size > 49) > 0 AS available FROM part GROUP BY ALL")
def p17(s, d):
    part = table(s, d, "part")
    return P.kpi_available(part.where("p_size > 49").withColumnRenamed("p_brand", "title"), part.withColumnRenamed("p_brand", "title"))


@query("p18_classify_sources", f"WITH {G} SELECT usr AS source, CASE WHEN bool_or(metric='error' AND value > 60) OR usr = 1 THEN 'agent' WHEN usr IN (2,3) THEN 'service' ELSE 'simple' END AS source_kind FROM g GROUP BY usr")
def p18(s, d):
    cat = gauges(s, d).select(F.col("usr").alias("source"), F.when((F.col("metric") == "error") & (F.col("value") > 60), "self_error").otherwise(F.col("metric")).alias("metric"))
    return P.classify_sources(cat, agents=(1,), services=(2, 3))


@query("s04_catalog", f"WITH {G} SELECT DISTINCT metric, usr FROM g")
def s04(s, d):
    from metrifold.sources.readers import catalog

    return catalog(gauges(s, d).withColumnRenamed("usr", "series_id")).withColumnRenamed("series_id", "usr")


# --- rates ---------------------------------------------------------------------------------------------------------
_W = "WINDOW w AS (PARTITION BY metric, usr ORDER BY ts_ns)"
_DELTA = f"dd AS (SELECT *, lag(value) OVER w AS prev, lag(ts_ns) OVER w AS pt, lag(window_begin_ns) OVER w AS pb, lag(window_width_ns) OVER w AS pw FROM c {_W}), dl AS (SELECT *, CASE WHEN value < prev THEN value ELSE value - prev END AS delta FROM dd)"
_ADJ = f"{_DELTA}, a AS (SELECT metric, usr, ts_ns, CAST(sum(coalesce(delta,0)) OVER w AS BIGINT) AS adj FROM dl {_W})"


@query("w01_rate_raw", f"WITH {C}, {_DELTA} SELECT metric, usr, ts_ns, round(delta*1e9/(ts_ns-pt),6) AS value FROM dl WHERE prev IS NOT NULL")
def w01(s, d):
    return R.irate(counters(s, d).drop("window_begin_ns", "window_width_ns"), U).select(*U, "ts_ns", r6("value").alias("value"))


@query("w04_rate_band", f"""WITH {C}, {_DELTA}, q AS (SELECT metric, usr, ts_ns, delta*1e9/(ts_ns-pt) AS v, delta*1e9/(window_begin_ns+window_width_ns-pb) AS l, window_begin_ns-pb-pw AS short, delta FROM dl WHERE prev IS NOT NULL)
SELECT metric, usr, ts_ns, round(v,6) AS value, round(least(l,v),6) AS lo, CASE WHEN short > 0 THEN round(greatest(delta*1e9/short,v),6) END AS hi FROM q""")
def w04(s, d):
    return R.rate_raw(counters(s, d), U).select(*U, "ts_ns", r6("value").alias("value"), r6("lo").alias("lo"), r6("hi").alias("hi"))


_GRID = f"""pr AS (SELECT metric, usr, ts_ns, adj::DOUBLE AS v, lag(ts_ns) OVER w AS t0, lag(adj) OVER w AS v0 FROM a {_W}),
 ex AS (SELECT *, unnest(generate_series(CASE WHEN t0 IS NULL THEN (ts_ns+{H6 - 1})//{H6} ELSE t0//{H6}+1 END, ts_ns//{H6})) AS gi FROM pr),
 gr AS (SELECT metric, usr, gi*{H6} AS ts_ns, CASE WHEN t0 IS NULL THEN v ELSE v0+(v-v0)*((gi*{H6}-t0)/(ts_ns-t0)) END AS v FROM ex)"""


@query("w02_rate_grid", f"WITH {C}, {_ADJ}, {_GRID}, o AS (SELECT metric, usr, ts_ns, (v - lag(v) OVER w)/{H6 // B.SECOND} AS value FROM gr {_W}) SELECT metric, usr, ts_ns, round(value,6) AS value FROM o WHERE value IS NOT NULL")
def w02(s, d):
    return R.rate_grid(counters(s, d), U, H6).select(*U, "ts_ns", r6("value").alias("value"))


_RNG = f"w AS (PARTITION BY metric, usr ORDER BY ts_ns RANGE BETWEEN {5 * D1 - 1} PRECEDING AND CURRENT ROW)"


@query("w03_rate_range", f"WITH {C}, {_ADJ} SELECT metric, usr, ts_ns, CASE WHEN ts_ns > min(ts_ns) OVER w THEN round((max(adj) OVER w - min(adj) OVER w)*1e9/(ts_ns - min(ts_ns) OVER w),6) END AS value FROM a WINDOW {_RNG}")
def w03(s, d):
    return R.rate(counters(s, d), U, 5 * D1).select(*U, "ts_ns", r6("value").alias("value"))


@query("w05_increase", f"WITH {C}, {_ADJ} SELECT metric, usr, ts_ns, CASE WHEN ts_ns > min(ts_ns) OVER w THEN round((max(adj) OVER w - min(adj) OVER w)*1e9/(ts_ns - min(ts_ns) OVER w)*432000,3) END AS value FROM a WINDOW {_RNG}")
def w05i(s, d):
    return R.increase(counters(s, d), U, 5 * D1).select(*U, "ts_ns", r6("value", 3).alias("value"))


@query("w05_delta", f"WITH {G} SELECT metric, usr, ts_ns, round(value - first_value(value) OVER w,6) AS value FROM g WINDOW {_RNG}")
def w05d(s, d):
    return R.delta(gauges(s, d), U, 5 * D1).select(*U, "ts_ns", r6("value").alias("value"))


@query("w05_idelta", f"WITH {G}, o AS (SELECT metric, usr, ts_ns, round(value - lag(value) OVER w,6) AS value FROM g {_W}) SELECT * FROM o WHERE value IS NOT NULL")
def w05id(s, d):
    return R.idelta(gauges(s, d), U).select(*U, "ts_ns", r6("value").alias("value"))


#: Moments about the window's own means, times taken from the current row's.
_LINE = f"l0 AS (SELECT metric, usr, ts_ns, list(ts_ns) OVER w AS tt, list(value) OVER w AS yy FROM g WINDOW {_RNG}), l1 AS (SELECT *, list_transform(tt, lambda t: (t - ts_ns) / 1e9) AS xx FROM l0), l2 AS (SELECT *, list_avg(xx) AS mx, list_avg(yy) AS my FROM l1), l3 AS (SELECT metric, usr, ts_ns, mx, my, CASE WHEN len(xx) > 1 THEN list_sum(list_transform(range(1, len(xx) + 1), lambda i: (xx[i] - mx) * (yy[i] - my))) / list_sum(list_transform(xx, lambda x: (x - mx) * (x - mx))) END AS slope FROM l2)"


@query("w05_deriv", f"WITH {G}, {_LINE} SELECT metric, usr, ts_ns, round(slope*86400,4) AS value FROM l3")
def w05v(s, d):
    return R.deriv(gauges(s, d), U, 5 * D1).select(*U, "ts_ns", r6(F.col("value") * 86400, 4).alias("value"))


@query("w05_predict_linear", f"WITH {G}, {_LINE} SELECT metric, usr, ts_ns, round(my - slope*mx + slope*3600,4) AS value FROM l3")
def w05p(s, d):
    return R.predict_linear(gauges(s, d), U, 5 * D1, 3600).select(*U, "ts_ns", r6("value", 4).alias("value"))


for _n, _f, _cmp, _src in (("w05_changes", R.changes, "<>", "g"), ("w05_resets", R.resets, "<", "c")):

    @query(_n, f"WITH {C}, h AS (SELECT metric, usr, ts_ns, CASE WHEN value {_cmp} lag(value) OVER w THEN 1 ELSE 0 END AS hit FROM {_src} {_W}) SELECT metric, usr, ts_ns, CAST(sum(hit) OVER w - first_value(hit) OVER w AS BIGINT) AS value FROM h WINDOW {_RNG}")
    def _steps(s, d, f=_f, src=_src):
        return f((gauges if src == "g" else counters)(s, d), U, 5 * D1)


for _n, _sql in (("avg", "avg"), ("min", "min"), ("max", "max"), ("sum", "sum"), ("stddev", "stddev_pop"), ("stdvar", "var_pop")):

    @query(f"w06_{_n}_over_time", f"WITH {G} SELECT metric, usr, ts_ns, CAST({_sql}(value) OVER w AS FLOAT) AS value FROM g WINDOW {_RNG}")
    def _over(s, d, n=_n):
        return R.over_time(gauges(s, d), U, n, 5 * D1).select(*U, "ts_ns", F.col("value").cast("float").alias("value"))


@query("w06_count_over_time", f"WITH {G} SELECT metric, usr, ts_ns, count(value) OVER w AS value FROM g WINDOW {_RNG}")
def w06c(s, d):
    return R.over_time(gauges(s, d), U, "count", 5 * D1)


@query("w07_double_exp", f"""WITH RECURSIVE {X}, f AS (SELECT metric, idx, value, value AS s, 0.0::DOUBLE AS b FROM x WHERE idx = 0
 UNION ALL SELECT x.metric, x.idx, x.value, CASE WHEN x.idx=1 THEN 0.3*x.value+0.7*x.value ELSE 0.3*x.value+0.7*(f.s+f.b) END, CASE WHEN x.idx=1 THEN 0.1*(x.value-f.s)+0.9*(x.value-f.s) ELSE 0.1*((0.3*x.value+0.7*(f.s+f.b))-f.s)+0.9*f.b END FROM f JOIN x ON x.metric=f.metric AND x.idx=f.idx+1)
SELECT metric, round(arg_max(s, idx),6) AS value FROM f GROUP BY metric""")
def w07(s, d):
    return R.double_exp(series(s, d), ["metric"], 0.3, 0.1).select("metric", r6("value").alias("value"))


@query("w08_gauge_grid", f"WITH {G}, o AS (SELECT *, lead(ts_ns) OVER w AS t1 FROM g {_W}), e AS (SELECT metric, usr, value, unnest(generate_series((ts_ns+{H6 - 1})//{H6}, CASE WHEN t1 IS NULL THEN (ts_ns+{H6 - 1})//{H6} ELSE (t1+{H6 - 1})//{H6}-1 END)) AS gi FROM o) SELECT metric, usr, gi*{H6} AS ts_ns, value FROM e")
def w08(s, d):
    return R.gauge_grid(gauges(s, d), U, H6)


@query("w09_jitter", f"WITH {X}, o AS (SELECT metric, ts_ns, (ts_ns - lag(ts_ns) OVER (PARTITION BY metric ORDER BY ts_ns))/1e6 AS gap_ms FROM x), m AS (SELECT *, avg(gap_ms) OVER (PARTITION BY metric) AS mean FROM o WHERE gap_ms IS NOT NULL) SELECT metric, ts_ns, round(gap_ms,3) AS gap_ms, round(gap_ms - CASE WHEN 600000 <= 2*mean THEN 600000 ELSE mean END,3) AS off_ms FROM m")
def w09(s, d):
    return R.jitter(series(s, d), ["metric"], 600 * B.SECOND).select("metric", "ts_ns", r6("gap_ms", 3).alias("gap_ms"), r6("off_ms", 3).alias("off_ms"))


@query("w10_quantize", f"WITH {G}, q AS (SELECT metric, ts_ns, value, (ts_ns + {B.HOUR // 2}) // {B.HOUR} * {B.HOUR} AS bucket FROM g), o AS (SELECT *, row_number() OVER (PARTITION BY metric, bucket ORDER BY abs(ts_ns-bucket), ts_ns) AS n FROM q) SELECT metric, bucket, ts_ns, value FROM o WHERE n=1")
def w10(s, d):
    return R.quantize(gauges(s, d), ["metric"], B.HOUR).select("metric", "bucket", "ts_ns", "value")


@query("w11_infer_interval", f"""WITH {X}, o AS (SELECT metric, ts_ns, ts_ns - lag(ts_ns) OVER (PARTITION BY metric ORDER BY ts_ns) AS gap FROM x), f AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts_ns) AS i FROM o WHERE gap > 0), k AS (SELECT * FROM f WHERE i <= 100),
 r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY gap, ts_ns) AS r, count(*) OVER (PARTITION BY metric) AS n FROM k), m AS (SELECT metric, max(gap) FILTER (r = n//2 + 1) AS m FROM r GROUP BY metric)
 SELECT k.metric, greatest(m, 1000000) AS interval_ns, count(*) AS gaps, count(*) FILTER (abs(gap-m)*4 <= m) < 0.6*count(*) AS irregular, m < 1000000 AS clamped FROM k JOIN m USING (metric) GROUP BY k.metric, m""")
def w11(s, d):
    return R.infer_interval(series(s, d), ["metric"])


@query("w12_indexed", f"WITH {X} SELECT metric, ts_ns, idx FROM x")
def w12(s, d):
    return R.indexed(gauges(s, d), ["metric"]).select("metric", "ts_ns", "idx")


@query("w21_clock_drift", f"WITH {G} SELECT usr, arg_min(event_id, ts_ns) AS anchor, arg_max(event_id, ts_ns) AS newest, count(*) AS n, arg_max(event_id, ts_ns) - arg_min(event_id, ts_ns) AS drift FROM g GROUP BY usr")
def w21(s, d):
    return R.clock_drift(gauges(s, d).withColumn("wall_offset", F.col("event_id")), ["usr"])


@query("w22_instant", f"WITH {G} SELECT metric, usr, arg_max(value, ts_ns) AS value FROM g WHERE ts_ns <= 1705276800000000000 AND ts_ns > 1705276800000000000 - {5 * D1} GROUP BY ALL")
def w22(s, d):
    return R.instant(gauges(s, d), U, 1705276800000000000, 5 * D1)


@query("j15_interp_at", f"""WITH {C}, {_ADJ}, q AS (SELECT DISTINCT metric, usr, 1705276800000000000 + k*{D1} AS t FROM g, range(5) r(k)),
 b AS (SELECT q.metric, q.usr, q.t, max(a.ts_ns) FILTER (a.ts_ns <= t) AS t0, min(a.ts_ns) FILTER (a.ts_ns >= t) AS t1 FROM q JOIN a USING (metric, usr) GROUP BY ALL)
 SELECT b.metric, b.usr, t AS ts_ns, round(CASE WHEN t0=t1 THEN x.adj ELSE x.adj+(y.adj-x.adj)*((t-t0)/(t1-t0)) END,6) AS value FROM b JOIN a x ON x.metric=b.metric AND x.usr=b.usr AND x.ts_ns=t0 JOIN a y ON y.metric=b.metric AND y.usr=b.usr AND y.ts_ns=t1""")
def j15(s, d):
    a = R.adjusted(counters(s, d), U).select(*U, "ts_ns", F.col("adj").alias("value"))
    grid = a.select(*U).distinct().withColumn("ts_ns", F.explode(F.array(*[F.lit(1705276800000000000 + k * D1) for k in range(5)])))
    return R.interp_at(a, grid, U).select(*U, "ts_ns", r6("value").alias("value"))


# --- aggregation ---------------------------------------------------------------------------------------------------
_DAY = "gd AS (SELECT metric, usr, ts_ns // 86400000000000 * 86400000000000 AS ts_ns, value FROM g)"


def _day(s, d):
    return gauges(s, d).select("metric", "usr", (B.idiv(F.col("ts_ns"), D1) * D1).alias("ts_ns"), "value")


@query("a01_sum_by_band", f"WITH {G}, {_DAY} SELECT metric, ts_ns, round(sum(value),4) AS value, round(sum(value-1),4) AS lo, round(sum(value+1),4) AS hi FROM gd GROUP BY ALL")
def a01(s, d):
    g = _day(s, d).withColumns({"lo": F.col("value") - 1, "hi": F.col("value") + 1})
    return A.agg(g, "sum", by=["metric"]).select("metric", "ts_ns", *[r6(c, 4).alias(c) for c in ("value", "lo", "hi")])


for _n, _sql in (("avg", "avg(value)"), ("max", "max(value)"), ("min", "min(value)"), ("stddev", "stddev_pop(value)"), ("stdvar", "var_pop(value)"), ("quantile", "quantile_cont(value, 0.5)")):

    @query(f"a0{'2' if _n == 'avg' else '3' if _n in ('max', 'min') else '4'}_{_n}_by", f"WITH {G}, {_DAY} SELECT metric, ts_ns, CAST({_sql} AS FLOAT) AS value FROM gd GROUP BY ALL")
    def _agg(s, d, n=_n):
        return A.agg(_day(s, d), n, by=["metric"]).select("metric", "ts_ns", F.col("value").cast("float").alias("value"))


@query("a01_sum_without", f"WITH {G}, {_DAY} SELECT usr, ts_ns, round(sum(value),4) AS value FROM gd GROUP BY ALL")
def a01w(s, d):
    return A.agg(_day(s, d), "sum", without=["metric"]).select("usr", "ts_ns", r6("value", 4).alias("value"))


@query("a04_count_by", f"WITH {G}, {_DAY} SELECT metric, ts_ns, count(value) AS value FROM gd GROUP BY ALL")
def a04c(s, d):
    return A.agg(_day(s, d), "count", by=["metric"])


@query("a04_count_values", f"WITH {G}, {_DAY} SELECT metric, ts_ns, CAST(CAST(floor(value/100) AS BIGINT) AS VARCHAR) AS v, count(*) AS value FROM gd GROUP BY ALL")
def a04v(s, d):
    return A.count_values(_day(s, d).withColumn("value", F.floor(F.col("value") / 100)), "v", ["metric"])


@query("a05_collapse", f"WITH {G} SELECT metric, (ts_ns + 500000000) // 1000000000 * 1000000000 AS ts_ns, round(sum(value),6) AS value FROM g GROUP BY ALL")
def a05(s, d):
    return A.collapse(gauges(s, d), ["metric"]).select("metric", "ts_ns", r6("value").alias("value"))


@query("a06_summary_stats", f"WITH {G} SELECT metric, usr, min(value) AS min, max(value) AS max, round(avg(value),6) AS mean, arg_max(value, ts_ns) AS last, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM g GROUP BY ALL")
def a06(s, d):
    return A.summary_stats(gauges(s, d), U).withColumn("mean", r6("mean"))


@query("a07_percentile_nearest", f"WITH {G}, r AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) AS r, count(*) OVER (PARTITION BY metric) AS n FROM g) SELECT metric, max(value) FILTER (r = greatest(ceil(n*0.5),1)) AS p50, max(value) FILTER (r = greatest(ceil(n*0.9),1)) AS p90 FROM r GROUP BY metric")
def a07(s, d):
    return A.percentile_nearest(gauges(s, d), ["metric"], [0.5, 0.9])


def _catalog(s, d):
    labels = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return table(s, d, "customer").select(F.concat(F.lit("m"), (F.col("c_custkey") % 7).cast("string")).alias("metric"), F.col("c_custkey").alias("series_id"), labels.alias("labels"))


@query("a10_label_values", "SELECT 'segment' AS key, count(DISTINCT c_mktsegment) AS n, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS vals FROM customer UNION ALL SELECT 'nation', count(DISTINCT c_nationkey), string_agg(DISTINCT c_nationkey::VARCHAR, ',' ORDER BY c_nationkey::VARCHAR) FROM customer")
def a10(s, d):
    return A.label_values(_catalog(s, d)).withColumn("vals", F.array_join("vals", ","))


@query("a11_metric_info", "SELECT 'm' || (c_custkey % 7) AS metric, count(*) AS n_series, 'nation,segment' AS label_keys FROM customer GROUP BY ALL")
def a11(s, d):
    return A.metric_info(_catalog(s, d)).withColumn("label_keys", F.array_join("label_keys", ","))


_RANK = "a AS (SELECT n_name AS domain, c_name AS name, avg(o_totalprice) AS avg, max(o_totalprice) AS max FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY ALL), b AS (SELECT *, avg*100/sum(avg) OVER (PARTITION BY domain) AS share, row_number() OVER (PARTITION BY domain ORDER BY avg DESC, name) AS rank FROM a)"


@query("a12_rank_consumers", f"WITH {_RANK} SELECT domain, name, round(avg,8) AS avg, max, round(share,6) AS share, rank FROM b WHERE rank <= 10")
def a12(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    r = A.rank_consumers(o.select(F.col("n_name").alias("domain"), F.col("c_name").alias("name"), F.col("o_totalprice").alias("value")), ["name"], 10)
    return r.select("domain", "name", r6("avg", 8).alias("avg"), "max", r6("share").alias("share"), "rank")


@query("a14_uncertainty", f"WITH {G} SELECT metric, round(avg(usr % 7 + 1.0),6) AS band, round(max(value)-min(value),6) AS movement, round(avg(usr % 7 + 1.0)/(max(value)-min(value)),6) AS ratio, max(value)-min(value) <= avg(usr % 7 + 1.0) AS within_band FROM g GROUP BY metric")
def a14(s, d):
    g = gauges(s, d).withColumns({"lo": F.col("value"), "hi": F.col("value") + F.col("usr") % 7 + 1})
    return A.uncertainty(g, ["metric"]).select("metric", *[r6(c).alias(c) for c in ("band", "movement", "ratio")], "within_band")


# --- sorts, limits, sets -------------------------------------------------------------------------------------------
@query("t01_top_n", "SELECT c_name AS name, c_acctbal AS avg, row_number() OVER (ORDER BY c_acctbal DESC, c_name) AS rank FROM customer QUALIFY rank <= 20")
def t01(s, d):
    return A.top_n(table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("avg")), 20, "avg")


@query("t02_sort_bucket", f"WITH {_RANK} SELECT domain AS metric, name, round(avg,8) AS avg FROM b")
def t02(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.sort_bucket(o.groupBy(F.col("n_name").alias("metric"), F.col("c_name").alias("name")).agg(r6(F.avg("o_totalprice"), 8).alias("avg")))


@query("t05_sort_catalog", "SELECT p_type AS metric, p_name AS name, p_size AS size FROM part")
def t05(s, d):
    return A.sort_catalog(table(s, d, "part").select(F.col("p_type").alias("metric"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), ["metric", "size", "name"], desc=["size"])


for _n, _f, _o in (("t06_topk", A.topk, "DESC"), ("t06_bottomk", A.bottomk, "ASC")):

    @query(_n, f"WITH {G}, {_DAY}, s AS (SELECT metric, usr, ts_ns, round(sum(value),4) AS value FROM gd GROUP BY ALL) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY ts_ns ORDER BY value {_o}, metric, usr) <= 3")
    def _topk(s, d, f=_f):
        return f(A.agg(_day(s, d), "sum", by=U).withColumn("value", r6("value", 4)), 3)


@query("t07_find_metric", "SELECT metric, how FROM (SELECT DISTINCT p_type AS metric, CASE WHEN lower(p_type)='promo' THEN 0 WHEN lower(p_type) LIKE 'promo%' THEN 1 WHEN lower(p_type) LIKE '%promo' THEN 2 WHEN lower(p_type) LIKE '%promo%' THEN 3 WHEN contains('promo', lower(p_type)) THEN 4 END AS how FROM part) WHERE how IS NOT NULL ORDER BY how, metric LIMIT 5")
def t07(s, d):
    return A.find_metric(table(s, d, "part").withColumnRenamed("p_type", "metric"), "promo")


@query("u01_union_tables", f"WITH {G} SELECT metric, count(*) AS n FROM g WHERE metric IN ('click','view') GROUP BY ALL")
def u01(s, d):
    g = gauges(s, d)
    return A.union_tables(g.where("metric='click'"), g.where("metric='view'").drop("event_id")).groupBy("metric").agg(F.count("*").alias("n"))


@query("u02_union_recordings", f"WITH {G} SELECT CASE WHEN usr%2=0 THEN 'even' ELSE 'odd' END AS recording, metric, count(*) AS n FROM g GROUP BY ALL")
def u02(s, d):
    g = gauges(s, d)
    return A.union_recordings(even=g.where("usr%2=0"), odd=g.where("usr%2=1")).groupBy("recording", "metric").agg(F.count("*").alias("n"))


@query("u03_common_buckets", f"WITH {G} SELECT DISTINCT ts_ns // {B.HOUR} AS bucket FROM g WHERE metric='click' INTERSECT SELECT ts_ns // {B.HOUR} FROM g WHERE metric='view'")
def u03(s, d):
    g = gauges(s, d).withColumn("bucket", B.idiv(F.col("ts_ns"), B.HOUR))
    return A.common_buckets(g.where("metric='click'"), g.where("metric='view'"))


@query("u04_absent_from", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u04(s, d):
    return A.absent_from(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("u05_merge_fields", "WITH i AS (SELECT c_custkey AS pos, c_mktsegment AS source, (c_nationkey % 3)::VARCHAR AS id, c_name AS name, 't' || c_custkey AS phone, c_nationkey AS n FROM customer), d AS (SELECT source, arg_min(n, pos) AS n, arg_min(phone, pos) AS phone FROM i GROUP BY source) SELECT source, id, 'version' AS field, '\"' || arg_min(name, pos) || '\"' AS value FROM i GROUP BY ALL UNION ALL SELECT DISTINCT source, id, 'instance', '\"' || id || '\"' FROM i UNION ALL SELECT source, 'descriptions', 'm' || n, '\"' || phone || '\"' FROM d")
def u05_fields(s, d):
    """Each customer as the metadata of an input: of equal segments and instances the first one's fields, of a segment the first descriptions."""
    from metrifold.operators.metadata import merge_fields

    none = lambda c: F.lit(None).cast("string").alias(c)
    inputs = table(s, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("source"), none("node"), (F.col("c_nationkey") % 3).cast("string").alias("instance"), F.col("c_name").alias("version"), none("systeminfo"), F.to_json(F.create_map(F.concat(F.lit("m"), F.col("c_nationkey")), F.concat(F.lit("t"), F.col("c_custkey")))).alias("descriptions"), none("per_source"))
    return merge_fields(inputs).where("field <> ''")


@query("u05_merge_metadata", "SELECT p_brand AS source, count(DISTINCT p_type) AS n, min(m) AS least FROM (SELECT p_brand, p_type, max(p_name) AS m FROM part GROUP BY ALL) GROUP BY ALL")
def u05(s, d):
    p = table(s, d, "part").select(F.col("p_brand").alias("source"), F.col("p_type").alias("metric"), F.col("p_name").alias("description"))
    return A.merge_metadata(p.where("p_size < 25") if "p_size" in p.columns else p, p).select("source", F.size("descriptions").cast("long").alias("n"), F.array_min(F.map_values("descriptions")).alias("least"))


@query("u06_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def u06(s, d):
    return A.distinct(table(s, d, "lineitem").select("l_returnflag", "l_linestatus"))


# --- scalar functions ----------------------------------------------------------------------------------------------
@query("f01_math_f02_clamp", "SELECT c_custkey, round(abs(c_acctbal),6) AS abs, ceil(c_acctbal)::BIGINT AS ceil, floor(c_acctbal)::BIGINT AS floor, round(sqrt(abs(c_acctbal)),6) AS sqrt, round(ln(abs(c_acctbal)+1),6) AS ln, round(log2(abs(c_acctbal)+1),6) AS log2, round(log10(abs(c_acctbal)+1),6) AS log10, sign(c_acctbal)::DOUBLE AS sgn, greatest(least(c_acctbal, 5000), 100)::DOUBLE AS clamped, greatest(c_acctbal,0)::DOUBLE AS cmin, least(c_acctbal,10)::DOUBLE AS cmax FROM customer")
def f01(s, d):
    b, m = F.col("c_acctbal"), S.MATH
    return table(s, d, "customer").select("c_custkey", r6(m["abs"](b)).alias("abs"), m["ceil"](b).alias("ceil"), m["floor"](b).alias("floor"), *[r6(m[n](F.abs(b) + (0 if n == "sqrt" else 1))).alias(n) for n in ("sqrt", "ln", "log2", "log10")], m["sgn"](b).alias("sgn"), S.clamp(b, 100.0, 5000.0).alias("clamped"), S.clamp_min(b, 0.0).alias("cmin"), S.clamp_max(b, 10.0).alias("cmax"))


@query("f03_offset_timestamp", f"WITH {G} SELECT metric, usr, ts_ns + {D1} AS ts_ns, round((ts_ns + {D1})/1e9,3) AS value FROM g")
def f03(s, d):
    return S.time_of(S.offset(gauges(s, d), D1)).select(*U, "ts_ns", r6("value", 3).alias("value"))


@query("f04_absent_scalar", f"WITH {G}, a AS (SELECT DISTINCT ts_ns // {B.HOUR} * {B.HOUR} AS ts_ns FROM g), b AS (SELECT ts_ns // {B.HOUR} * {B.HOUR} AS ts_ns, value FROM g WHERE metric='signup') SELECT 'absent' AS what, ts_ns, 1.0::DOUBLE AS value FROM a WHERE ts_ns NOT IN (SELECT ts_ns FROM b) UNION ALL SELECT 'scalar', ts_ns, CASE WHEN count(*)=1 THEN max(value) END FROM b GROUP BY ts_ns UNION ALL SELECT 'vector', ts_ns, 2.5 FROM a")
def f04(s, d):
    hour = (B.idiv(F.col("ts_ns"), B.HOUR) * B.HOUR).alias("ts_ns")
    grid, one = gauges(s, d).select(hour).distinct(), gauges(s, d).where("metric='signup'").select(hour, "value")
    tag = lambda n, x: x.select(F.lit(n).alias("what"), "ts_ns", "value")
    return tag("absent", S.absent(one, grid)).unionByName(tag("scalar", S.scalar(one))).unionByName(tag("vector", S.vector(grid, 2.5)))


@query("f05_label_replace_join", "SELECT c_custkey, CASE WHEN regexp_full_match(c_mktsegment, 'B(.*)') THEN regexp_replace(c_mktsegment, '^B(.*)$', 'b-\\1') ELSE '' END AS dst, c_mktsegment || '/' || c_name AS joined FROM customer")
def f05(s, d):
    return S.label_join(S.label_replace(table(s, d, "customer"), "dst", "b-$1", "c_mktsegment", "B(.*)"), "joined", "/", "c_mktsegment", "c_name").select("c_custkey", "dst", "joined")


@query("f06_merge_labels", "SELECT c_custkey, 'a=' || c_mktsegment || ',b=' || c_nationkey || ',c=' || c_name AS labels FROM customer")
def f06(s, d):
    a = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.col("c_nationkey").cast("string"))
    b = F.create_map(F.lit("a"), F.col("c_mktsegment"), F.lit("c"), F.col("c_name"))
    return table(s, d, "customer").select("c_custkey", S.labels_text(S.merge_labels(a, b)).alias("labels"))


@query("f07_f08_series_keys", "SELECT p_partkey, 'p' || p_size AS quantile, 'p' || p_size || '·brand=' || p_brand AS key FROM part")
def f07(s, d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("p"), F.col("p_size").cast("string")))
    raw = F.when(F.col("p_size") == 1, F.lit("p1.0")).otherwise(raw)
    labels = F.create_map(F.lit("quantile"), F.when(F.col("p_size") == 1, F.lit("0.01")).otherwise(raw), F.lit("brand"), F.col("p_brand"), F.lit("capture"), F.lit("x"))
    return table(s, d, "part").select("p_partkey", S.quantile_label(labels["quantile"]).alias("quantile"), S.series_key(labels, ["capture"]).alias("key"))


@query("f09_to_ts_ns", f"WITH {G} SELECT event_id, ts_ns // 1000000 * 1000000 AS a, ts_ns AS b, ts_ns // 60000000000 * 60000000000 AS c FROM g")
def f09(s, d):
    t = F.timestamp_micros(B.idiv(F.col("ts_ns"), 1000))
    return gauges(s, d).select("event_id", S.to_ts_ns(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("a"), S.to_ts_ns(F.col("ts_ns").cast("string")).alias("b"), S.to_ts_ns(F.date_format(t, "yyyy-MM-dd HH:mm")).alias("c"))


@query("f10_to_duration_ns", "SELECT p_partkey, p_size * 60000000000 + 30000000000 AS a, p_size::BIGINT AS b FROM part")
def f10(s, d):
    n = F.col("p_size").cast("string")
    return table(s, d, "part").select("p_partkey", S.to_duration_ns(F.concat(n, F.lit("m30s"))).alias("a"), S.to_duration_ns(n).alias("b"))


@query("f11_corr_label", "SELECT p_partkey, CASE WHEN r >= 0.9 THEN 'very strong positive' WHEN r >= 0.7 THEN 'strong positive' WHEN r >= 0.5 THEN 'moderate positive' WHEN r >= 0.3 THEN 'weak positive' ELSE 'negligible' END AS label FROM (SELECT p_partkey, p_size/50.0 AS r FROM part)")
def f11(s, d):
    return table(s, d, "part").select("p_partkey", S.corr_label(F.col("p_size") / 50.0).alias("label"))


@query("f13_parse_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f13(s, d):
    return table(s, d, "events").select("event_id", S.parse_json(F.col("props"), "k long")["k"].alias("k"))


__all__ = ["QUERIES", "SQL"]
