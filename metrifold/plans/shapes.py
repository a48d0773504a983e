"""Queries: histograms, joins, combining, comparing and thinning."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrifold.operators import aggregate as A
from metrifold.operators import base as B
from metrifold.operators import combine as K
from metrifold.operators import compare as M
from metrifold.operators import histogram as H
from metrifold.operators import joins as J
from metrifold.plans.registry import G, P, X, end_sql, gauges, increments, index_sql, prices, query, r6, series, start_sql, table
from metrifold.plans.registry import H as HS

FLAG = ["flag"]
D1, HR = B.DAY, B.HOUR

# --- histograms ----------------------------------------------------------------------------------------------------


@query("h05_bucket_index_bounds", f"WITH {P}, b AS (SELECT DISTINCT value, {index_sql('value', 3)} AS bucket FROM p) SELECT value, bucket, {start_sql('bucket', 3)} AS lo, {end_sql('bucket', 3)} AS hi FROM b")
def h05(s, d):
    lo, hi = H.bucket_bounds(F.col("bucket"), 3)
    return prices(s, d).select("value", H.bucket_index(F.col("value"), 3).alias("bucket")).distinct().select("value", "bucket", lo.alias("lo"), hi.alias("hi"))


@query("h01_delta", f"WITH {HS}, c AS (SELECT flag, ts_ns, sum(count) FILTER (bucket < 100) AS a, sum(count) FILTER (bucket >= 100) AS b FROM h GROUP BY ALL), e AS (SELECT flag, ts_ns, coalesce(a,0)-coalesce(lag(a) OVER w,0) AS x, coalesce(b,0)-coalesce(lag(b) OVER w,0) AS y, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY flag ORDER BY ts_ns)) SELECT flag, ts_ns, x::BIGINT AS a, y::BIGINT AS b FROM e WHERE n > 1 AND x >= 0 AND y >= 0")
def h01(s, d):
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).cast("long")
    dense = increments(s, d).groupBy("flag", "ts_ns").agg(F.array(n(F.col("bucket") < 100), n(F.col("bucket") >= 100)).alias("buckets"))
    return H.delta(dense, FLAG).select("flag", "ts_ns", F.col("buckets")[0].alias("a"), F.col("buckets")[1].alias("b"))


@query("h02_merge", f"WITH {HS} SELECT ts_ns, bucket, CAST(sum(count) AS BIGINT) AS count FROM h GROUP BY ALL")
def h02(s, d):
    return H.merge(increments(s, d), [])


_Q = "r AS (SELECT flag, ts_ns, bucket, sum(count) OVER (PARTITION BY flag, ts_ns ORDER BY bucket) AS cum, sum(count) OVER (PARTITION BY flag, ts_ns) AS total FROM h)"


def _qsql(qs: str) -> str:
    return f"WITH {HS}, {_Q}, m AS (SELECT flag, ts_ns, q AS quantile, min(bucket) AS bucket FROM r, (SELECT unnest([{qs}])::DOUBLE AS q) WHERE cum >= greatest(ceil(q*total),1) GROUP BY ALL)"


@query("h03_quantile", f"{_qsql('0.5')} SELECT flag, ts_ns, {end_sql('bucket', 3)}::DOUBLE AS value, {start_sql('bucket', 3)}::DOUBLE AS lo, {end_sql('bucket', 3)}::DOUBLE AS hi FROM m")
def h03(s, d):
    return H.quantile(increments(s, d), FLAG, 3, 0.5)


@query("h04_quantiles", f"{_qsql('0.5,0.9,0.99,0.999,0.9999')} SELECT flag, ts_ns, quantile, {end_sql('bucket', 3)}::DOUBLE AS value FROM m")
def h04(s, d):
    return H.quantiles(increments(s, d), FLAG, 3).select("flag", "ts_ns", "quantile", "value")


_YEAR = 365 * D1


@query("h04_quantiles_stride", f"WITH {HS.replace(', h AS', ', h0 AS')}, h AS (SELECT flag, ts_ns // {_YEAR} * {_YEAR} AS ts_ns, bucket, sum(count) AS count FROM h0 GROUP BY ALL), {_Q} SELECT flag, ts_ns, 0.9::DOUBLE AS quantile, {end_sql('min(bucket)', 3)}::DOUBLE AS value FROM r WHERE cum >= greatest(ceil(0.9*total),1) GROUP BY flag, ts_ns")
def h04s(s, d):
    return H.quantiles(increments(s, d), FLAG, 3, (0.9,), stride=_YEAR).select("flag", "ts_ns", "quantile", "value")


_MID = f"({start_sql('bucket', 3)} + {end_sql('bucket', 3)})/2.0"


@query("h06_count_sum_mean", f"WITH {HS} SELECT flag, ts_ns, sum(count)::BIGINT AS count, sum(count*{_MID})::DOUBLE AS sum, sum(count*{start_sql('bucket', 3)})::DOUBLE AS lo, sum(count*{end_sql('bucket', 3)})::DOUBLE AS hi, round(sum(count*{_MID})/sum(count),6) AS mean FROM h GROUP BY ALL")
def h06(s, d):
    return H.count_sum_mean(increments(s, d), FLAG, 3).withColumn("mean", r6("mean"))


@query("h07_observation_rate", f"WITH {HS}, c AS (SELECT flag, ts_ns, sum(sum(count)) OVER w AS n, lag(ts_ns) OVER w AS pt, sum(count) AS k FROM h GROUP BY flag, ts_ns WINDOW w AS (PARTITION BY flag ORDER BY ts_ns)) SELECT flag, ts_ns, round(k*1e9/(ts_ns-pt)*86400,6) AS value FROM c WHERE pt IS NOT NULL")
def h07(s, d):
    totals = increments(s, d).groupBy("flag", "ts_ns").agg(F.sum("count").alias("count")).withColumn("bucket", F.lit(0))
    return H.observation_rate(H.cumulative(totals, FLAG), FLAG).select("flag", "ts_ns", r6(F.col("value") * 86400).alias("value"))


@query("h08_heatmap", f"WITH {HS} SELECT ts_ns // {_YEAR} * {_YEAR} AS ts_ns, bucket, sum(count)::BIGINT AS count FROM h GROUP BY ALL")
def h08(s, d):
    return H.heatmap(increments(s, d), stride=_YEAR)


@query("h09_heatmap_max", f"WITH {HS}, z AS (SELECT min(ts_ns) AS t0, max(ts_ns) AS t1, min(bucket) AS b0, max(bucket) AS b1 FROM h) SELECT least(floor((ts_ns-t0)*10/(t1-t0+1)),9)::BIGINT AS col, bucket, max(count) AS count, any_value(b0)-1 AS from_bucket, any_value(b1)+1 AS to_bucket FROM h, z GROUP BY ALL")
def h09(s, d):
    return H.heatmap_max(increments(s, d), 10)


def _spectrum(s, d, flag):
    return H.spectrum(increments(s, d).where(F.col("flag") == flag).withColumn("ts_ns", F.lit(0).cast("long")), FLAG, 3).drop("ts_ns")


_SPEC = f"h1 AS (SELECT flag, bucket, sum(count) AS count FROM h GROUP BY ALL), r1 AS (SELECT flag, bucket, sum(count) OVER (PARTITION BY flag ORDER BY bucket) AS cum, sum(count) OVER (PARTITION BY flag) AS total FROM h1), s1 AS (SELECT flag, i/100.0 AS quantile, {end_sql('min(bucket)', 3)}::DOUBLE AS value FROM r1, range(1,101) t(i) WHERE cum >= greatest(ceil((i/100.0)::DOUBLE*total),1) GROUP BY flag, i)"


@query("h10_spectrum", f"WITH {HS}, {_SPEC} SELECT flag, quantile::DOUBLE AS quantile, value FROM s1 WHERE flag='R'")
def h10(s, d):
    return _spectrum(s, d, "R").select("flag", "quantile", "value")


@query("h11_spectrum_diff", f"WITH {HS}, {_SPEC} SELECT a.quantile::DOUBLE AS quantile, a.value AS baseline, b.value AS experiment, b.value-a.value AS delta FROM s1 a JOIN s1 b ON a.quantile=b.quantile AND a.flag='R' AND b.flag='N'")
def h11(s, d):
    return M.spectrum_diff(_spectrum(s, d, "R"), _spectrum(s, d, "N"), []).select("quantile", "baseline", "experiment", "delta")


@query("h12_downsample", f"WITH {HS}, t AS (SELECT flag, ts_ns, {start_sql('bucket', 3)} AS v, count FROM h) SELECT flag, ts_ns, {index_sql('v', 1)} AS bucket, sum(count)::BIGINT AS count FROM t GROUP BY ALL")
def h12(s, d):
    return H.downsample(increments(s, d), FLAG, 3, 1)


@query("h13_summaries", f"{_qsql('0.5,0.9,0.99')} SELECT flag, ts_ns, 'p' || replace((quantile*100)::VARCHAR, '.0', '') AS percentile, {end_sql('bucket', 3)}::DOUBLE AS value FROM m")
def h13(s, d):
    return H.summaries(increments(s, d), FLAG, 3)


@query("h14_rate_mean", f"WITH {HS}, c AS (SELECT flag, ts_ns, sum(count)::BIGINT AS count, sum(count*{_MID})/sum(count) AS mean, lag(ts_ns) OVER (PARTITION BY flag ORDER BY ts_ns) AS pt FROM h GROUP BY flag, ts_ns) SELECT flag, ts_ns, count, round(mean,6) AS mean, round(count*1e9/(ts_ns-pt)*86400,6) AS rate FROM c WHERE pt IS NOT NULL")
def h14(s, d):
    return H.rate_mean(increments(s, d), FLAG, 3).select("flag", "ts_ns", "count", r6("mean").alias("mean"), r6(F.col("rate") * 86400).alias("rate"))


@query("s06_le_to_histogram", f"WITH q AS (SELECT p_brand AS metric, least(p_size,40)::DOUBLE AS le, count(*) AS n FROM part GROUP BY ALL), v AS (SELECT metric, le::BIGINT AS value, n FROM q) SELECT metric, {index_sql('value', 7)} AS bucket, sum(n)::BIGINT AS count FROM v GROUP BY ALL")
def s06(s, d):
    q = table(s, d, "part").groupBy(F.col("p_brand").alias("metric"), F.least("p_size", F.lit(40)).cast("double").alias("le")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    cum = q.withColumns({"cum": F.sum("n").over(Window.partitionBy("metric").orderBy("le")), "ts_ns": F.lit(0).cast("long")})
    return H.from_le(cum, ["metric"]).select("metric", "bucket", "count")


@query(
    "s06_le_fractions",
    f"WITH q AS (SELECT p_brand AS metric, (p_size - 4) / 80.0::DOUBLE AS le, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT metric, CASE WHEN min(le) FILTER (le > 0) >= 1 THEN 1.0::DOUBLE WHEN min(le) FILTER (le > 0) * 10 >= 1 THEN 10 ELSE 100 END AS up FROM q GROUP BY metric), v AS (SELECT q.metric, greatest(floor(le * up), 0)::BIGINT AS value, n FROM q JOIN m ON m.metric = q.metric), t AS (SELECT metric, max(value) AS top FROM v GROUP BY metric) SELECT v.metric, {index_sql('value', 7)} AS bucket, sum(n)::BIGINT AS count, any_value(greatest(8, least(64, CASE WHEN top < 2 THEN 1 ELSE length(bin(top - 1)) + 1 END)))::INT AS mvp FROM v JOIN t ON t.metric = v.metric GROUP BY v.metric, bucket",
)
def s06_fractions(s, d):
    """Bounds below and at 0, and fractions; one largest power for each histogram."""
    from pyspark.sql import Window

    q = table(s, d, "part").groupBy(F.col("p_brand").alias("metric"), ((F.col("p_size") - 4) / F.lit(80.0)).alias("le")).agg(F.count("*").alias("n"))
    cum = q.withColumns({"cum": F.sum("n").over(Window.partitionBy("metric").orderBy("le")), "ts_ns": F.lit(0).cast("long")})
    return H.from_le(cum, ["metric"]).select("metric", "bucket", "count", F.col("mvp").cast("int").alias("mvp"))


# --- joins ---------------------------------------------------------------------------------------------------------
_DAYS = f"dy AS (SELECT metric, usr, ts_ns // {D1} * {D1} AS ts_ns, sum(value) AS value FROM g GROUP BY ALL)"


def _daily(s, d):
    return gauges(s, d).groupBy("metric", "usr", (B.idiv(F.col("ts_ns"), D1) * D1).alias("ts_ns")).agg(F.sum("value").alias("value"))


@query("j01_binop_one_to_one", f"WITH {G}, {_DAYS} SELECT a.usr, a.ts_ns, round(a.value/b.value,6) AS value FROM dy a JOIN dy b ON a.usr=b.usr AND a.ts_ns=b.ts_ns AND a.metric='click' AND b.metric='view'")
def j01(s, d):
    g = _daily(s, d)
    return J.binop(g.where("metric='click'").drop("metric"), g.where("metric='view'").drop("metric"), "/").select("usr", "ts_ns", r6("value").alias("value"))


@query("j02_binop_single", f"WITH {G}, {_DAYS}, t AS (SELECT ts_ns, sum(value) AS t FROM dy GROUP BY ts_ns) SELECT metric, usr, ts_ns, round(value/t,8) AS value FROM dy JOIN t USING (ts_ns)")
def j02(s, d):
    g = _daily(s, d)
    return J.binop(g, A.agg(g, "sum"), "/", on=[]).select("metric", "usr", "ts_ns", r6("value", 8).alias("value"))


@query("j03_binop_many_to_one", f"WITH {G}, {_DAYS}, t AS (SELECT metric, ts_ns, max(value) AS t FROM dy GROUP BY ALL) SELECT metric, usr, ts_ns, round(value/t,8) AS value FROM dy JOIN t USING (metric, ts_ns)")
def j03(s, d):
    g = _daily(s, d)
    return J.binop(g, A.agg(g, "max", by=["metric"]), "/", on=["metric"], many="left").select("metric", "usr", "ts_ns", r6("value", 8).alias("value"))


@query("j03_duplicate_matches", f"WITH {G}, {_DAYS} SELECT metric, ts_ns, count(*) AS n FROM dy GROUP BY ALL HAVING count(*) > 1")
def j03d(s, d):
    return J.duplicate_matches(_daily(s, d), ["metric"])


@query("j04_band_arithmetic", f"""WITH {G}, {_DAYS}, z AS (SELECT a.usr, a.ts_ns, a.value AS x, a.value-5 AS xl, a.value+5 AS xh, b.value AS y, b.value-20 AS yl, b.value+20 AS yh FROM dy a JOIN dy b ON a.usr=b.usr AND a.ts_ns=b.ts_ns AND a.metric='click' AND b.metric='view')
SELECT usr, ts_ns, round(x/y,5) AS value, CASE WHEN NOT (yl<=0 AND yh>=0) THEN round(least(xl/yl,xl/yh,xh/yl,xh/yh),5) END AS lo, CASE WHEN NOT (yl<=0 AND yh>=0) THEN round(greatest(xl/yl,xl/yh,xh/yl,xh/yh),5) END AS hi FROM z""")
def j04(s, d):
    g = _daily(s, d)
    side = lambda m, w: g.where(F.col("metric") == m).drop("metric").withColumns({"lo": F.col("value") - w, "hi": F.col("value") + w})
    return J.binop(side("click", 5), side("view", 20), "/").select("usr", "ts_ns", *[r6(c, 5).alias(c) for c in ("value", "lo", "hi")])


@query("j20_binop_on_grid", f"WITH {X}, o AS (SELECT *, lead(ts_ns) OVER (PARTITION BY metric ORDER BY ts_ns) AS t1 FROM x), e AS (SELECT metric, value, unnest(generate_series((ts_ns+{HR - 1})//{HR}, CASE WHEN t1 IS NULL THEN (ts_ns+{HR - 1})//{HR} ELSE (t1+{HR - 1})//{HR}-1 END)) AS gi FROM o) SELECT a.gi*{HR} AS ts_ns, round(a.value-b.value,6) AS value FROM e a JOIN e b ON a.gi=b.gi AND a.metric='click' AND b.metric='view'")
def j20(s, d):
    x = series(s, d).drop("idx")
    return J.binop(x.where("metric='click'").drop("metric"), x.where("metric='view'").drop("metric"), "-", align=HR).select("ts_ns", r6("value").alias("value"))


@query("j11_annotate_samples", f"WITH {G}, a AS (SELECT event_id AS id, usr AS node, ts_ns AS a0, ts_ns + {HR} AS a1, metric FROM g WHERE metric='error' AND value > 100) SELECT g.event_id, a.id, g.value FROM g JOIN a ON g.ts_ns BETWEEN a0 AND a1 AND (a.node % 2 = 0 OR a.node = g.usr)")
def j11(s, d):
    g = gauges(s, d)
    null = F.lit(None).cast("string")
    ann = g.where("metric='error' and value > 100").select("ts_ns", F.lit(HR).alias("duration_ns"), F.col("event_id").alias("id"), F.col("metric").alias("description"), null.alias("source"), F.when(F.col("usr") % 2 == 1, F.col("usr")).alias("node"), null.alias("instance"))
    return J.annotate_samples(g.withColumn("node", F.col("usr")), ann, 6 * HR).select("event_id", "id", "value")


@query("j12_attribute", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'sampled' WHEN p_size % 2 = 0 AND p_type='PROMO' THEN 'exact' WHEN p_size % 2 = 0 AND p_type IN ('LARGE','SMALL') THEN 'prefix' END AS subsystem FROM part")
def j12(s, d):
    p = table(s, d, "part").select("p_partkey", F.lower("p_type").alias("t"), "p_size")
    cat = p.select("p_partkey", F.concat("t", F.lit("_a_b")).alias("metric"), F.when(F.col("p_size") % 2 == 0, "agent").otherwise("other").alias("source"), F.when(F.col("p_size") == 1, "sampled").alias("sampler"))
    exact = cat.where("metric = 'promo_a_b'").select("metric", F.lit("exact").alias("subsystem")).distinct()
    heads = cat.where("metric in ('large_a_b','small_a_b')").select(F.split("metric", "_")[0].alias("prefix"), F.lit("prefix").alias("subsystem")).distinct()
    return J.attribute(cat, exact, heads).select("p_partkey", "subsystem")


@query("j13_coverage", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AND c_mktsegment <> 'BUILDING' AND c_nationkey <> 3")
def j13(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("metric"), F.col("c_mktsegment").alias("domain"), F.col("c_nationkey").alias("sampler"))
    present = table(s, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("metric"))
    return J.coverage(c, present, c.where("domain = 'BUILDING'"), c.where("sampler = 3")).select(F.col("metric").alias("c_custkey"))


@query("j14_describe_metrics", "SELECT p_partkey, coalesce(CASE WHEN p_size < 20 THEN p_brand END, p_name) AS description FROM part")
def j14(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("metric"), F.col("p_type").alias("source"), "p_brand", "p_name", "p_size")
    out = J.describe_metrics(p.select("metric", "source"), p.where("p_size < 20").select("source", "metric", F.col("p_brand").alias("description")), p.select("metric", F.col("p_name").alias("description")))
    return out.select(F.col("metric").alias("p_partkey"), "description")


@query("j18_pair_kpis", "SELECT p_brand AS title, bool_and(k > 0) AS ok, coalesce(string_agg(CASE WHEN k = 0 THEN m END, ',' ORDER BY m), '') AS missing FROM (SELECT b.p_brand, m.m, count(p.p_partkey) AS k FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (VALUES ('PROMO'),('LARGE')) m(m) LEFT JOIN part p ON p.p_brand=b.p_brand AND p.p_type=m.m AND p.p_size > 45 GROUP BY ALL) GROUP BY ALL")
def j18(s, d):
    p = table(s, d, "part").where("p_type in ('PROMO','LARGE')")
    one = F.lit("types").alias("category")
    members = p.select(one, F.col("p_type").alias("member")).distinct()
    titles = p.select(one, F.col("p_brand").alias("title"), F.col("p_type").alias("member"), F.col("p_brand").alias("own_title")).distinct()
    base = table(s, d, "part").select(one, F.col("p_brand").alias("title")).distinct().withColumn("member", F.lit("none")).withColumn("own_title", F.lit(None).cast("string"))
    out = J.pair_kpis(members, titles.unionByName(base), p.where("p_size > 45").select(F.col("p_type").alias("member"), F.col("p_brand").alias("title")))
    return out.select("title", "ok", F.array_join("missing", ",").alias("missing"))


@query("j19_common_labels", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def j19(s, d):
    return J.common_labels(table(s, d, "customer").select(F.col("c_nationkey").alias("nation")), table(s, d, "supplier").select(F.col("s_nationkey").alias("nation")), ["nation"])


@query("w20_normalize_annotations", "SELECT id, ts_ns FROM (SELECT CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey::VARCHAR END AS id, epoch_us(o_orderdate)*1000 AS ts_ns, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, lpad(o_orderkey::VARCHAR, 12, '0')) AS n FROM orders) WHERE id IS NULL OR n = 1")
def w20(s, d):
    o = table(s, d, "orders").select(F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey").cast("string")).alias("id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ts_ns"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("description"))
    return J.normalize_annotations(o).select("id", "ts_ns")


# --- combining and comparing ---------------------------------------------------------------------------------------
_REC = f"rc AS (SELECT metric AS recording, 'm' AS metric, ts_ns, value FROM g WHERE metric IN ('click','view','error')), qz AS (SELECT *, (ts_ns + {HR // 2}) // {HR} * {HR} AS bucket FROM rc), q1 AS (SELECT * FROM qz QUALIFY row_number() OVER (PARTITION BY recording, bucket ORDER BY abs(ts_ns-bucket), ts_ns) = 1)"


def _recordings(s, d):
    return gauges(s, d).where("metric in ('click','view','error')").select(F.col("metric").alias("recording"), F.lit("m").alias("metric"), "ts_ns", "value")


@query("j05_combine", f"WITH {G}, {_REC} SELECT recording, bucket AS ts_ns, value FROM q1 WHERE bucket IN (SELECT bucket FROM q1 GROUP BY bucket HAVING count(DISTINCT recording) = 3)")
def j05(s, d):
    return K.combine(_recordings(s, d), HR).select("recording", "ts_ns", "value")


@query("j06_validate_combine", f"""WITH {G}, {_REC}, gp AS (SELECT recording, ts_ns, ts_ns - lag(ts_ns) OVER (PARTITION BY recording ORDER BY ts_ns) AS gap FROM rc), pr AS (SELECT recording, quantile_disc(gap, 0.5) AS gap, min(ts_ns) AS t0, max(ts_ns) AS t1 FROM gp GROUP BY recording), w AS (SELECT (max(gap)-min(gap))*10 <= min(gap) AS same_interval, max(t0) <= min(t1) AS overlap, count(*) AS n FROM pr),
 b AS (SELECT bucket, count(DISTINCT recording) AS k, max(ts_ns)-min(ts_ns) AS spread FROM qz GROUP BY bucket), c AS (SELECT count(*) AS common, count(*) FILTER (spread*10 <= {HR}) AS near FROM b, w WHERE k = n) SELECT n, same_interval, overlap, common, near, near >= 0.95*common AS aligned FROM w, c""")
def j06(s, d):
    return K.validate_combine(_recordings(s, d), HR)


@query("j06_duplicate_nodes", "SELECT c_nationkey AS node, c_mktsegment AS instance, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def j06d(s, d):
    return K.duplicate_nodes(table(s, d, "customer").select(F.col("c_custkey").alias("recording"), F.col("c_nationkey").alias("node"), F.col("c_mktsegment").alias("instance")))


_ARM = f"ar AS (SELECT usr % 2 AS arm, metric, (ts_ns - min(ts_ns) OVER (PARTITION BY usr % 2)) // {D1} AS step, value FROM g), av AS (SELECT arm, metric, step, avg(value) AS v FROM ar GROUP BY ALL)"


@query("j07_compare", f"WITH {G}, {_ARM} SELECT coalesce(a.metric,b.metric) AS metric, coalesce(a.step,b.step) AS step, round(a.v,7) AS baseline, round(b.v,7) AS experiment, round(b.v-a.v,7) AS delta FROM (SELECT * FROM av WHERE arm=0) a FULL JOIN (SELECT * FROM av WHERE arm=1) b ON a.metric=b.metric AND a.step=b.step WHERE coalesce(a.step,b.step) <= (SELECT min(m) FROM (SELECT max(step) AS m FROM av GROUP BY arm))")
def j07(s, d):
    g = gauges(s, d)
    out = M.compare(g.where("usr % 2 = 0"), g.where("usr % 2 = 1"), ["metric"], D1)
    return out.select("metric", "step", *[r6(c, 7).alias(c) for c in ("baseline", "experiment", "delta")])


@query("j08_divergence", f"WITH {G}, {_DAYS}, s AS (SELECT metric, usr % 2 AS arm, ts_ns, round(sum(value),6) AS v FROM dy GROUP BY ALL) SELECT coalesce(a.metric,b.metric) AS metric, coalesce(a.ts_ns,b.ts_ns) AS ts_ns, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN least(a.v,b.v) END AS lower, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN greatest(a.v,b.v) END AS upper FROM (SELECT * FROM s WHERE arm=0) a FULL JOIN (SELECT * FROM s WHERE arm=1) b ON a.metric=b.metric AND a.ts_ns=b.ts_ns")
def j08(s, d):
    g = _daily(s, d).groupBy("metric", (F.col("usr") % 2).alias("arm"), "ts_ns").agg(r6(F.sum("value")).alias("value"))
    return M.divergence(g.where("arm = 0"), g.where("arm = 1"), ["metric"])


_BIN = "bz AS (SELECT metric, ts_ns, value, least(floor((ts_ns - min(ts_ns) OVER (PARTITION BY metric))*48.0::DOUBLE/(max(ts_ns) OVER (PARTITION BY metric) - min(ts_ns) OVER (PARTITION BY metric) + 1)), 47)::BIGINT AS bin FROM g)"


@query("a22_boxplot", f"WITH {G}, {_BIN} SELECT metric, bin, min(ts_ns) AS ts_ns, min(value) AS min, round(quantile_cont(value,0.25),6) AS lo, round(median(value),6) AS median, round(quantile_cont(value,0.75),6) AS hi, max(value) AS max FROM bz GROUP BY metric, bin")
def a22(s, d):
    b = M.boxplot(gauges(s, d), ["metric"], 48)
    return b.select("metric", "bin", "ts_ns", "min", r6("lo").alias("lo"), r6("median").alias("median"), r6("hi").alias("hi"), "max")


@query("a24_minmax_decimate", f"WITH {G}, {_BIN}, e AS (SELECT metric, bin, ts_ns, value, row_number() OVER (PARTITION BY metric, bin ORDER BY value, ts_ns) AS a, row_number() OVER (PARTITION BY metric, bin ORDER BY value DESC, ts_ns) AS b FROM bz) SELECT DISTINCT metric, ts_ns, value FROM e WHERE a = 1 OR b = 1")
def a24(s, d):
    return M.minmax_decimate(gauges(s, d), ["metric"], 48)


@query("a25_heatmap_coarsen", f"WITH {G}, {_DAYS} SELECT usr AS y, ts_ns // {D1} // 7 AS t, min(value) AS min, max(value) AS max FROM dy WHERE metric='click' GROUP BY ALL")
def a25(s, d):
    g = _daily(s, d).where("metric='click'").select(F.col("usr").alias("y"), B.idiv(F.col("ts_ns"), D1).alias("t"), "value")
    return M.heatmap_coarsen(g, 7)


@query("a26_heatmap_triples", f"WITH {G} SELECT dense_rank() OVER (ORDER BY ts_ns) - 1 AS time_idx, usr AS id, value FROM g")
def a26(s, d):
    return M.heatmap_triples(gauges(s, d), "usr")


@query("a27_unify_range", f"WITH {G} SELECT min(value) AS min, max(value) AS max FROM g WHERE value > 0")
def a27(s, d):
    g = gauges(s, d)
    return M.unify_range(g.where("usr % 2 = 0"), g.where("usr % 2 = 1"))


@query("a27_diff_range", f"WITH {G} SELECT quantile_disc(value,0.05) AS lo, quantile_disc(value,0.95) AS hi, greatest(abs(quantile_disc(value,0.05)), abs(quantile_disc(value,0.95))) AS reach FROM (SELECT value - 50 AS value FROM g)")
def a27d(s, d):
    return M.diff_range(gauges(s, d).withColumn("value", F.col("value") - 50))


# --- wide form, text and description of recordings -------------------------------------------------------------------
@query("k02_to_wide_s01_wide_to_long", f"WITH {G}, {_DAYS}, s AS (SELECT metric, ts_ns, round(sum(value),6) AS value FROM dy GROUP BY ALL) SELECT metric, ts_ns, value FROM s")
def k02(s, d):
    from metrifold.sources.readers import wide_to_long
    from metrifold.sources.writers import to_wide

    daily = _daily(s, d).groupBy("metric", "ts_ns").agg(r6(F.sum("value")).alias("value"))
    wide = to_wide(daily, ["click", "error", "purchase", "signup", "view"]).withColumnRenamed("ts_ns", "timestamp").withColumn("duration", F.lit(1))
    return wide_to_long(wide)


@query("k03_prometheus_text", f"WITH {G}, l AS (SELECT metric, arg_max(value, ts_ns) AS value, max(ts_ns) AS ts_ns, usr FROM g GROUP BY metric, usr) SELECT metric, '# TYPE ' || metric || ' gauge' AS line FROM l GROUP BY metric UNION ALL SELECT metric, metric || '{{usr=\"' || usr || '\"}} ' || (value*100)::BIGINT || ' ' || ts_ns // 1000000 FROM l")
def k03(s, d):
    from metrifold.sources.writers import to_prometheus_text

    last = gauges(s, d).groupBy("metric", "usr").agg(F.round(F.max_by("value", "ts_ns") * 100).cast("long").alias("value"), F.max("ts_ns").alias("ts_ns"))
    return to_prometheus_text(last.select("metric", F.lit("gauge").alias("kind"), F.create_map(F.lit("usr"), F.col("usr").cast("string")).alias("labels"), "value", "ts_ns"))


@query("k08_describe_recording", f"WITH {G} SELECT usr, count(*) AS rows, count(DISTINCT metric) AS metrics, min(ts_ns) AS start, max(ts_ns) AS \"end\", round((max(ts_ns)-min(ts_ns))/(count(DISTINCT ts_ns)-1)/1e6,3) AS cadence_ms FROM g GROUP BY usr")
def k08(s, d):
    from metrifold.sources.writers import describe_recording

    return describe_recording(gauges(s, d), "usr").withColumn("cadence_ms", r6(F.col("cadence_ns") / 1e6, 3)).drop("cadence_ns")


@query("s02_combined_names", f"WITH {G} SELECT DISTINCT 'n' || (usr % 3) AS node, metric FROM g")
def s02(s, d):
    g = gauges(s, d).select(F.concat(F.lit("n"), (F.col("usr") % 3).cast("string"), F.lit("::"), "metric").alias("metric")).distinct()
    parts = F.split("metric", "::")
    return g.select(parts[0].alias("node"), F.element_at(parts, -1).alias("metric"))


@query("s03_metrics_in_two_tables", f"WITH {G} SELECT metric, count(DISTINCT usr % 4) AS tables FROM g GROUP BY metric HAVING count(DISTINCT usr % 4) > 1")
def s03(s, d):
    from metrifold.sources.readers import metrics_in_two_tables

    return metrics_in_two_tables(gauges(s, d).withColumn("table", F.col("usr") % 4))


@query("s10_read_ab", f"WITH {G} SELECT CASE WHEN usr % 2 = 0 THEN 'baseline' ELSE 'experiment' END AS arm, metric, count(*) AS n FROM g GROUP BY ALL")
def s10(s, d):
    from metrifold.sources.readers import read_ab

    g = gauges(s, d)
    return read_ab(g.where("usr % 2 = 0"), g.where("usr % 2 = 1")).groupBy("arm", "metric").agg(F.count("*").alias("n"))


@query("s13_recording_labels", "SELECT c_custkey AS recording, 'host=' || c_name || ',source=' || CASE WHEN c_nationkey = 1 THEN 'mine' ELSE c_mktsegment END AS labels FROM customer")
def s13(s, d):
    from metrifold.functions.scalar import labels_text
    from metrifold.sources.readers import recording_labels

    info = F.concat(F.lit('{"hostname":"'), F.col("c_name"), F.lit('"}'))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("recording"), F.col("c_mktsegment").alias("source"), info.alias("systeminfo"), F.when(F.col("c_nationkey") == 1, F.create_map(F.lit("source"), F.lit("mine"))).alias("user_labels"))
    return recording_labels(c).select("recording", labels_text(F.col("labels")).alias("labels"))


@query("st06_retain", f"WITH {G} SELECT event_id, value FROM g WHERE ts_ns > (SELECT max(ts_ns) FROM g) - {D1}")
def st06(s, d):
    from metrifold.streaming.live import retain

    return retain(gauges(s, d), D1).select("event_id", "value")


@query("st10_latest_with_ttl", f"WITH {G}, l AS (SELECT metric, usr, arg_max(value, ts_ns) AS value, max(ts_ns) AS ts_ns FROM g WHERE metric <> 'error' GROUP BY ALL) SELECT metric, usr, value, ts_ns FROM l WHERE ts_ns >= (SELECT max(ts_ns) FROM l) - {2 * D1} ORDER BY ts_ns DESC, metric, usr LIMIT 50")
def st10(s, d):
    from metrifold.streaming.live import latest_with_ttl

    g = gauges(s, d)
    return latest_with_ttl(g, ["usr"], 2 * D1, g.where("metric='error'").select("metric").distinct(), 50)
