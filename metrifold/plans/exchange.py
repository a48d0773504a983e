"""Queries: text forms and files written and read again, and the A/B report."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from metrifold.operators import base as B
from metrifold.operators import compare as M
from metrifold.plans.registry import C, G, H, counters, end_sql, gauges, increments, query, r6, table
from metrifold.sources import readers as I
from metrifold.sources import writers as W

_LAST = "l AS (SELECT metric, usr::VARCHAR AS usr, round(arg_max(value, ts_ns)*100)::BIGINT AS v, max(ts_ns)//1000000*1000000 AS ts_ns FROM g GROUP BY metric, usr)"


def _last(s, d):
    g = gauges(s, d).groupBy("metric", "usr").agg(F.round(F.max_by("value", "ts_ns") * 100).cast("long").alias("value"), F.max("ts_ns").alias("ts_ns"))
    return g.withColumn("labels", F.create_map(F.lit("usr"), F.col("usr").cast("string")))


def _folder(s) -> str:
    return f"{B.shared_dir(s)}/exchange-{uuid.uuid4().hex}"


@query("s05_prometheus_text_round_trip", f"WITH {G}, {_LAST} SELECT metric, usr, v::DOUBLE AS value, 'counter' AS kind FROM l")
def s05(s, d):
    text = W.to_prometheus_text(_last(s, d).withColumn("kind", F.lit("counter")))
    lines = text.select(F.lit("one").alias("scrape"), F.lit(0).cast("long").alias("ts_ns"), F.col("line").alias("value"))
    return I.read_prometheus_text(lines).select("metric", F.col("labels")["usr"].alias("usr"), "value", "kind")


@query("s07_line_protocol", f"WITH {G}, {_LAST} SELECT metric, usr, CASE WHEN usr = '7' THEN 'own' ELSE 'all' END AS run, v::DOUBLE AS value FROM l")
def s07(s, d):
    extra = F.when(F.col("usr") == 7, F.lit(',run="own"')).otherwise(F.lit(""))
    line = F.concat("metric", F.lit('{usr="'), F.col("usr").cast("string"), F.lit('"'), extra, F.lit("} gauge:"), F.col("value").cast("string"))
    rows = _last(s, d).select(F.lit("f").alias("file"), "ts_ns", line.alias("value"))
    head = rows.limit(1).select("file", "ts_ns", F.lit('# SESSION run="all"').alias("value"))
    return I.read_line_protocol(rows.unionByName(head)).select("metric", F.col("labels")["usr"].alias("usr"), F.col("labels")["run"].alias("run"), "value")


@query("s08_annotations", "SELECT o_orderkey::VARCHAR AS id, epoch_us(o_orderdate)*1000 AS ts_ns, o_orderpriority AS description, 90000000000 AS duration_ns FROM orders")
def s08(s, d):
    t = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    doc = F.to_json(F.struct(t.alias("timestamp"), F.col("o_orderpriority").alias("description"), F.col("o_orderkey").cast("string").alias("id"), F.lit("1m30s").alias("duration")))
    return I.parse_annotations(table(s, d, "orders").select(doc.alias("value"))).select("id", "ts_ns", "description", "duration_ns")


@query("k01_write_recording", f"WITH {G} SELECT metric, usr, ts_ns, value FROM g WHERE ts_ns BETWEEN 1704412800000000000 AND 1704672000000000000")
def k01(s, d):
    path = _folder(s)
    W.write_recording(gauges(s, d), path, ["metric", "usr"])
    return s.read.parquet(path).where("ts_ns between 1704412800000000000 and 1704672000000000000").select("metric", "usr", "ts_ns", "value")


@query("k05_save_report", f"WITH {G} SELECT metric, count(*) AS n, 'trimmed' AS report FROM g WHERE metric IN ('click','view') GROUP BY metric")
def k05(s, d):
    path, g = _folder(s), gauges(s, d)
    W.save_report(g, g.where("metric in ('click','view')").select("metric").distinct(), g.where("metric = 'error'").select("ts_ns", F.col("metric").alias("description")), path)
    return s.read.parquet(f"{path}/samples").groupBy("metric").agg(F.count("*").alias("n"), F.max("report").alias("report"))


@query("k06_write_ab", f"WITH {G} SELECT CASE WHEN usr % 2 = 0 THEN 'baseline' ELSE 'experiment' END AS arm, count(*) AS n FROM g GROUP BY ALL")
def k06(s, d):
    path, g = _folder(s), gauges(s, d)
    W.write_ab(I.read_ab(g.where("usr % 2 = 0"), g.where("usr % 2 = 1")), path)
    return s.read.parquet(f"{path}/samples").groupBy("arm").agg(F.count("*").alias("n"))


@query("k03_histogram_text", "WITH q AS (SELECT l_returnflag AS flag, least(floor(l_quantity), 15)::BIGINT AS b, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT flag, b, sum(n) OVER (PARTITION BY flag ORDER BY b) AS cum FROM q) SELECT flag, flag || '_distribution_bucket{le=\"' || b || '\"} ' || cum || ' 0' AS line FROM c UNION ALL SELECT flag, unnest([flag || '_distribution_bucket{le=\"+Inf\"} ' || sum(n) || ' 0', flag || '_distribution_count ' || sum(n) || ' 0', flag || '_distribution_sum ' || sum(n*b) || ' 0']) FROM q GROUP BY flag")
def k03h(s, d):
    q = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.least(F.floor("l_quantity"), F.lit(15)).cast("long").alias("bucket")).agg(F.count("*").alias("count")).withColumn("ts_ns", F.lit(0).cast("long"))
    return W.histogram_text(q, ["flag"], 3).select("flag", "line")


@query("e11_ab_report", f"""WITH {G}, ar AS (SELECT usr % 2 AS arm, metric, (ts_ns - min(ts_ns) OVER (PARTITION BY usr % 2)) // {B.DAY} AS step, value FROM g), av AS (SELECT arm, metric, step, avg(value) AS v FROM ar GROUP BY ALL),
j AS (SELECT a.metric, a.v AS x, b.v AS y FROM av a JOIN av b ON a.metric=b.metric AND a.step=b.step AND a.arm=0 AND b.arm=1 AND a.step <= (SELECT min(m) FROM (SELECT max(step) AS m FROM av GROUP BY arm)))
SELECT metric AS title, count(*) AS steps, round(avg(x),6) AS baseline, round(avg(y),6) AS experiment, round(avg(y-x),6) AS delta, round(max(abs(y-x)),6) AS widest, round(avg(CASE WHEN y > x THEN 1.0::DOUBLE ELSE 0 END),6) AS higher, round(avg(y-x)*100/abs(avg(x)),6) AS pct FROM j GROUP BY metric""")
def e11(s, d):
    g = gauges(s, d).withColumnRenamed("metric", "title")
    out = M.ab_report(g.where("usr % 2 = 0"), g.where("usr % 2 = 1"), g.select("title").distinct(), B.DAY)
    return out.select("title", "steps", *[r6(c).alias(c) for c in ("baseline", "experiment", "delta", "widest", "higher", "pct")])


@query("s09_load_kpis", "SELECT p_brand AS service, p_type AS title, 'latency' AS role, count(*) AS n, count(*) FILTER (p_size > 25) AS ratios FROM part GROUP BY ALL")
def s09(s, d):
    """Templates written as a directory of JSON documents, one a brand, and read again."""
    path = _folder(s)
    kpi = F.struct(F.lit("latency").alias("role"), F.col("p_type").alias("title"), F.col("p_name").alias("query"), F.lit("gauge").alias("type"), F.lit(None).cast("string").alias("subtype"), F.lit(None).cast("array<double>").alias("percentiles"), (F.col("p_size") > 25).alias("denominator"))
    docs = table(s, d, "part").groupBy(F.col("p_brand").alias("service_name")).agg(F.array().cast("array<string>").alias("aliases"), F.collect_list(kpi).alias("kpis"))
    docs.repartition(4, "service_name").write.option("maxRecordsPerFile", 1).json(path)
    return I.load_kpis(s, path).groupBy("service", "title", "role").agg(F.count("*").alias("n"), F.count_if("denominator").alias("ratios"))


@query("s12_read_ground_truth", "SELECT o_orderpriority AS subsystem, count(*) AS documents, sum(o_orderkey % 3 + 1)::BIGINT AS signals, round(sum(o_totalprice),2) AS until FROM orders GROUP BY o_orderpriority")
def s12(s, d):
    """Truth documents written as JSON lines and read again."""
    path = _folder(s)
    key = F.col("o_orderkey")
    signal = F.struct(F.concat(F.lit("m"), key.cast("string")).alias("metric"), F.lit("ElevatedInWindow").alias("check"))
    doc = table(s, d, "orders").select(F.lit(1).alias("schema_version"), F.lit("cpu_saturation").alias("class"), F.col("o_orderpriority").alias("subsystem"), F.lit("m").alias("mechanism"), F.lit("up").alias("direction"), F.array(F.lit(0.0), F.col("o_totalprice")).alias("induced_window_s"), F.array_repeat(signal, (key % 3 + 1).cast("int")).alias("expected_signals"))
    doc.write.json(path)
    t = I.read_ground_truth(s, path, lines=True)
    return t.groupBy("subsystem").agg(F.count("*").alias("documents"), F.sum(F.size("expected_signals")).cast("long").alias("signals"), r6(F.sum(F.col("induced_window_s")[1]), 2).alias("until"))


def _template(s, folder: str, name: str, body: str) -> None:
    """One template file in a shared folder."""
    s.createDataFrame([(body,)], "value string").coalesce(1).write.text(f"{folder}/{name}")


_ORDERS_KPIS = '{"service": "shop", "kpis": [{"title": "clicks a day", "kind": "counter", "role": "load", "select": ["click"], "scale": 86400, "denominator": true}, {"title": "errors per click", "kind": "counter", "select": ["error"], "over": ["click"], "scale": 100}, {"title": "views of some", "kind": "gauge", "select": ["seen{usr=~1|2}"], "by": "usr", "fn": "max"}, {"title": "nothing", "kind": "gauge", "select": ["unheard"]}, {"title": "broken", "kind": "gauge", "select": []}, {"title": "odd", "kind": "sum", "select": ["x"]}]}'
_PRICE_KPIS = '{"service": "prices", "kpis": [{"title": "price", "kind": "histogram", "select": ["price"], "by": "flag", "scale": 0.01, "quantiles": [0.5, 0.95]}]}'
_KPI_SQL = f"""WITH {C}, {H}, rt AS (SELECT metric, usr, ts_ns // {B.DAY} * {B.DAY} AS d, (CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END) * 1e9 / (ts_ns - lag(ts_ns) OVER w) AS v FROM c WINDOW w AS (PARTITION BY metric, usr ORDER BY ts_ns)),
sm AS (SELECT d, sum(v) FILTER (metric = 'click') AS cl, sum(v) FILTER (metric = 'error') AS er FROM rt WHERE v IS NOT NULL AND metric IN ('click', 'error') GROUP BY d),
ga AS (SELECT ts_ns // {B.DAY} * {B.DAY} AS d, usr, max(value) AS v FROM g WHERE metric = 'view' AND usr IN (1, 2) GROUP BY ALL),
ph AS (SELECT flag, ts_ns, bucket, sum(count) OVER (PARTITION BY flag, ts_ns ORDER BY bucket) AS cum, sum(count) OVER (PARTITION BY flag, ts_ns) AS total FROM h)
SELECT 'shop' AS service, 'clicks a day' AS title, CAST(NULL AS VARCHAR) AS grp, d AS ts_ns, 'value' AS stat, CAST(cl * 86400 AS FLOAT) AS value FROM sm WHERE cl IS NOT NULL
UNION ALL SELECT 'shop', 'errors per click', NULL, d, 'value', CAST(er / cl * 100 AS FLOAT) FROM sm WHERE er / cl IS NOT NULL
UNION ALL SELECT 'shop', 'views of some', usr::VARCHAR, d, 'value', CAST(v AS FLOAT) FROM ga
UNION ALL SELECT 'prices', 'price', flag, ts_ns, q::VARCHAR, CAST({end_sql('min(bucket)', 3)} * 0.01 AS FLOAT) FROM ph, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) t(q) WHERE cum >= greatest(ceil(q * total), 1) GROUP BY flag, ts_ns, q"""


def _compiled(s):
    from metrifold.plans import templates as T

    folder = _folder(s)
    _template(s, folder, "shop", _ORDERS_KPIS)
    _template(s, folder, "prices", _PRICE_KPIS)
    _template(s, folder, "empty", "{}")
    return T.read_templates(s, f"{folder}/*")


def _kpi_samples(s, d):
    """Daily sums of rates and daily maxima of gauges, so that series meet."""
    from metrifold.operators.rates import rate_raw

    day = (B.idiv(F.col("ts_ns"), B.DAY) * B.DAY).alias("ts_ns")
    label = F.create_map(F.lit("usr"), F.col("usr").cast("string")).alias("labels")
    rates = rate_raw(counters(s, d).select("metric", "usr", "ts_ns", "value"), ["metric", "usr"]).groupBy("metric", "usr", day).agg(F.sum("value").alias("value"))
    seen = gauges(s, d).where("metric = 'view'").groupBy(F.lit("seen").alias("metric"), "usr", day).agg(F.max("value").alias("value"))
    return rates.unionByName(seen).select("metric", label, "ts_ns", "value")


@query("s09_run_templates", _KPI_SQL)
def s09_run(s, d):
    """A directory of templates as one aggregation of samples and one of histograms."""
    from metrifold.plans import templates as T

    prices = increments(s, d).select(F.lit("price").alias("metric"), F.create_map(F.lit("flag"), F.col("flag")).alias("labels"), "ts_ns", "bucket", "count")
    return T.run_kpis(_compiled(s), _kpi_samples(s, d), prices, 3).withColumn("value", F.col("value").cast("float"))


@query("s09_template_status", "SELECT * FROM (VALUES ('shop', 'clicks a day', 'ok'), ('shop', 'errors per click', 'ok'), ('shop', 'views of some', 'ok'), ('shop', 'nothing', 'empty'), ('prices', 'price', 'ok'), ('shop', 'broken', 'nothing selected'), ('shop', 'odd', 'unknown kind')) t(service, title, status) WHERE (SELECT count(*) FROM events) > 0")
def s09_status(s, d):
    """Which KPIs of the directory have rows, and why the others have none."""
    from metrifold.plans import templates as T

    c = _compiled(s)
    prices = increments(s, d).select(F.lit("price").alias("metric"), F.create_map(F.lit("flag"), F.col("flag")).alias("labels"), "ts_ns", "bucket", "count")
    return T.statuses(s, c, T.run_kpis(c, _kpi_samples(s, d), prices, 3)).where("title <> ''").select("service", "title", "status")
