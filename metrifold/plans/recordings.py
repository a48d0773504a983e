"""Queries over recordings that Spark writes from the events: named and labelled columns, read back by their footers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metrifold.operators import histogram as H
from metrifold.operators import rates as R
from metrifold.operators.base import DAY, idiv, shared_dir
from metrifold.plans.registry import G, end_sql, gauges, index_sql, query, r6
from metrifold.sources import recording as S

TYPES = ("click", "error", "purchase", "signup", "view")
#: Above 2^53, where doubles skip every other whole number.
BASE = 9_007_199_254_740_993
GP, MVP = 3, 10
_SIZE = H.bucket_count(GP, MVP)


def _days(s: SparkSession, d: str) -> DataFrame:
    """Event increments in hundredths by type, parity of the user and day."""
    g = gauges(s, d).withColumns({"ts_ns": idiv(F.col("ts_ns"), DAY) * DAY, "side": F.col("usr") % 2})
    return g.groupBy("metric", "side", "ts_ns").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("inc"))


def _counter_table(s: SparkSession, d: str, prefix: str = "", label: dict[str, str] | None = None, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Wide: a counter for each type and parity, with a window of its own for even users and the table's for odd ones."""
    days = _days(s, d).where(F.col("metric").isin(*types))
    total = F.sum("inc").over(Window.partitionBy("metric", "side").orderBy("ts_ns"))
    rows = days.select("ts_ns", F.concat_ws("/", "metric", "side").alias("series"), (total + BASE).cast("decimal(20,0)").alias("value"))
    names = [f"{t}/{side}" for t in types for side in (0, 1)]
    wide = rows.groupBy("ts_ns").pivot("series", names).agg(F.first("value"))
    columns = [S.described(F.col(f"`{n}`"), prefix + n, f"{n.split('/')[0]}_total", "counter", {"side": ("even", "odd")[int(n[-1])], **(label or {})}, unit="hundredths") for n in names]
    own = [c for n in names if n[-1] == "0" for c in (F.lit(-2_000_000_000).cast("long").alias(f"{prefix}{n}:window_begin"), F.lit(500_000_000).cast("long").alias(f"{prefix}{n}:window_width"))]
    table = [F.lit(-1_000_000_000).cast("long").alias(":window_begin"), F.lit(250_000_000).cast("long").alias(":window_width")]
    return wide.select(F.col("ts_ns").alias("timestamp"), F.lit(DAY).alias("duration"), *table, *columns, *own)


def _histogram_table(s: SparkSession, d: str) -> DataFrame:
    """Wide: cumulative bucket lists of whole event values for each type, and a gauge of the day's greatest value."""
    g = gauges(s, d).withColumn("ts_ns", idiv(F.col("ts_ns"), DAY) * DAY)
    counts = g.groupBy("metric", "ts_ns", H.bucket_index(F.floor("value"), GP).alias("bucket")).agg(F.count("*").alias("n"))
    grid = g.select("metric", "ts_ns").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SIZE - 1).cast("long"))))
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("metric", "bucket").orderBy("ts_ns"))
    dense = grid.join(counts, ["metric", "ts_ns", "bucket"], "left").select("metric", "ts_ns", F.struct("bucket", total.cast("decimal(20,0)").alias("n")).alias("b"))
    lists = dense.groupBy("metric", "ts_ns").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["n"]).alias("buckets"))
    most = g.groupBy("metric", "ts_ns").agg(F.max("value").alias("most"))
    wide = lists.join(most, ["metric", "ts_ns"]).groupBy("ts_ns").pivot("metric", list(TYPES)).agg(F.first("buckets").alias("b"), F.first("most").alias("m"))
    columns = [S.described(F.col(f"{t}_b"), f"{t}_size:buckets", "event_size", "histogram", {"type": t}, grouping_power=GP, max_value_power=MVP) for t in TYPES]
    columns += [S.described(F.col(f"{t}_m"), f"{t}_most", "event_most", "gauge", {"type": t}) for t in TYPES]
    return wide.select(F.col("ts_ns").alias("timestamp"), F.lit(DAY).alias("duration"), *columns)


def _saved(df: DataFrame, label: str, files: int = 1) -> str:
    """A recording in the shared folder, ranged by time."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.repartitionByRange(files, "timestamp").sortWithinPartitions("timestamp").write.parquet(path)
    return path


_DAY = f"dy AS (SELECT metric, usr % 2 AS side, ts_ns // {DAY} * {DAY} AS ts_ns, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS inc FROM g GROUP BY ALL), ct AS (SELECT metric, side, ts_ns, sum(inc) OVER (PARTITION BY metric, side ORDER BY ts_ns) + {BASE} AS value, CASE WHEN side = 0 THEN 2000000000 ELSE 1000000000 END AS back, CASE WHEN side = 0 THEN 500000000 ELSE 250000000 END AS width FROM dy)"


@query("s01_recording_counters", f"WITH {G}, {_DAY} SELECT metric || '_total' AS metric, CASE WHEN side = 0 THEN 'even' ELSE 'odd' END AS side, ts_ns, value::VARCHAR AS value, ts_ns - back AS window_begin_ns, width::BIGINT AS window_width_ns FROM ct")
def s01_counters(s, d):
    """Counters beyond 2^53 with the labels of the footer and the windows of series and table."""
    c = S.read_recording(s, _saved(_counter_table(s, d), "counters")).counters
    return c.select("metric", F.col("labels")["side"].alias("side"), "ts_ns", F.col("value").cast("string").alias("value"), "window_begin_ns", "window_width_ns")


@query("s01_recording_rates", f"WITH {G}, {_DAY}, r AS (SELECT metric, side, ts_ns, ts_ns - lag(ts_ns) OVER w AS dt, (value - lag(value) OVER w)::DOUBLE AS dv, width FROM ct WINDOW w AS (PARTITION BY metric, side ORDER BY ts_ns)) SELECT metric || '_total' AS metric, CASE WHEN side = 0 THEN 'even' ELSE 'odd' END AS side, ts_ns, round(dv / (dt / 1e9) * 86400, 6) AS value, round(dv / ((dt + width) / 1e9) * 86400, 6) AS lo, round(dv / ((dt - width) / 1e9) * 86400, 6) AS hi FROM r WHERE dt IS NOT NULL")
def s01_rates(s, d):
    """Differences of exact counters, then a rate with its band from the windows of the file; one type's columns are read at a time."""
    path, out = _saved(_counter_table(s, d), "counters", 3), None
    for t in TYPES:
        c = S.read_recording(s, path, [f"{t}_total"]).counters.withColumn("side", F.col("labels")["side"])
        r = R.rate_raw(c.select("metric", "side", "ts_ns", "value", "window_begin_ns", "window_width_ns"), ["metric", "side"])
        r = r.select("metric", "side", "ts_ns", *(r6(F.col(x) * 86400).alias(x) for x in ("value", "lo", "hi")))
        out = r if out is None else out.unionByName(r)
    return out


@query(
    "s01_recording_histograms",
    f"WITH {G}, b AS (SELECT metric AS type, ts_ns // {DAY} * {DAY} AS ts_ns, {index_sql('CAST(floor(value) AS BIGINT)', GP)} AS bucket FROM g), n AS (SELECT type, ts_ns, bucket, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY type, ts_ns ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY type, ts_ns) AS total FROM n),"
    f" q AS (SELECT type, ts_ns, min(bucket) FILTER (cum >= ceil(0.5 * total)) AS p50, min(bucket) FILTER (cum >= ceil(0.9 * total)) AS p90 FROM k GROUP BY ALL), f AS (SELECT type, min(ts_ns) AS t0 FROM n GROUP BY type), u AS (SELECT type, ts_ns, 0.5 AS quantile, {end_sql('p50', GP)}::DOUBLE AS value FROM q UNION ALL SELECT type, ts_ns, 0.9, {end_sql('p90', GP)}::DOUBLE FROM q) SELECT u.type, u.ts_ns, u.quantile::DOUBLE AS quantile, u.value FROM u JOIN f ON f.type = u.type WHERE u.ts_ns > f.t0",
)
def s01_histograms(s, d):
    """Bucket lists of the file, their differences between snapshots, and quantiles of these."""
    h = S.read_recording(s, _saved(_histogram_table(s, d), "histograms", 2), ["event_size"]).histograms
    snaps = h.where((F.col("gp") == GP) & (F.col("mvp") == MVP)).select(F.col("labels")["type"].alias("type"), "ts_ns", "buckets")
    return H.quantiles(S.sparse(H.delta(snaps, ["type"]), ["type"]), ["type"], GP, (0.5, 0.9)).select("type", "ts_ns", "quantile", "value")


@query("s04_footer_catalog", f"WITH {G} SELECT metric || '_total' AS metric, 'counter' AS kind, 'side' AS label_names, 2::BIGINT AS series FROM g GROUP BY metric UNION ALL SELECT 'event_size', 'histogram', 'type', count(DISTINCT metric) FROM g UNION ALL SELECT 'event_most', 'gauge', 'type', count(DISTINCT metric) FROM g")
def s04_footers(s, d):
    """Names by kind, label names and series, from the ends of the files alone."""
    one, other = (S.catalog_of(S.footers(s, _saved(t(s, d), "catalog", 2))) for t in (_counter_table, _histogram_table))
    return S.series_catalog(one.unionByName(other)).withColumn("label_names", F.array_join("label_names", ","))


@query("s02_read_combined", f"WITH {G}, {_DAY} SELECT 'n' || n AS node, metric || '_total' AS metric, CASE WHEN side = 0 THEN 'even' ELSE 'odd' END AS side, max(value)::VARCHAR AS last, count(*) AS samples FROM ct, range(2) r(n) GROUP BY ALL")
def s02_combined(s, d):
    """A combined recording: columns ``node::series``, the node among the labels."""
    one, two = (_counter_table(s, d, f"n{i}::", {"node": f"n{i}"}).drop(":window_begin", ":window_width", "duration") for i in (0, 1))
    c = S.read_recording(s, _saved(one.join(two, "timestamp"), "combined")).counters
    return c.groupBy(F.col("labels")["node"].alias("node"), "metric", F.col("labels")["side"].alias("side")).agg(F.max("value").cast("string").alias("last"), F.count("*").alias("samples"))


@query("s03_read_tables", f"WITH {G}, {_DAY}, e AS (SELECT 'totals' AS \"table\", metric || '_total' AS metric, ts_ns FROM ct UNION ALL SELECT 'sizes', 'event_most', ts_ns FROM (SELECT DISTINCT metric, ts_ns // {DAY} * {DAY} AS ts_ns FROM g)) SELECT \"table\", metric, count(*) AS samples, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, true AS in_order FROM e GROUP BY ALL")
def s03_tables(s, d):
    """Tables of two samplers in segments: each sample with its table and segment, segments in the order of time."""
    r = S.read_tables(s, totals=_saved(_counter_table(s, d), "totals", 3), sizes=_saved(_histogram_table(s, d), "sizes", 2))
    rows = r.samples()
    span = rows.groupBy("table", "metric", "segment").agg(F.count("*").alias("n"), F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b"))
    before = F.max("b").over(Window.partitionBy("table", "metric").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    span = span.withColumn("ordered", F.coalesce(F.col("a") > before, F.lit(True)))
    return span.groupBy("table", "metric").agg(F.sum("n").alias("samples"), F.min("a").alias("start_ns"), F.max("b").alias("end_ns"), F.min("ordered").alias("in_order"))


@query("k08_describe_files", f"WITH {G}, t AS (SELECT DISTINCT ts_ns // {DAY} * {DAY} AS ts_ns FROM g) SELECT count(*) AS rows, 24::BIGINT AS columns, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns FROM t")
def k08_files(s, d):
    """Row and column counts and the span of a recording's files, without reading a row."""
    t = S.tables_of(S.footers(s, _saved(_counter_table(s, d), "described", 3)))
    return t.agg(F.sum("rows").alias("rows"), F.max("columns").alias("columns"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
