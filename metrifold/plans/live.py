"""Queries: the streaming forms, run over the events file as a stream until it is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from metrifold.operators import base as B
from metrifold.plans.registry import C, G, gauges, query, r6, table
from metrifold.sources import readers as I
from metrifold.sources import writers as W
from metrifold.streaming import live as L


def _shared(s) -> str:
    return f"{B.shared_dir(s)}/live-{uuid.uuid4().hex}"


def _source(s, d):
    """events as a stream of gauge samples."""
    schema = table(s, d, "events").schema
    e = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return e.select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("series"), F.col("event_type").alias("metric"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), "value", "event_id")


def _done(s, sdf, mode="append"):
    """All rows that the stream gives, through a Parquet sink."""
    path = _shared(s)
    q = sdf.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(sdf.schema).parquet(f"{path}/rows")


def _kept(s, sdf) -> str:
    """Where all rows that the stream gives are written; in files short enough for several readers of a series."""
    path = _shared(s)
    q = sdf.writeStream.format("parquet").option("maxRecordsPerFile", 200_000).option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{path}/rows"


@query("s11_read_stream_k07_save_stream", f"WITH {G} SELECT metric, count(*) AS n, round(sum(value),4) AS total FROM g GROUP BY metric")
def s11(s, d):
    """Samples written as files, read as a live source and saved as they come."""
    path = _shared(s)
    g = gauges(s, d).select("metric", "ts_ns", "value")
    g.write.parquet(f"{path}/live")
    q = W.save_stream(I.read_stream(s, f"{path}/live", "metric string, ts_ns long, value double"), f"{path}/saved", f"{path}/state")
    q.awaitTermination()
    return s.read.schema(g.schema).parquet(f"{path}/saved").groupBy("metric").agg(F.count("*").alias("n"), r6(F.sum("value"), 4).alias("total"))


@query("st01_ingest_st09_dedup", f"WITH {G} SELECT event_id, ts_ns, value FROM g")
def st01(s, d):
    src = _source(s, d)
    return _done(s, L.dedup_stream(src.unionByName(src), ["event_id"])).select("event_id", "ts_ns", "value")


@query("st02_stream_rate", f"WITH {G} SELECT metric || '/' || usr AS series, ts_ns, round(CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END * 1e9 / (ts_ns - lag(ts_ns) OVER w),6) AS value FROM g WINDOW w AS (PARTITION BY metric, usr ORDER BY ts_ns) QUALIFY lag(ts_ns) OVER w IS NOT NULL")
def st02(s, d):
    return _done(s, L.stream_rate(_source(s, d))).select("series", "ts_ns", r6("value").alias("value"))


@query("st03_stream_cusum")
def st03(s, d):
    base = table(s, d, "events").groupBy(F.col("event_type").alias("series")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    src = _source(s, d).withColumn("series", F.col("metric"))
    return _done(s, L.stream_cusum(src, base))


_CLOSED = "(SELECT max(ts_ns) FROM g) - 600000000000"


_GROWN = "sa AS (SELECT metric, ts_ns, value, ts_ns // {h} * {h} AS start_ns, lag(value) OVER (PARTITION BY metric, ts_ns // {h} ORDER BY ts_ns, value) AS last FROM g)".format(h=B.HOUR)


@query("st04_stream_summary", f"WITH {G}, {_GROWN}, w AS (SELECT metric, start_ns, sum(CASE WHEN last IS NULL THEN 0 WHEN value < last THEN value ELSE value-last END) AS increase, arg_max(value, ts_ns) AS last, avg(value) AS mean, count(*) AS n FROM sa GROUP BY ALL) SELECT metric, start_ns, round(increase,6) AS increase, last, round(mean,6) AS mean, n FROM w WHERE start_ns + {B.HOUR} <= {_CLOSED}")
def st04(s, d):
    out = _done(s, L.stream_summary(_source(s, d), "1 hour", ["metric"]))
    return out.select("metric", (F.unix_micros("window.start") * 1000).alias("start_ns"), r6("increase").alias("increase"), "last", r6("mean").alias("mean"), "n")


@query("st04_stream_histogram_summary", f"""WITH {G}, b AS (SELECT metric, ts_ns, value, ts_ns // {B.DAY} * {B.DAY} AS start_ns, least(floor(value/10)::BIGINT, 15) AS k FROM g),
 ends AS (SELECT metric, start_ns, min(ts_ns) AS t0 FROM b GROUP BY ALL), ad AS (SELECT b.metric, b.start_ns, k, count(*) FILTER (ts_ns > t0) AS c FROM b JOIN ends USING (metric, start_ns) GROUP BY ALL),
 cu AS (SELECT metric, start_ns, k, sum(c) OVER (PARTITION BY metric, start_ns ORDER BY k) AS cum, sum(c) OVER (PARTITION BY metric, start_ns) AS total FROM ad WHERE c > 0),
 al AS (SELECT DISTINCT metric, start_ns FROM b)
SELECT al.metric, al.start_ns, coalesce(max(total), 0)::BIGINT AS added, (min(k) FILTER (cum >= greatest(ceil(0.5*total), 1)))::DOUBLE AS p50, (min(k) FILTER (cum >= greatest(ceil(0.9*total), 1)))::DOUBLE AS p90, (min(k) FILTER (cum >= greatest(ceil(0.99*total), 1)))::DOUBLE AS p99 FROM al LEFT JOIN cu USING (metric, start_ns) WHERE al.start_ns + {B.DAY} <= {_CLOSED} GROUP BY ALL""")
def st04h(s, d):
    """Cumulative histograms of the values so far, one snapshot with each event."""
    src = _source(s, d)
    k = F.least(F.floor(F.col("value") / 10), F.lit(15))
    snapshots = L.cumulative_histograms(src.withColumn("bucket", k.cast("int")), "metric", 16)
    out = _done(s, L.stream_histogram_summary(s.readStream.schema(snapshots.schema).parquet(_kept(s, snapshots)), "1 day", 3, ["metric"]))
    return out.select("metric", (F.unix_micros("window.start") * 1000).alias("start_ns"), "added", "p50", "p90", "p99")


@query("st05_stream_window", f"WITH {G}, w AS (SELECT metric, (ts_ns // {B.HOUR} - o) * {B.HOUR} AS start_ns, count(*) AS n, sum(value) AS total FROM g, range(6) r(o) GROUP BY ALL) SELECT metric, start_ns, round(total,6) AS value FROM w WHERE start_ns + {6 * B.HOUR} <= {_CLOSED}")
def st05(s, d):
    out = _done(s, L.stream_window(_source(s, d), "6 hours", "1 hour", "sum", ["metric"]))
    return out.select("metric", (F.unix_micros("window.start") * 1000).alias("start_ns"), r6("value").alias("value"))


@query("st08_stream_jitter", f"WITH {G} SELECT metric AS series, ts_ns, round((ts_ns - lag(ts_ns) OVER w)/1e6,3) AS gap_ms FROM g WINDOW w AS (PARTITION BY metric ORDER BY ts_ns) QUALIFY lag(ts_ns) OVER w IS NOT NULL")
def st08(s, d):
    out = _done(s, L.stream_jitter(_source(s, d).withColumn("series", F.col("metric"))))
    return out.select("series", "ts_ns", r6("gap_ms", 3).alias("gap_ms"))


@query("st07_snapshot", f"WITH {C} SELECT event_id, value FROM g WHERE ts_ns >= (SELECT max(ts_ns) FROM g) - {B.DAY}")
def st07(s, d):
    kept = _done(s, _source(s, d))
    return L.snapshot(kept, last=B.DAY).select("event_id", "value")
