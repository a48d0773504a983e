"""The register of queries and their SQL, and the telemetry views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metrifold.operators import scan
from metrifold.operators.base import idiv
from metrifold.operators.histogram import bucketed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def _ns(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) * 1000


def gauges(spark: SparkSession, d: str) -> DataFrame:
    """events as gauges: metric, usr, ts_ns, value."""
    return table(spark, d, "events").select(F.col("event_type").alias("metric"), F.col("user_id").alias("usr"), _ns("ts").alias("ts_ns"), "value", "event_id")


G = "g AS (SELECT event_type AS metric, user_id AS usr, epoch_us(ts)*1000 AS ts_ns, value, event_id FROM events)"


def counters(spark: SparkSession, d: str) -> DataFrame:
    """Running sums of event values in hundredths that start anew each week, with acquisition windows."""
    g = gauges(spark, d).withColumns({"inc": F.round(F.col("value") * 100).cast("long"), "wk": idiv(F.col("ts_ns"), 604_800_000_000_000)})
    w = Window.partitionBy("metric", "usr", "wk").orderBy("ts_ns")
    return g.select("metric", "usr", "ts_ns", F.sum("inc").over(w).alias("value"), (F.col("ts_ns") - 5_000_000 * (F.col("event_id") % 7)).alias("window_begin_ns"), (1_000_000 * (F.col("event_id") % 5 + 1)).alias("window_width_ns"))


C = G + """, c0 AS (SELECT *, CAST(round(value*100) AS BIGINT) AS inc, ts_ns // 604800000000000 AS wk FROM g),
c AS (SELECT metric, usr, ts_ns, CAST(sum(inc) OVER (PARTITION BY metric, usr, wk ORDER BY ts_ns) AS BIGINT) AS value,
 ts_ns - 5000000*(event_id % 7) AS window_begin_ns, 1000000*(event_id % 5 + 1) AS window_width_ns FROM c0)"""


def series(spark: SparkSession, d: str) -> DataFrame:
    """One gauge series for each event type: metric, idx, ts_ns, value."""
    g = gauges(spark, d).select("metric", "ts_ns", "value")
    return scan.plain(scan.numbered(scan.chunked(g, ["metric"]), "idx"))


X = G + ", x AS (SELECT metric, ts_ns, value, row_number() OVER (PARTITION BY metric ORDER BY ts_ns) - 1 AS idx FROM g)"


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Whole line prices by return flag and month: raw values for histograms."""
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.unix_micros(F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))) * 1000).alias("ts_ns"), F.floor("l_extendedprice").cast("long").alias("value"))


def increments(spark: SparkSession, d: str) -> DataFrame:
    """Histogram increments (grouping power 3) by flag and month."""
    return bucketed(prices(spark, d), ["flag"], 3)


P = "p AS (SELECT l_returnflag AS flag, epoch_us(date_trunc('month', l_shipdate))*1000 AS ts_ns, CAST(floor(l_extendedprice) AS BIGINT) AS value FROM lineitem)"


def index_sql(v: str, gp: int) -> str:
    n = f"length(bin({v}))"
    return f"(CASE WHEN {v} < {2 << gp} THEN {v} ELSE {2 << gp} + ({n} - {gp + 2}) * {1 << gp} + ({v} >> ({n} - {gp + 1})) - {1 << gp} END)"


def start_sql(b: str, gp: int) -> str:
    return f"(CASE WHEN {b} < {2 << gp} THEN {b} ELSE ({1 << gp} + ({b} & {(1 << gp) - 1})) * (1::BIGINT << (({b} >> {gp}) - 1)) END)"


def end_sql(b: str, gp: int) -> str:
    return f"(CASE WHEN {b} < {2 << gp} THEN {b} ELSE ({1 << gp} + ({b} & {(1 << gp) - 1}) + 1) * (1::BIGINT << (({b} >> {gp}) - 1)) - 1 END)"


H = P + f", h AS (SELECT flag, ts_ns, {index_sql('value', 3)} AS bucket, count(*) AS count FROM p GROUP BY ALL)"
