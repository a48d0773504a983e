"""Combining recordings on a common grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrifold.operators.base import series
from metrifold.operators.rates import bucket_of, quantize


def combine(recordings: DataFrame, interval: int, n: int | None = None) -> DataFrame:
    """Rows of all recordings in the buckets that every one of them has: one row for each bucket, recording and metric, at the bucket's centre."""
    keys = ["recording", "metric"]
    q = quantize(recordings, keys, interval)
    total = recordings.agg(F.countDistinct("recording").alias("__all")) if n is None else recordings.sparkSession.range(1).select(F.lit(n).alias("__all"))
    common = q.groupBy("bucket").agg(F.countDistinct("recording").alias("n")).join(F.broadcast(total), F.col("n") == F.col("__all")).select("bucket")
    return q.join(common, "bucket").select("recording", "metric", F.col("bucket").alias("ts_ns"), "value")


def validate_combine(recordings: DataFrame, interval: int) -> DataFrame:
    """One row of checks: equal cadence (median gap within a tenth), ranges that overlap, and 95 % of common buckets whose times lie within a tenth of the interval."""
    ts = recordings.select("recording", "ts_ns").distinct()
    gap = F.col("ts_ns") - F.lag("ts_ns").over(series(["recording"]))
    gaps = ts.withColumn("gap", gap).groupBy("recording").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap)").alias("gap"), F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"))
    whole = gaps.agg(((F.max("gap") - F.min("gap")) * 10 <= F.min("gap")).alias("same_interval"), (F.max("t0") <= F.min("t1")).alias("overlap"), F.count("*").alias("n"))
    buckets = ts.withColumn("bucket", bucket_of(F.col("ts_ns"), interval)).groupBy("bucket").agg(F.countDistinct("recording").alias("k"), (F.max("ts_ns") - F.min("ts_ns")).alias("spread"))
    shared = buckets.join(F.broadcast(whole), F.col("k") == F.col("n")).agg(F.count("*").alias("common"), F.sum(F.when(F.col("spread") * 10 <= interval, 1).otherwise(0)).cast("long").alias("near"))
    return whole.join(F.broadcast(shared)).select("n", "same_interval", "overlap", "common", "near", (F.col("near") >= 0.95 * F.col("common")).alias("aligned"))


def duplicate_nodes(recordings: DataFrame) -> DataFrame:
    """Node and instance pairs that more than one recording claims."""
    return recordings.select("recording", "node", "instance").distinct().groupBy("node", "instance").agg(F.count("*").alias("n")).where("n > 1")
