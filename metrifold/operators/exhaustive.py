"""Exhaustive detection: the series of all metrics of a recording, and every detector over them in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrifold.operators.anomaly import detect
from metrifold.operators.base import MINUTE, SECOND, cut, finite, idiv
from metrifold.operators.histogram import quantiles
from metrifold.operators.rates import indexed, rate
from metrifold.operators.select import drop_metrics

#: Metrics that are raw parts of others, redundant or settings; fixed values.
SKIPPED = (
    "cpu_tsc",
    "cpu_aperf",
    "cpu_mperf",
    "cgroup_cpu_aperf",
    "cgroup_cpu_mperf",
    "memory_numa_hit",
    "memory_numa_miss",
    "memory_numa_other",
    "memory_numa_interleave",
    "cgroup_cpu_bandwidth_periods",
    "cgroup_cpu_bandwidth_period_duration",
    "cgroup_cpu_bandwidth_quota",
)
#: Ratios of summed rates: name, numerator, denominator; fixed values.
RATIOS = (
    ("cpu_frequency_ratio", "cpu_aperf", "cpu_mperf"),
    ("cpu_instructions_per_cycle", "cpu_instructions", "cpu_cycles"),
    ("cgroup_cpu_frequency_ratio", "cgroup_cpu_aperf", "cgroup_cpu_mperf"),
    ("cgroup_cpu_instructions_per_cycle", "cgroup_cpu_instructions", "cgroup_cpu_cycles"),
)
PERCENTILES = (0.5, 0.9, 0.99)


def derived_ratios(rates: DataFrame) -> DataFrame:
    """(metric, ts_ns, value) of the ratios whose two counters are there, from summed rates (metric, ts_ns, value): one grouping for all."""
    parts = F.array(*[F.when(F.col("metric") == part, F.struct(F.lit(name).alias("name"), F.lit(k).alias("k"))) for name, *pair in RATIOS for k, part in enumerate(pair)])
    d = rates.select("ts_ns", "value", F.inline(F.array_compact(parts)))
    side = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    g = d.groupBy("name", "ts_ns").agg(side(0).alias("top"), side(1).alias("low"))
    return g.select(F.col("name").alias("metric"), "ts_ns", F.try_divide("top", "low").alias("value")).where("value is not null")


def all_series(counters: DataFrame, keys: Sequence[str], gauges: DataFrame, histograms: DataFrame, gp: int, step: int = SECOND, range_ns: int = MINUTE) -> DataFrame:
    """(metric, form, ts_ns, value): each counter's summed rate, each gauge's sum, each histogram's percentiles, and the ratios.

    ``counters`` have ``keys`` beside metric, ts_ns and value; times are put on a grid of ``step`` before sums are taken.
    """
    at = (idiv(F.col("ts_ns"), step) * step).alias("ts_ns")
    rates = rate(counters, ["metric", *keys], range_ns).where("value is not null").groupBy("metric", *keys, at).agg(F.max_by("value", "ts_ns").alias("value"))
    summed = cut(rates.groupBy("metric", "ts_ns").agg(F.sum("value").alias("value")), "summed-rates")  # the ratios read it too
    sums = gauges.groupBy("metric", at).agg(F.sum("value").alias("value"))
    q = quantiles(histograms, ["metric"], gp, PERCENTILES).select("metric", F.concat(F.lit("histogram_p"), F.round(F.col("quantile") * 100).cast("int").cast("string")).alias("form"), "ts_ns", "value")
    kept = lambda d, form: drop_metrics(d, SKIPPED).select("metric", F.lit(form).alias("form"), "ts_ns", "value")
    return kept(summed, "counter").unionByName(kept(sums, "gauge")).unionByName(q).unionByName(derived_ratios(summed).select("metric", F.lit("derived").alias("form"), "ts_ns", "value"))


def detect_all(series: DataFrame, step_s: float = 1.0) -> DataFrame:
    """The anomalies of all series (metric, form, ts_ns, value), with their times.

    Series are written once as they are and once with their places, so that neither is worked out again by each reader.
    """
    keys = ["metric", "form"]
    d = cut(indexed(cut(series.where(finite(F.col("value"))), "series"), keys), "indexed")
    return detect(d, keys, step_s)["anomalies"].join(d.select(*keys, "idx", "ts_ns"), [*keys, "idx"])
