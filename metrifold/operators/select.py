"""Selecting series and times, and arithmetic of one series with numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrifold.functions.scalar import domain_of
from metrifold.operators.base import finite, has_band


def label(df: DataFrame, name: str) -> Column:
    """A label as a column: of that name, or from the label map; null where a series lacks it."""
    return F.col(name).cast("string") if name in df.columns else F.try_element_at("labels", F.lit(name))


def select(df: DataFrame, metric: str | None = None, eq: Mapping[str, str] | None = None, ne: Mapping[str, str] | None = None, re: Mapping[str, str] | None = None, not_re: Mapping[str, str] | None = None) -> DataFrame:
    """Series by metric and label matchers; patterns match whole values, negated matchers also take series without the label."""
    if metric is not None:
        df = df.where(F.col("metric") == metric)
    empty = lambda k: F.coalesce(label(df, k), F.lit(""))
    for k, v in (eq or {}).items():
        df = df.where(empty(k) == v)
    for k, v in (ne or {}).items():
        df = df.where(empty(k) != v)
    for k, v in (re or {}).items():
        df = df.where(empty(k).rlike(f"^(?:{v})$"))
    for k, v in (not_re or {}).items():
        df = df.where(~empty(k).rlike(f"^(?:{v})$"))
    return df


def time_range(df: DataFrame, start: int | None = None, end: int | None = None, last: int | None = None) -> DataFrame:
    """Samples in [start, end], or the last so many nanoseconds before the newest sample."""
    if start is not None:
        df = df.where(F.col("ts_ns") >= start)
    if end is not None:
        df = df.where(F.col("ts_ns") <= end)
    if last is not None:
        newest = df.agg(F.max("ts_ns").alias("__newest"))  # one row
        df = df.join(F.broadcast(newest), F.col("ts_ns") >= F.col("__newest") - last).drop("__newest")
    return df


def keep_metrics(df: DataFrame, metrics: DataFrame) -> DataFrame:
    """Samples of the listed metrics."""
    return df.join(metrics.select("metric").distinct(), "metric", "left_semi")


def drop_metrics(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.where(~F.col("metric").isin(*names)) if names else df


def keep_kpi_series(df: DataFrame, kpis: DataFrame, agent: str = "agent") -> DataFrame:
    """Series that a KPI names (by the name before a colon), and all of the agent's own."""
    named = kpis.select(F.split("metric", ":")[0].alias("__base")).distinct().withColumn("__named", F.lit(True))
    out = df.withColumn("__base", F.split("metric", ":")[0]).join(named, "__base", "left")
    return out.where(F.col("__named") | (F.col("source") == agent)).drop("__base", "__named")


def keep_samplers(df: DataFrame, names: Sequence[str], column: str = "table") -> DataFrame:
    """Rows of the named samplers; a table is named sampler or sampler/group."""
    return df.where(F.split(F.col(column), "/")[0].isin(*names))


def filter_descriptions(descriptions: DataFrame, kept: DataFrame) -> DataFrame:
    return descriptions.join(kept.select("metric").distinct(), "metric", "left_semi")


def scope(df: DataFrame, **labels: str | Sequence[str]) -> DataFrame:
    """Restrict all series by labels, each to one value or any of several."""
    for k, v in labels.items():
        df = df.where(label(df, k).isin(*([v] if isinstance(v, str) else v)))
    return df


def only_finite(df: DataFrame) -> DataFrame:
    return df.where(finite(F.col("value")))


def scale(df: DataFrame, op: str, k: float, left: bool = False) -> DataFrame:
    """``value op k`` (``k op value`` with ``left``); a band is carried along and turned round where the order turns."""

    def apply(c: Column) -> Column:
        a, b = (F.lit(float(k)), c) if left else (c, F.lit(float(k)))
        return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op]

    if has_band(df):
        lo, hi = apply(F.col("lo")), apply(F.col("hi"))
        if op == "/" and left:  # no bound where the divisor may be zero
            over = (F.col("lo") <= 0) & (F.col("hi") >= 0)
            lo, hi = F.when(~over, lo), F.when(~over, hi)
        df = df.withColumns({"lo": F.least(lo, hi), "hi": F.greatest(lo, hi)})
    return df.withColumn("value", apply(F.col("value")))


def by_domain(df: DataFrame) -> DataFrame:
    return df.withColumn("domain", domain_of(F.col("metric")))


def kpi_available(df: DataFrame, kpis: DataFrame) -> DataFrame:
    """Each KPI title with whether its query's result has rows; ``df`` holds results by ``title``."""
    counts = df.groupBy("title").agg(F.count("*").alias("rows"))
    return kpis.select("title").distinct().join(counts, "title", "left").select("title", F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce("rows", F.lit(0)) > 0).alias("available"))


def classify_sources(catalog: DataFrame, agents: Sequence[str] = ("agent",), services: Sequence[str] = ()) -> DataFrame:
    """(source, source_kind): agent by tag or self-metrics, service by a template's name, else simple."""
    seen = catalog.groupBy("source").agg(F.bool_or(F.col("metric").startswith("self_")).alias("own"))
    kind = F.when(F.col("source").isin(*agents) | F.col("own"), "agent").when(F.col("source").isin(*services) if services else F.lit(False), "service").otherwise("simple")
    return seen.select("source", kind.alias("source_kind"))
