"""Comparing two recordings, and thinning series and heatmaps for display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrifold.operators.base import has_band, idiv, whole


def rebase(df: DataFrame, offset_ns: int = 0) -> DataFrame:
    """``rel_ns``: time since the recording's own first sample, plus an offset."""
    first = df.agg(F.min("ts_ns").alias("__t0"))  # one row
    return df.join(F.broadcast(first)).withColumn("rel_ns", F.col("ts_ns") - F.col("__t0") + offset_ns).drop("__t0")


def compare(a: DataFrame, b: DataFrame, labels: Sequence[str], step_ns: int, offset_ns: int = 0) -> DataFrame:
    """Baseline ``a`` and experiment ``b`` step by step from their own starts, up to the shorter one's end; ``delta`` is null where either misses."""
    side = lambda d, name, off: rebase(d, off).select(*labels, idiv(F.col("rel_ns"), step_ns).alias("step"), "value").groupBy(*labels, "step").agg(F.avg("value").alias(name))
    x, y = side(a, "baseline", 0), side(b, "experiment", offset_ns)
    ends = x.agg(F.max("step").alias("m")).unionAll(y.agg(F.max("step").alias("m"))).agg(F.min("m").alias("__end"))
    j = x.join(y, [*labels, "step"], "full").join(F.broadcast(ends)).where(F.col("step") <= F.col("__end")).drop("__end")
    return j.withColumn("delta", F.col("experiment") - F.col("baseline"))


def divergence(a: DataFrame, b: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Lower and upper of two recordings on coincident times; null where either misses."""
    j = a.select(*labels, "ts_ns", F.col("value").alias("x")).join(b.select(*labels, "ts_ns", F.col("value").alias("y")), [*labels, "ts_ns"], "full")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return j.select(*labels, "ts_ns", F.when(both, F.least("x", "y")).alias("lower"), F.when(both, F.greatest("x", "y")).alias("upper"))


def spectrum_diff(a: DataFrame, b: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Experiment less baseline of two quantile spectra."""
    j = a.select(*labels, "quantile", F.col("value").alias("baseline")).join(b.select(*labels, "quantile", F.col("value").alias("experiment")), [*labels, "quantile"], "full")
    return j.withColumn("delta", F.col("experiment") - F.col("baseline"))


def default_points(n: int) -> int:
    return min(1200, max(48, -(-n // 5)))


def _bins(df: DataFrame, keys: Sequence[str], points: int) -> DataFrame:
    w = whole(keys)
    d = df.withColumns({"__t0": F.min("ts_ns").over(w), "__t1": F.max("ts_ns").over(w)})
    at = F.floor((F.col("ts_ns") - F.col("__t0")) * float(points) / (F.col("__t1") - F.col("__t0") + 1)).cast("long")
    return d.withColumn("bin", F.least(at, F.lit(points - 1).cast("long"))).drop("__t0", "__t1")


def boxplot(df: DataFrame, keys: Sequence[str], points: int, band: tuple[float, float] = (0.25, 0.75)) -> DataFrame:
    """Each bin's first time, least, lower, median, upper and greatest value; with bands also ``unc_lo`` and ``unc_hi``, the edges of all bands in the bin (null without any)."""
    v = lambda q: F.percentile("value", F.lit(q))
    edges = [F.min("lo").alias("unc_lo"), F.max("hi").alias("unc_hi")] if has_band(df) else []
    return _bins(df, keys, points).groupBy(*keys, "bin").agg(F.min("ts_ns").alias("ts_ns"), F.min("value").alias("min"), v(band[0]).alias("q_lo"), v(0.5).alias("median"), v(band[1]).alias("q_hi"), F.max("value").alias("max"), *edges).withColumnsRenamed({"q_lo": "lo", "q_hi": "hi"})


def minmax_decimate(df: DataFrame, keys: Sequence[str], points: int) -> DataFrame:
    """The least and the greatest sample of each bin, in time order, so that spikes stay."""
    low, high = F.min(F.struct("value", "ts_ns")), F.max(F.struct(F.col("value"), (-F.col("ts_ns")).alias("n")))
    g = _bins(df, keys, points).groupBy(*keys, "bin").agg(low.alias("a"), high.alias("b"))
    both = F.array_distinct(F.array(F.struct(F.col("a.ts_ns").alias("ts_ns"), F.col("a.value").alias("value")), F.struct((-F.col("b.n")).alias("ts_ns"), F.col("b.value").alias("value"))))
    return g.select(*keys, F.inline(both))


def heatmap_coarsen(df: DataFrame, factor: int) -> DataFrame:
    """Least and greatest of each row's ``factor`` neighbouring time columns."""
    return df.groupBy("y", idiv(F.col("t"), factor).alias("t")).agg(F.min("value").alias("min"), F.max("value").alias("max"))


def heatmap_triples(df: DataFrame, series: str) -> DataFrame:
    """(time_idx, id, value) with a dense index of the distinct times: numbers within coarse spans, then span offsets."""
    span = idiv(F.col("ts_ns"), 3_600_000_000_000)
    ts = df.select("ts_ns").distinct().withColumn("span", span)
    sizes = ts.groupBy("span").agg(F.count("*").alias("n"))
    before = sizes.select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("before"))  # one row for each hour
    idx = ts.withColumn("i", F.row_number().over(Window.partitionBy("span").orderBy("ts_ns")) - 1).join(before, "span").select("ts_ns", (F.col("before") + F.col("i")).cast("long").alias("time_idx"))
    return df.join(idx, "ts_ns").select("time_idx", F.col(series).alias("id"), "value")


def unify_range(*dfs: DataFrame) -> DataFrame:
    """Least and greatest positive cell over all arms."""
    out = dfs[0].select("value")
    for d in dfs[1:]:
        out = out.unionAll(d.select("value"))
    return out.where("value > 0").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def diff_range(df: DataFrame, trim: float = 0.05) -> DataFrame:
    """A range around zero for differences, at most ``trim`` of the cells beyond either end."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    g = df.where("value is not null").agg(p(trim).alias("lo"), p(1 - trim).alias("hi"))
    return g.select("lo", "hi", F.greatest(F.abs("lo"), F.abs("hi")).alias("reach"))


def ab_report(a: DataFrame, b: DataFrame, kpis: DataFrame, step_ns: int, title: str = "title") -> DataFrame:
    """For each KPI that both arms have: steps met, means, mean delta and its percent, widest divergence, and how often the experiment is higher.

    ``a`` and ``b`` hold KPI results by title; ``kpis`` lists titles. KPIs that an arm lacks come with zero steps.
    """
    steps = compare(a, b, [title], step_ns).where("delta is not null")
    g = steps.groupBy(title).agg(
        F.count("*").alias("steps"),
        F.avg("baseline").alias("baseline"),
        F.avg("experiment").alias("experiment"),
        F.avg("delta").alias("delta"),
        F.max(F.abs("delta")).alias("widest"),
        F.avg((F.col("delta") > 0).cast("double")).alias("higher"),
    )
    out = kpis.select(title).distinct().join(g, title, "left")
    return out.withColumns({"steps": F.coalesce("steps", F.lit(0)), "pct": F.try_divide(F.col("delta") * 100, F.abs("baseline"))})
