"""Rates of counters, functions over time ranges, grids and cadence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from metrifold.operators import scan
from metrifold.operators.base import MINUTE, SECOND, folded, idiv, idiv_up, series, whole


_KEPT = ("__k", "__c")


def _over(keys: Sequence[str], range_ns: int):
    return Window.partitionBy(*keys).orderBy("ts_ns").rangeBetween(-range_ns, 0)


def reset_delta(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``prev``, ``prev_ts`` and ``delta``: the increase since the last sample; after a decrease the new value itself."""
    w = series(keys)
    df = df.withColumns({"prev": F.lag("value").over(w), "prev_ts": F.lag("ts_ns").over(w)})
    return df.withColumn("delta", F.when(F.col("value") < F.col("prev"), F.col("value")).otherwise(F.col("value") - F.col("prev")))


def rate_raw(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Increase a second between neighbouring samples at the later one's time; with acquisition windows also its band.

    The band takes the longest and the shortest time that may lie between the two readings and holds the nominal rate.
    """
    w = series(keys)
    d = reset_delta(df, keys)
    rate = F.try_divide(F.col("delta").cast("double"), (F.col("ts_ns") - F.col("prev_ts")) / float(SECOND))
    cols = {"rate": rate}
    if "window_begin_ns" in df.columns:
        d = d.withColumns({"pb": F.lag("window_begin_ns").over(w), "pw": F.lag("window_width_ns").over(w)})
        begin, end = F.col("window_begin_ns"), F.col("window_begin_ns") + F.col("window_width_ns")
        longest = (end - F.col("pb")) / float(SECOND)
        shortest = (begin - F.col("pb") - F.col("pw")) / float(SECOND)
        delta = F.col("delta").cast("double")
        cols |= {"lo": F.least(F.try_divide(delta, longest), rate), "hi": F.when(shortest > 0, F.greatest(delta / shortest, rate))}
    return d.withColumns(cols).where("prev is not null and ts_ns > prev_ts").drop("prev", "prev_ts", "delta", "pb", "pw", "value").withColumnRenamed("rate", "value")


def adjusted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``adj``: the counter without its resets, 0 at the first sample; with prev, prev_ts and delta. Chunk by chunk."""
    return scan.plain(scan.counter_sums(scan.chunked(df, keys)))


def _adjusted_once(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same in one pass where, counted first, no series is longer than a chunk; chunks would read all samples twice."""
    longest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if longest is None or longest > scan.ROWS:
        return adjusted(df, keys)
    return reset_delta(df, keys).withColumn("adj", F.sum(F.coalesce("delta", F.lit(0))).over(series(keys)))


def interp_grid(df: DataFrame, keys: Sequence[str], step: int, column: str = "value") -> DataFrame:
    """``column`` on the grid of multiples of ``step``, linear between the samples on either side; nothing beyond them."""
    w = series(keys)
    pairs = df.select(*keys, "ts_ns", F.col(column).cast("double").alias("v"), F.lag("ts_ns").over(w).alias("t0"), F.lag(F.col(column).cast("double")).over(w).alias("v0"))
    return _between(pairs, keys, step)


def _between(pairs: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """The grid points after each pair's earlier sample (t0, v0), up to its later one (ts_ns, v)."""
    first = idiv_up(F.coalesce(F.col("t0") + 1, F.col("ts_ns")), step)
    last = idiv(F.col("ts_ns"), step)
    points = pairs.where(first <= last).withColumn("g", F.explode(F.sequence(first, last)))
    at = F.col("g") * step
    inside = F.col("v0") + (F.col("v") - F.col("v0")) * ((at - F.col("t0")) / (F.col("ts_ns") - F.col("t0")))
    return points.select(*keys, at.alias("ts_ns"), F.when(F.col("t0").isNull(), F.col("v")).otherwise(inside).alias("value"))


def interp_at(df: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``value`` of each series at the times of ``grid`` (keys, ts_ns): linear between neighbours, no extrapolation."""
    both = df.select(*keys, "ts_ns", F.col("value").cast("double").alias("v"), F.lit(False).alias("asked")).unionByName(grid.select(*keys, "ts_ns", F.lit(None).cast("double").alias("v"), F.lit(True).alias("asked")))
    order = Window.partitionBy(*keys).orderBy("ts_ns", "asked")
    point = F.when(~F.col("asked"), F.struct("ts_ns", "v"))
    before = F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = both.select(*keys, "ts_ns", "asked", before.alias("a"), after.alias("b")).where("asked")
    part = (F.col("ts_ns") - F.col("a.ts_ns")) / (F.col("b.ts_ns") - F.col("a.ts_ns"))
    value = F.when(F.col("a.ts_ns") == F.col("ts_ns"), F.col("a.v")).when(F.col("b.ts_ns") > F.col("a.ts_ns"), F.col("a.v") + (F.col("b.v") - F.col("a.v")) * part)
    return rows.select(*keys, "ts_ns", value.alias("value")).where("value is not null")


def rate_grid(df: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """(V(t) - V(t - step)) / step on the grid, from the interpolated, reset-adjusted counter, where both edges are observed."""
    c = scan.counter_sums(scan.chunked(df, keys))
    pairs = c.select(*keys, *_KEPT, "ts_ns", F.col("adj").cast("double").alias("v"), F.col("prev_ts").alias("t0"), (F.col("adj") - F.col("delta")).cast("double").alias("v0"))
    # a chunk's points but its first have their neighbour inside it; the chunk's last is carried to the next
    grid = scan.previous(_between(pairs, [*keys, *_KEPT], step), {"before": "value"})
    return grid.select(*keys, "ts_ns", ((F.col("value") - F.col("before")) / (step / SECOND)).alias("value")).where("value is not null")


def rate(df: DataFrame, keys: Sequence[str], range_ns: int) -> DataFrame:
    """Increase a second over the samples in (t - range, t], resets adjusted; null with one sample."""
    return increase(df, keys, range_ns, per_second=True)


def increase(df: DataFrame, keys: Sequence[str], range_ns: int, per_second: bool = False) -> DataFrame:
    """The rate times the range's seconds, as PromQL has it.

    A sliding frame would go through all samples of a range for each sample. Time is cut into blocks as long as the range, so
    that a range ends in one block and begins in the one before. A running frame sees its part of the one; a sample goes on to
    the next block, to the time when ranges leave it, where a frame that runs backwards sees the part of the other.
    """
    t = F.col("ts_ns")
    d = _adjusted_once(df, keys).select(*keys, "ts_ns", "adj", idiv(t - F.pmod(t, F.lit(range_ns)), range_ns).alias("__b"))
    own = Window.partitionBy(*keys, "__b").orderBy("ts_ns")
    d = d.withColumns({"__most": F.max("adj").over(own), "__least": F.min("adj").over(own), "__from": F.min("ts_ns").over(own)})
    place = lambda later, left: F.struct((F.col("__b") + later).alias("__p"), (t + later * range_ns).alias("__t"), F.lit(left).alias("__left"))
    d = d.select(*d.columns, F.inline(F.array(place(0, False), place(1, True))))
    before = Window.partitionBy(*keys, "__p").orderBy(F.desc("__t"), "__left")
    left = lambda f, c: f(F.when(F.col("__left"), F.col(c))).over(before)
    d = d.withColumns({"__most": F.greatest("__most", left(F.max, "adj")), "__least": F.least("__least", left(F.min, "adj")), "__from": F.least("__from", left(F.min, "ts_ns"))}).where("not __left")
    seconds = (t - F.col("__from")) / float(SECOND)
    value = F.try_divide((F.col("__most") - F.col("__least")).cast("double"), seconds) * (1.0 if per_second else range_ns / SECOND)
    return d.select(*keys, "ts_ns", value.alias("value"))


OVER_TIME = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "stddev": F.stddev_pop, "stdvar": F.var_pop, "last": F.last}


def over_time(df: DataFrame, keys: Sequence[str], fn: str, range_ns: int) -> DataFrame:
    """``fn`` of the samples in (t - range, t]."""
    return df.select(*keys, "ts_ns", OVER_TIME[fn](F.col("value")).over(_over(keys, range_ns - 1)).alias("value"))


def delta(df: DataFrame, keys: Sequence[str], range_ns: int) -> DataFrame:
    """Last less first value of a gauge in the range."""
    w = _over(keys, range_ns - 1)
    return df.select(*keys, "ts_ns", (F.col("value") - F.min_by("value", "ts_ns").over(w)).alias("value"))


def idelta(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, "ts_ns", (F.col("value") - F.lag("value").over(series(keys))).alias("value")).where("value is not null")


def irate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rate_raw(df, keys)


def _line(df: DataFrame, keys: Sequence[str], range_ns: int) -> tuple[DataFrame, Column, Column]:
    """Least squares over the range: slope a second and the value at the current sample; moments are taken about running means, so long series keep their digits."""
    w = _over(keys, range_ns - 1)
    x, y = (F.col("ts_ns") - F.min("ts_ns").over(whole(keys))) / float(SECOND), F.col("value").cast("double")
    df = df.select(*keys, "ts_ns", x.alias("x"), y.alias("y"))
    slope = F.regr_slope("y", "x").over(w)
    return df, slope, F.avg("y").over(w) + slope * (F.col("x") - F.avg("x").over(w))


def deriv(df: DataFrame, keys: Sequence[str], range_ns: int) -> DataFrame:
    df, slope, _ = _line(df, keys, range_ns)
    return df.select(*keys, "ts_ns", slope.alias("value"))


def predict_linear(df: DataFrame, keys: Sequence[str], range_ns: int, ahead_s: float) -> DataFrame:
    df, slope, now = _line(df, keys, range_ns)
    return df.select(*keys, "ts_ns", (now + slope * ahead_s).alias("value"))


def _steps(df: DataFrame, keys: Sequence[str], range_ns: int, flag: Column) -> DataFrame:
    """How many steps between neighbours inside the range have the flag; the step into its first sample is outside."""
    w = _over(keys, range_ns - 1)
    d = df.withColumns({"prev": F.lag("value").over(series(keys)), "prev_ts": F.lag("ts_ns").over(series(keys))}).withColumn("hit", F.when(flag, 1).otherwise(0))
    into = F.min_by("hit", "ts_ns").over(w)
    return d.select(*keys, "ts_ns", (F.sum("hit").over(w) - into).cast("long").alias("value"))


def changes(df: DataFrame, keys: Sequence[str], range_ns: int) -> DataFrame:
    return _steps(df, keys, range_ns, F.col("value") != F.col("prev"))


def resets(df: DataFrame, keys: Sequence[str], range_ns: int) -> DataFrame:
    return _steps(df, keys, range_ns, F.col("value") < F.col("prev"))


def double_exp(df: DataFrame, keys: Sequence[str], smooth: float, trend: float) -> DataFrame:
    """Double exponential smoothing of each series: its last level (null with fewer than two samples); null and NaN are no samples.

    A step maps (level, slope) by a fixed matrix and adds a multiple of the sample, so a chunk of samples is a matrix and a
    vector: chunks are folded side by side, a row each, and composed in order. The state before the second sample
    is the first sample and the difference of the first two.
    """
    names = list(keys)
    step = np.array([[1 - smooth, 1 - smooth], [-trend * smooth, 1 - trend * smooth]])
    gain = np.array([smooth, trend * smooth])
    v = F.col("value").cast("double")
    d = df.where(v.isNotNull() & ~F.isnan(v)).select(*names, "ts_ns", v.alias("v"))
    d = indexed(d, names).withColumn("__c", idiv(F.col("idx"), scan.ROWS))
    kinds, parts = dict(d.dtypes), [*names, "__c"]
    schema = to_arrow_schema(d.select(*parts).schema).append(pa.field("n", pa.int64())).append(pa.field("m", pa.list_(pa.float64())))

    def fold(state: dict, rows: pa.RecordBatch) -> pa.RecordBatch:
        x = rows.column("v").to_numpy(zero_copy_only=False)
        weights = np.empty((len(x), 2))  # of the newest sample first
        now, whole_step = gain, np.eye(2)
        for i in range(len(x)):
            weights[i] = now
            now, whole_step = step @ now, whole_step @ step
        add, matrix, n = state.get("add", np.zeros(2)), state.get("matrix", np.eye(2)), state.get("n", 0) + len(x)
        state.update(add=whole_step @ add + weights.T @ x[::-1], matrix=whole_step @ matrix, n=n)
        last = rows.slice(rows.num_rows - 1, 1)
        return pa.RecordBatch.from_arrays([*(last.column(k) for k in parts), pa.array([n], pa.int64()), pa.array([[*state["matrix"].ravel(), *state["add"]]], pa.list_(pa.float64()))], names=[*parts, "n", "m"])

    pieces = folded(d.where("idx > 0"), parts, ["idx"], fold, ", ".join([*(f"`{k}` {kinds[k]}" for k in parts), "n long, m array<double>"]), schema)
    chunks = pieces.groupBy(*parts).agg(F.max_by("m", "n").alias("m")).groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("__c", "m"))), lambda c: c["m"]).alias("chunks"))  # a row for each ROWS samples
    starts = d.where("idx < 2").groupBy(*names).agg(F.max(F.when(F.col("idx") == 0, F.col("v"))).alias("x0"), F.max(F.when(F.col("idx") == 1, F.col("v"))).alias("x1"))
    key = F.struct(*names).alias("__k")
    both = starts.withColumn("__k", key).join(chunks.select(key, "chunks"), "__k", "left")
    apply = lambda s, m: F.struct((m[0] * s["l"] + m[1] * s["b"] + m[4]).alias("l"), (m[2] * s["l"] + m[3] * s["b"] + m[5]).alias("b"))
    level = F.aggregate("chunks", F.struct(F.col("x0").alias("l"), (F.col("x1") - F.col("x0")).alias("b")), apply)["l"]
    return both.select(*names, F.when(F.col("x1").isNotNull(), level).alias("value"))


def gauge_grid(df: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """The last sample, its band and window with it, at or before each grid time from a series' first sample to its last."""
    rest = [c for c in ("value", "lo", "hi", "window_begin_ns", "window_width_ns", "window_end_ns") if c in df.columns]
    spans = df.select(*keys, "ts_ns", *rest, F.lead("ts_ns").over(series(keys)).alias("t1"))
    first = idiv_up(F.col("ts_ns"), step)
    last = F.when(F.col("t1").isNull(), first).otherwise(idiv_up(F.col("t1"), step) - 1)
    return spans.where(first <= last).withColumn("__g", F.explode(F.sequence(first, last))).select(*keys, (F.col("__g") * step).alias("ts_ns"), *rest)


def jitter(df: DataFrame, keys: Sequence[str], declared_ns: int | None = None) -> DataFrame:
    """Gap to the last sample in ms and its distance from nominal: the declared interval where that is at most twice the mean gap."""
    gap = F.col("ts_ns") - F.lag("ts_ns").over(series(keys))
    d = df.select(*keys, "ts_ns", (gap / 1e6).alias("gap_ms")).where("gap_ms is not null")
    mean = F.avg("gap_ms").over(whole(keys))
    nominal = mean if declared_ns is None else F.when(F.lit(declared_ns / 1e6) <= 2 * mean, declared_ns / 1e6).otherwise(mean)
    return d.withColumn("nominal", nominal).select(*keys, "ts_ns", "gap_ms", (F.col("gap_ms") - F.col("nominal")).alias("off_ms"))


def bucket_of(ts: Column, interval: int) -> Column:
    """The centre of the interval nearest to a time."""
    return idiv(ts + interval // 2, interval) * interval


def quantize(df: DataFrame, keys: Sequence[str], interval: int) -> DataFrame:
    """One sample for each bucket, the nearest to its centre, the earlier on ties."""
    d = df.withColumn("bucket", bucket_of(F.col("ts_ns"), interval))
    w = Window.partitionBy(*keys, "bucket").orderBy(F.abs(F.col("ts_ns") - F.col("bucket")), "ts_ns")
    return d.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def infer_interval(df: DataFrame, keys: Sequence[str], first: int = 100) -> DataFrame:
    """The median of the first gaps, 1 ms at least, and whether under 60 % of them lie within a quarter of it."""
    w = series(keys)
    gaps = df.select(*keys, "ts_ns", (F.col("ts_ns") - F.lag("ts_ns").over(w)).alias("gap")).where("gap > 0").withColumn("i", F.row_number().over(w)).where(F.col("i") <= first)
    ranked = gaps.withColumns({"r": F.row_number().over(Window.partitionBy(*keys).orderBy("gap", "ts_ns")), "n": F.count("*").over(whole(keys))})
    median = ranked.groupBy(*keys).agg(F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("gap"))).alias("m"))
    near = F.sum(F.when(F.abs(F.col("gap") - F.col("m")) * 4 <= F.col("m"), 1).otherwise(0))
    out = gaps.join(median, [*keys]).groupBy(*keys, "m").agg(F.count("*").alias("gaps"), (near < 0.6 * F.count("*")).alias("irregular"))
    return out.select(*keys, F.greatest("m", F.lit(1_000_000).cast("long")).alias("interval_ns"), "gaps", "irregular", (F.col("m") < 1_000_000).alias("clamped"))


def indexed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``idx``: 0-based place in the series."""
    return scan.plain(scan.numbered(scan.chunked(df, keys), "idx"))


def step_or_default(step_s: Column) -> Column:
    """A step of one second where it is not finite or not positive."""
    return F.when(step_s.isNotNull() & ~F.isnan(step_s) & (step_s > 0) & (step_s < float("inf")), step_s).otherwise(F.lit(1.0))


def clock_drift(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First wall offset, the newest one and the observation count of each recording."""
    seen = df.where("wall_offset is not null").groupBy(*keys)
    return seen.agg(F.min_by("wall_offset", "ts_ns").alias("anchor"), F.max_by("wall_offset", "ts_ns").alias("newest"), F.count("*").alias("n")).withColumn("drift", F.col("newest") - F.col("anchor"))


def instant(df: DataFrame, keys: Sequence[str], at_ns: int, lookback_ns: int = 5 * MINUTE) -> DataFrame:
    """Each series' last value at a time, no older than the lookback."""
    return df.where((F.col("ts_ns") <= at_ns) & (F.col("ts_ns") > at_ns - lookback_ns)).groupBy(*keys).agg(F.max_by("value", "ts_ns").alias("value"))
