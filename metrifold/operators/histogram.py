"""Log-linear histograms in sparse long form: keys, ts_ns, bucket, count (cumulative over time).

A bucket layout has a grouping power ``gp`` (2^gp buckets in each power of two) and a largest power ``mvp``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrifold.operators.base import SECOND, idiv, series


def bucket_count(gp: int, mvp: int) -> int:
    return (mvp - gp + 1) << gp


def bucket_index(v: Column, gp: int) -> Column:
    """The bucket of a non-negative integer: exact below 2^(gp+1), then 2^gp buckets for each power."""
    v = v.cast("long")
    h = F.length(F.bin(v)) - 1
    far = (1 << (gp + 1)) + (h - gp - 1) * (1 << gp) + F.call_function("shiftright", v, (h - gp).cast("int")) - (1 << gp)
    return F.when(v < (1 << (gp + 1)), v).otherwise(far).cast("long")


def bucket_bounds(i: Column, gp: int) -> tuple[Column, Column]:
    """First and last value of a bucket."""
    i = i.cast("long")
    power = F.shiftright(i, gp) - 1
    width = F.call_function("shiftleft", F.lit(1).cast("long"), power.cast("int"))
    start = (F.lit(1 << gp) + i.bitwiseAND(F.lit((1 << gp) - 1).cast("long"))) * width
    exact = i < (1 << (gp + 1))
    return F.when(exact, i).otherwise(start), F.when(exact, i).otherwise(start + width - 1)


def bucketed(df: DataFrame, keys: Sequence[str], gp: int, column: str = "value") -> DataFrame:
    """Counts by bucket of raw values."""
    return df.groupBy(*keys, "ts_ns", bucket_index(F.col(column), gp).alias("bucket")).agg(F.count("*").alias("count"))


def explode_buckets(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sparse rows from dense arrays."""
    return df.select(*keys, "ts_ns", F.posexplode("buckets").alias("bucket", "count")).where("count > 0").withColumn("bucket", F.col("bucket").cast("long"))


def cumulative(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counters from increments, bucket by bucket."""
    return df.withColumn("count", F.sum("count").over(series([*keys, "bucket"])).cast("long"))


def delta(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Increments between snapshots of dense arrays; a snapshot in which any bucket falls is a reset and is skipped."""
    prev = F.lag("buckets").over(series(keys))
    d = df.withColumn("prev", prev).where("prev is not null")
    d = d.withColumn("buckets", F.zip_with("buckets", "prev", lambda a, b: a - b)).drop("prev")
    return d.where(~F.exists("buckets", lambda x: x < 0))


def merge(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bucket-wise sum over series."""
    return df.groupBy(*by, "ts_ns", "bucket").agg(F.sum("count").alias("count"))


def _ranked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "ts_ns")
    return df.withColumns({"cum": F.sum("count").over(w.orderBy("bucket")), "total": F.sum("count").over(w)})


def quantiles(df: DataFrame, keys: Sequence[str], gp: int, qs: Sequence[float] = (0.5, 0.9, 0.99, 0.999, 0.9999), stride: int | None = None) -> DataFrame:
    """(keys, ts_ns, quantile, value, lo, hi): the end of the bucket that holds rank ceil(q total); its bounds are the band."""
    if stride:
        df = df.withColumn("ts_ns", idiv(F.col("ts_ns"), stride) * stride)
    df = merge(df, keys)
    r = _ranked(df, keys).withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    r = r.where((F.col("cum") >= F.greatest(F.ceil(F.col("quantile") * F.col("total")), F.lit(1))) & (F.col("total") > 0))
    hit = r.groupBy(*keys, "ts_ns", "quantile").agg(F.min("bucket").alias("bucket"))
    lo, hi = bucket_bounds(F.col("bucket"), gp)
    return hit.select(*keys, "ts_ns", "quantile", hi.cast("double").alias("value"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def quantile(df: DataFrame, keys: Sequence[str], gp: int, q: float) -> DataFrame:
    return quantiles(df, keys, gp, (q,)).drop("quantile")


def spectrum(df: DataFrame, keys: Sequence[str], gp: int, kind: str = "full") -> DataFrame:
    """A hundred quantiles: i/100, or the tail (9900 + i)/10000."""
    return quantiles(df, keys, gp, [i / 100 if kind == "full" else (9900 + i) / 10000 for i in range(1, 101)])


def count_sum_mean(df: DataFrame, keys: Sequence[str], gp: int) -> DataFrame:
    """Exact count, sum at bucket midpoints with its band, and mean."""
    lo, hi = bucket_bounds(F.col("bucket"), gp)
    n = F.col("count")
    g = df.groupBy(*keys, "ts_ns").agg(F.sum(n).cast("long").alias("count"), F.sum(n * (lo + hi) / 2.0).alias("sum"), F.sum(n * lo).cast("double").alias("lo"), F.sum(n * hi).cast("double").alias("hi"))
    return g.withColumn("mean", F.try_divide("sum", "count"))


def observation_rate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observations a second between snapshots of cumulative counts."""
    from metrifold.operators.rates import rate_raw

    return rate_raw(df.groupBy(*keys, "ts_ns").agg(F.sum("count").alias("value")), keys)


def rate_mean(df: DataFrame, keys: Sequence[str], gp: int) -> DataFrame:
    """Observations a second with the mean of each interval's increments."""
    w = series(keys)
    s = count_sum_mean(df, keys, gp).select(*keys, "ts_ns", "count", "mean")
    return s.withColumn("rate", F.try_divide(F.col("count").cast("double"), (F.col("ts_ns") - F.lag("ts_ns").over(w)) / float(SECOND))).where("rate is not null")


def heatmap(df: DataFrame, by: Sequence[str] = (), stride: int | None = None) -> DataFrame:
    """Sparse (ts_ns, bucket, count) cells of increments."""
    ts = idiv(F.col("ts_ns"), stride) * stride if stride else F.col("ts_ns")
    return df.where("count > 0").groupBy(*by, ts.alias("ts_ns"), "bucket").agg(F.sum("count").alias("count"))


def heatmap_max(df: DataFrame, columns: int = 500) -> DataFrame:
    """At most ``columns`` time columns, the greatest count of each cell; buckets one beyond those seen stay visible."""
    span = df.agg(F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"), F.min("bucket").alias("b0"), F.max("bucket").alias("b1"))
    d = df.join(F.broadcast(span))  # one row
    col = F.least(F.floor((F.col("ts_ns") - F.col("t0")) * columns / (F.col("t1") - F.col("t0") + 1)), F.lit(columns - 1)).cast("long")
    return d.groupBy(col.alias("col"), "bucket").agg(F.max("count").alias("count"), (F.first("b0") - 1).alias("from_bucket"), (F.first("b1") + 1).alias("to_bucket"))


def downsample(df: DataFrame, keys: Sequence[str], gp: int, to_gp: int) -> DataFrame:
    """Fewer, wider buckets of a lower grouping power."""
    start, _ = bucket_bounds(F.col("bucket"), gp)
    return df.withColumn("bucket", bucket_index(start, to_gp)).groupBy(*keys, "ts_ns", "bucket").agg(F.sum("count").alias("count"))


def summaries(df: DataFrame, keys: Sequence[str], gp: int, qs: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Percentiles of increments as gauges with a ``percentile`` label."""
    return quantiles(df, keys, gp, qs).select(*keys, "ts_ns", F.concat(F.lit("p"), F.regexp_replace(F.regexp_replace((F.col("quantile") * 100).cast("decimal(10,4)").cast("string"), r"\.?0+$", ""), r"\.", "")).alias("percentile"), "value")


def from_le(df: DataFrame, keys: Sequence[str], gp: int = 7) -> DataFrame:
    """Log-linear buckets from cumulative ``le`` buckets (keys, ts_ns, le, cum) with the histogram's ``mvp``.

    Only finite bounds count; seconds become ns, other bounds are lifted by the power of ten that brings the least
    positive one to 1 or more, and cut to whole numbers, those below 0 to 0. All buckets of a histogram share one mvp.
    """
    finite = df.where(F.abs("le") < float("inf"))
    of = Window.partitionBy(*keys, "ts_ns")
    least = F.min(F.when(F.col("le") > 0, F.col("le"))).over(of)
    guess = F.greatest(F.ceil(-F.log10("__least")), F.lit(0)).cast("double")
    ten = lambda n: F.pow(F.lit(10.0), n)
    power = F.when(F.col("__least") * ten(guess) < 1, ten(guess + 1)).when((guess > 0) & (F.col("__least") * ten(guess - 1) >= 1), ten(guess - 1)).otherwise(ten(guess))
    scale = F.when(F.col("metric").endswith("_seconds"), F.lit(1e9)).otherwise(F.coalesce(power, F.lit(1.0)))
    before = F.coalesce(F.lag("cum").over(of.orderBy("le")), F.lit(0))
    d = finite.withColumns({"__least": least, "__n": F.greatest(F.col("cum") - before, F.lit(0)).cast("long")})
    d = d.withColumn("__at", F.greatest(F.floor(F.col("le") * scale), F.lit(0)).cast("long"))
    d = d.withColumn("__top", F.max("__at").over(of))
    mvp = F.greatest(F.lit(8), F.least(F.lit(64), F.when(F.col("__top") < 2, 1).otherwise(F.length(F.bin(F.col("__top") - 1)) + 1)))
    return d.where("__n > 0").groupBy(*keys, "ts_ns", bucket_index(F.col("__at"), gp).alias("bucket")).agg(F.sum("__n").alias("count"), F.max(mvp).alias("mvp"))
