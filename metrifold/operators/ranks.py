"""Exact order statistics of long series without sorting them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPARE, _ACCURACY = 2e-4, 10_000


def order_statistics(df: DataFrame, keys: Sequence[str], column: Column, between: tuple[float, float], ranks: dict[str, Column]) -> DataFrame:
    """(keys, n, a column for each of ``ranks``): exact order statistics; a rank is told from ``n`` and counts from 1.

    ``between`` are the least and the greatest share of n that the ranks stand at. A mergeable summary brackets them
    (its ranks are off by 1 / _ACCURACY at most, the bracket is twice as wide), and one more pass counts what lies below
    the bracket and each distinct value inside it: no series is sorted or held, and ties cost one row.
    """
    v = df.select(*keys, column.cast("double").alias("__v")).where("__v is not null")
    low, high = max(0.0, between[0] - _SPARE), min(1.0, between[1] + _SPARE)
    ends = v.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("__v", [low, high], _ACCURACY).alias("__e"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    # a short series is bracketed by its ends, and so is one whose summary may be off by a whole rank
    short = F.col("n") < _ACCURACY
    ends = ends.select(F.struct(*keys).alias("__k"), "n", F.when(short, F.col("__least")).otherwise(F.col("__e")[0]).alias("__lo"), F.when(short, F.col("__most")).otherwise(F.col("__e")[1]).alias("__hi"))
    near = v.withColumn("__k", F.struct(*keys)).join(ends, "__k").where(F.col("__v") <= F.col("__hi"))
    counts = near.groupBy(*keys, "n", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")).alias("__v")).agg(F.count("*").alias("__m"))
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__v"))
    counts = counts.withColumn("__cum", F.sum("__m").over(w))
    return counts.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("__cum") >= rank, F.struct("__cum", "__v")))["__v"].alias(name) for name, rank in ranks.items()])
