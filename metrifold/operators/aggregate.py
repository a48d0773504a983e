"""Aggregation across series and time, top-k and sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrifold.functions.scalar import consumer_name, last_rank
from metrifold.operators.ranks import order_statistics
from metrifold.operators.base import SECOND, finite, has_band, idiv, whole


def agg(df: DataFrame, fn: str, by: Sequence[str] = (), without: Sequence[str] | None = None, q: float = 0.5) -> DataFrame:
    """``fn`` across series at each time, kept by labels or without some; sums and means carry bands."""
    if without is not None:
        by = [c for c in df.columns if c not in {*without, "ts_ns", "value", "lo", "hi"}]
    g = df.groupBy(*by, "ts_ns")
    v = F.col("value")
    if fn in ("sum", "avg"):
        f = F.sum if fn == "sum" else F.avg
        band = [f("lo").alias("lo"), f("hi").alias("hi")] if has_band(df) else []
        return g.agg(f(v).alias("value"), *band)
    made = {"max": F.max(v), "min": F.min(v), "count": F.count(v), "stddev": F.stddev_pop(v), "stdvar": F.var_pop(v), "quantile": F.percentile(v, F.lit(q)), "group": F.lit(1.0)}
    return g.agg(made[fn].alias("value"))


def count_values(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "ts_ns", F.col("value").cast("string").alias(label)).agg(F.count("*").alias("value"))


def collapse(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One series from many: the sum in each rounded second."""
    second = idiv(F.col("ts_ns") + SECOND // 2, SECOND) * SECOND
    return df.groupBy(*keys, second.alias("ts_ns")).agg(F.sum("value").alias("value"))


def percentile_nearest(df: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Nearest-rank percentiles of finite values: the value at rank max(1, ceil(q n))."""
    d = df.where(finite(F.col("value")))
    found = order_statistics(d, keys, F.col("value"), (min(qs), max(qs)), {f"p{q * 100:g}".replace(".", "_"): last_rank(F.col("n"), q) for q in qs})
    return found.drop("n")


def summary_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """min, max, mean, last, p50 and p99 of finite values; zeros for a series without any."""
    d = df.where(finite(F.col("value")))
    stats = d.groupBy(*keys).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.max_by("value", "ts_ns").alias("last"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY value)").alias("p99"))
    return df.select(*keys).distinct().join(stats, list(keys), "left").na.fill(0.0, ["min", "max", "mean", "last", "p50", "p99"])


def label_values(catalog: DataFrame) -> DataFrame:
    """(key, n, values): the distinct values of each label key, sorted."""
    pairs = catalog.select(F.explode("labels").alias("key", "val")).distinct()
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("val")).alias("vals"))


def metric_info(catalog: DataFrame) -> DataFrame:
    """(metric, n_series, label_keys): counts by metric and the sorted union of label keys."""
    keys = catalog.select("metric", F.explode_outer(F.map_keys("labels")).alias("key")).distinct().groupBy("metric").agg(F.array_sort(F.collect_list("key")).alias("label_keys"))
    return catalog.groupBy("metric").agg(F.countDistinct("series_id").alias("n_series")).join(keys, "metric")


def uncertainty(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean band width against the movement of the values; a flat series has ratio 1."""
    g = df.groupBy(*keys).agg(F.avg(F.col("hi") - F.col("lo")).alias("band"), (F.max("value") - F.min("value")).alias("movement"))
    return g.withColumns({"ratio": F.when(F.col("movement") == 0, F.lit(1.0)).otherwise(F.try_divide("band", "movement")), "within_band": F.col("movement") <= F.col("band")})


def rank_consumers(df: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """Series of each domain by mean: mean, max and percent share of all means (taken before the cut), top ``n``."""
    d = df.where(finite(F.col("value"))).groupBy("domain", *keys, consumer_name(F.col("labels")).alias("name") if "labels" in df.columns else F.col("name")).agg(F.avg("value").alias("avg"), F.max("value").alias("max"))
    d = d.withColumn("share", F.coalesce(F.try_divide(F.col("avg") * 100, F.sum("avg").over(Window.partitionBy("domain"))), F.lit(0.0)))
    return top_n(d, n, by="avg", within=("domain",), tie="name")


def top_n(df: DataFrame, n: int, by: str, within: Sequence[str] = (), tie: str = "name") -> DataFrame:
    """The first ``n`` of each group by descending ``by``, ties by name; ``rank`` from 1.

    The global form sorts and takes ``n`` in one distributed pass before numbering.
    """
    order = (F.desc(by), F.asc(tie))
    if not within:
        df = df.orderBy(*order).limit(n)
    w = Window.partitionBy(*within).orderBy(*order) if within else Window.orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def topk(df: DataFrame, k: int, largest: bool = True) -> DataFrame:
    """The ``k`` largest (or smallest) series at each time."""
    order = F.desc("value") if largest else F.asc("value")
    ties = [c for c in df.columns if c not in ("value", "ts_ns", "lo", "hi")]
    return df.withColumn("__r", F.row_number().over(Window.partitionBy("ts_ns").orderBy(order, *ties))).where(F.col("__r") <= k).drop("__r")


def bottomk(df: DataFrame, k: int) -> DataFrame:
    return topk(df, k, largest=False)


def sort(df: DataFrame, desc: bool = False) -> DataFrame:
    return df.orderBy(F.desc("value") if desc else F.asc("value"))


def sort_bucket(df: DataFrame) -> DataFrame:
    return df.orderBy("metric", F.desc("avg"), "name")


def sort_catalog(df: DataFrame, keys: Sequence[str], desc: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*[F.desc(k) if k in desc else F.asc(k) for k in keys])


def find_metric(catalog: DataFrame, hint: str, n: int = 5) -> DataFrame:
    """Names by likeness to a hint: exact, then prefix, suffix or part of it; the first ``n``."""
    m, h = F.lower("metric"), hint.lower()
    rank = F.when(m == h, 0).when(m.startswith(h), 1).when(m.endswith(h), 2).when(m.contains(h), 3).when(F.lit(h).contains(m), 4)
    return catalog.select("metric").distinct().withColumn("how", rank).where("how is not null").orderBy("how", "metric").limit(n)


def union_tables(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def union_recordings(**recordings: DataFrame) -> DataFrame:
    """Recordings verbatim, each row with its recording's name."""
    return union_tables(*[d.withColumn("recording", F.lit(name)) for name, d in recordings.items()])


def common_buckets(*dfs: DataFrame, column: str = "bucket") -> DataFrame:
    out = dfs[0].select(column)
    for d in dfs[1:]:
        out = out.intersect(d.select(column))
    return out.distinct()


def absent_from(universe: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    return universe.join(present, list(on), "left_anti")


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def merge_metadata(*metas: DataFrame) -> DataFrame:
    """(source, descriptions): one map for each source; where documents differ the greatest text wins."""
    rows = union_tables(*[m.select("source", "metric", "description") for m in metas]).groupBy("source", "metric").agg(F.max("description").alias("description"))
    return rows.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "description")))).alias("descriptions"))
