"""Scans over long series in two levels, so that no task holds a series.

A series is cut into chunks of about ``ROWS`` rows. Each chunk is folded by itself (one exchange, keyed by series and chunk), the
chunks' results, a row each, are carried over the series, and what is carried is added inside the chunks. A series of
n rows costs one window over n / ROWS rows in one task instead of one over n. Series shorter than a chunk are one chunk.

Chunks are runs of places where the order is ``idx``, and else slots of equal time whose number follows from the longest
series. The chunk key is ``__c`` and the series ``__k``, a struct, so that null keys meet in joins too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrifold.operators.base import idiv

ROWS = 65_536
_AT = ("__k", "__c")


def chunked(df: DataFrame, keys: Sequence[str], order: str = "ts_ns") -> DataFrame:
    """``df`` with its series ``__k`` and its chunk ``__c``."""
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    if order == "idx":
        return df.withColumns({"__k": key, "__c": idiv(F.col("idx"), ROWS)})
    longest = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("t0"), F.max(order).alias("t1")).agg(F.min("t0").alias("__t0"), F.max("t1").alias("__t1"), F.ceil(F.max("n") / ROWS).alias("__slots"))
    width = F.greatest(F.lit(1), idiv(F.col("__t1") - F.col("__t0"), F.col("__slots")) + 1)
    return df.join(F.broadcast(longest)).withColumns({"__k": key, "__c": idiv(F.col(order) - F.col("__t0"), width)}).drop("__t0", "__t1", "__slots")  # one row


def _inside(order: str):
    return Window.partitionBy(*_AT).orderBy(order)


def _over_chunks():
    return Window.partitionBy("__k").orderBy("__c")


def prefix_sums(d: DataFrame, sums: dict[str, Column], order: str = "ts_ns") -> DataFrame:
    """``d``, chunked, with the sum of each column up to and with the row; rows of equal order share theirs."""
    totals = d.groupBy(*_AT).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = _over_chunks().rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*_AT, *[F.sum(f"__t_{n}").over(before).alias(f"__o_{n}") for n in sums])
    run = d.withColumns({n: F.sum(c).over(_inside(order)) for n, c in sums.items()}).join(carry, list(_AT))
    return run.withColumns({n: F.coalesce(F.col(n) + F.col(f"__o_{n}"), F.col(n), F.col(f"__o_{n}")) for n in sums}).drop(*[f"__o_{n}" for n in sums])


def with_series(d: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``d``, chunked, with the other columns of ``stats`` (a row a series), joined by chunk: a join by series would bring each series into one task."""
    rest = [c for c in stats.columns if c not in keys]
    chunks = d.select(*_AT).distinct().join(stats.select(F.struct(*[F.col(k) for k in keys]).alias("__k"), *rest), "__k")
    return d.join(chunks, list(_AT))


def numbered(d: DataFrame, name: str, order: str = "ts_ns") -> DataFrame:
    """``d``, chunked, with the row's place in its series from 0."""
    sizes = d.groupBy(*_AT).agg(F.count("*").alias("__n"))
    carry = sizes.select(*_AT, F.coalesce(F.sum("__n").over(_over_chunks().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    return d.withColumn(name, F.row_number().over(_inside(order))).join(carry, list(_AT)).withColumn(name, (F.col("__o") + F.col(name) - 1).cast("long")).drop("__o")


def previous(d: DataFrame, names: dict[str, str], order: str = "ts_ns") -> DataFrame:
    """``d``, chunked, with columns of the row before: ``names`` maps new names to columns."""
    row = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
    lasts = d.groupBy(*_AT).agg(F.max_by(row, F.col(order)).alias("__l"))
    carry = lasts.select(*_AT, F.lag("__l").over(_over_chunks()).alias("__p"))
    out = d.withColumn("__b", F.lag(row).over(_inside(order))).join(carry, list(_AT)).withColumn("__b", F.coalesce("__b", "__p"))
    return out.select(*d.columns, *[F.col(f"__b.{n}").alias(n) for n in names])


def counter_sums(d: DataFrame) -> DataFrame:
    """``d``, chunked, with ``prev``, ``prev_ts``, ``delta`` and ``adj``: the increase since the row before, where after a fall the value itself counts, and its sum from the series' first row (0 there).

    What a chunk hands on is its first and last value and its increase inside; such elements join in order.
    """
    grown = lambda now, before: F.when(now < before, now).otherwise(now - before)
    w = _inside("ts_ns")
    d = d.withColumns({"prev": F.lag("value").over(w), "prev_ts": F.lag("ts_ns").over(w)})
    d = d.withColumn("delta", grown(F.col("value"), F.col("prev"))).withColumn("adj", F.sum(F.coalesce("delta", F.lit(0))).over(w))
    elements = d.groupBy(*_AT).agg(F.min_by("value", "ts_ns").alias("__f"), F.max_by(F.struct("value", "ts_ns"), "ts_ns").alias("__l"), F.sum(F.coalesce("delta", F.lit(0))).alias("__g"))
    elements = elements.withColumn("__p", F.lag("__l").over(_over_chunks())).withColumn("__s", F.coalesce(grown(F.col("__f"), F.col("__p.value")), F.lit(0)))
    up_to, before = _over_chunks().rowsBetween(Window.unboundedPreceding, 0), _over_chunks().rowsBetween(Window.unboundedPreceding, -1)
    carry = elements.select(*_AT, "__p", "__s", (F.sum("__s").over(up_to) + F.coalesce(F.sum("__g").over(before), F.lit(0))).alias("__o"))
    out = d.join(carry, list(_AT))
    first = F.col("prev_ts").isNull()
    out = out.withColumns({"adj": F.col("adj") + F.col("__o"), "delta": F.when(first, F.when(F.col("__p").isNotNull(), F.col("__s"))).otherwise(F.col("delta"))})
    out = out.withColumns({"prev": F.when(first, F.col("__p.value")).otherwise(F.col("prev")), "prev_ts": F.when(first, F.col("__p.ts_ns")).otherwise(F.col("prev_ts"))})
    return out.drop("__p", "__s", "__o")


def plain(d: DataFrame) -> DataFrame:
    return d.drop(*_AT)
