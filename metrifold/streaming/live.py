"""Structured Streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from metrifold.operators.base import idiv
from metrifold.operators.histogram import bucket_bounds


def with_time(sdf: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return sdf.withColumn("ts", F.timestamp_micros(idiv(F.col("ts_ns"), 1000))).withWatermark("ts", delay)


def ingest_stream(sdf: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes"):
    """Append live samples, each row once, to a Parquet table."""
    d = dedup_stream(sdf, ["metric", "series", "ts_ns"], delay)
    return d.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def dedup_stream(sdf: DataFrame, keys: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """Rows whose keys have not been seen within the watermark."""
    return with_time(sdf, delay).dropDuplicatesWithinWatermark(list(keys))


def _timeout(ttl_ms: int | None) -> str:
    """State of a series that stays silent for ``ttl_ms`` of processing time is dropped; without it state stays. For running queries: a trigger of availableNow would not end with it."""
    return GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout


def _columns(batches: Iterator[pd.DataFrame], **kinds: type) -> list[np.ndarray]:
    """The named columns of a series' rows as arrays of numbers; the frames they come in are not kept."""
    parts = [[np.array(b[name], kind) for name, kind in kinds.items()] for b in batches]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


#: Rows of a frame that a state function gives.
_PIECE = 8192


def _pieces(n: int, size: int) -> Iterator[slice]:
    return (slice(i, i + size) for i in range(0, n, size))


#: Groups of series that share a call and its state.
BUCKETS = 4096


def stream_rate(sdf: DataFrame, key: str = "series", ttl_ms: int | None = None) -> DataFrame:
    """Reset-aware rate of each series; the last sample is kept in state, older rows than it are passed over.

    Series are dealt to ``BUCKETS`` by hash, for a call a series costs more than its rows. A bucket's state holds the last sample of each
    of its series and the time that it was last heard of; what is silent for ``ttl_ms`` goes when the bucket is next called.
    """

    def rates(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if ttl_ms else 0
        names, ts, values, heard = state.get if state.exists else ([], [], [], [])
        held = pd.DataFrame({key: pd.Series(names, dtype=object), "ts_ns": np.array(ts, np.int64), "value": np.array(values, np.float64), "heard": np.array(heard, np.int64), "new": False})
        if ttl_ms:
            held = held[held["heard"] + ttl_ms > now]
        rows = held if state.hasTimedOut else pd.concat([held, *(b.assign(heard=now, new=True) for b in batches if len(b))], ignore_index=True)
        # of equal times the first counts; the held sample stands before new ones of its time
        at = pd.factorize(rows[key], use_na_sentinel=False)[0]
        order = np.lexsort((rows["ts_ns"], at))
        rows, at = rows.iloc[order], at[order]
        ts, values, new, heard = rows["ts_ns"].to_numpy(np.int64), rows["value"].to_numpy(float), rows["new"].to_numpy(bool), rows["heard"].to_numpy(np.int64)
        begins = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
        starts = np.flatnonzero(begins)
        latest = np.maximum.reduceat(heard, starts) if len(starts) else heard
        floor = np.full(len(begins) and at[-1] + 1, np.iinfo(np.int64).min)
        floor[at[~new]] = ts[~new]
        later = ~new | (ts > floor[at])
        keep = later & (begins | np.concatenate([[True], ts[1:] != ts[:-1]])[: len(ts)] | ~new)
        who, ts, values, new, series = at[keep], ts[keep], values[keep], new[keep], rows[key].to_numpy(object)[keep]
        same = who[1:] == who[:-1]
        last = np.concatenate([~same, [True]])[: len(who)]
        if len(who):
            state.update((series[last].tolist(), ts[last].tolist(), values[last].tolist(), latest.tolist()))
            if ttl_ms:
                state.setTimeoutDuration(ttl_ms)
        elif state.exists:
            state.remove()
        v, before = values[1:], values[:-1]
        with np.errstate(invalid="ignore", divide="ignore"):
            rate = np.where(v < before, v, v - before) / (np.where(same, np.diff(ts), 1) / 1e9)
        for piece in _pieces(len(same), _PIECE):
            there = np.flatnonzero(same[piece]) + piece.start
            yield pd.DataFrame({key: series[1:][there], "ts_ns": ts[1:][there], "value": rate[there]})

    d = sdf.select(F.col(key).cast("string").alias(key), "ts_ns", F.col("value").cast("double").alias("value")).where("ts_ns is not null")
    d = d.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    held = f"{key} array<string>, ts array<long>, v array<double>, heard array<long>"
    return d.groupBy("__bucket").applyInPandasWithState(rates, f"{key} string, ts_ns long, value double", held, "append", _timeout(ttl_ms))


def stream_cusum(sdf: DataFrame, baseline: DataFrame, key: str = "series", k: float = 1.0, h: float = 6.0, ttl_ms: int | None = None) -> DataFrame:
    """Alarms of the two-sided CUSUM against a frozen baseline (key, mean, sd): two sums of state for each series; the one that alarms starts anew."""

    def alarms(s: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        up, down = state.get if state.exists else (0.0, 0.0)
        out = []
        rows = pd.concat(list(batches)).sort_values("ts_ns")
        for ts, z in zip(rows["ts_ns"].tolist(), rows["z"].tolist(), strict=True):
            up, down = max(0.0, up + z - k), max(0.0, down - z - k)
            if up > h:
                out.append((s[0], ts, "up"))
                up = 0.0
            if down > h:
                out.append((s[0], ts, "down"))
                down = 0.0
        state.update((up, down))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=[key, "ts_ns", "side"])

    d = sdf.join(baseline.where("sd > 0"), key).select(F.col(key).cast("string").alias(key), "ts_ns", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"))
    return d.groupBy(key).applyInPandasWithState(alarms, f"{key} string, ts_ns long, side string", "up double, down double", "append", _timeout(ttl_ms))


def _grown(samples: Column) -> Column:
    """What a counter's samples (ts_ns, value) in order add up to; a fall is a reset, after which the value itself counts."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        more = F.when(acc["last"].isNull(), 0.0).when(x["v"] < acc["last"], x["v"]).otherwise(x["v"] - acc["last"])
        return F.struct(x["v"].alias("last"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(samples, start, step, lambda acc: acc["sum"])


def stream_summary(sdf: DataFrame, interval: str, keys: Sequence[str] = ("series",), delay: str = "10 minutes") -> DataFrame:
    """Each interval's increase (resets adjusted), last and mean by series; a window holds its own samples until it closes."""
    v = F.col("value").cast("double")
    samples = F.array_sort(F.collect_list(F.struct("ts_ns", v.alias("v"))))
    d = with_time(sdf, delay).groupBy(F.window("ts", interval), *keys).agg(samples.alias("s"), F.max_by("value", "ts_ns").alias("last"), F.avg("value").alias("mean"), F.count("*").alias("n"))
    return d.select("window", *keys, _grown(F.col("s")).alias("increase"), "last", "mean", "n")


def stream_histogram_summary(sdf: DataFrame, interval: str, gp: int, keys: Sequence[str] = ("series",), qs: Sequence[float] = (0.5, 0.9, 0.99), delay: str = "10 minutes") -> DataFrame:
    """Percentiles of what an interval adds to cumulative histograms (``buckets``, dense arrays): the last snapshot less the first, or the last alone after a reset."""
    d = with_time(sdf, delay).groupBy(F.window("ts", interval), *keys).agg(F.min_by("buckets", "ts_ns").alias("a"), F.max_by("buckets", "ts_ns").alias("b"), F.count("*").alias("n"))
    less = F.zip_with("b", "a", lambda x, y: x - F.coalesce(y, F.lit(0)))
    d = d.withColumn("added", F.when(F.exists(less, lambda x: x < 0), F.col("b")).otherwise(less))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("run"))
    grow = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["run"], F.array(acc["sum"] + x)).alias("run"))
    d = d.withColumn("run", F.aggregate("added", start, grow)["run"]).withColumn("total", F.element_at("run", -1))
    at = lambda q: F.size(F.filter("run", lambda c: c < F.greatest(F.ceil(F.lit(q) * F.col("total")), F.lit(1)))).cast("long")
    ends = [F.when(F.col("total") > 0, bucket_bounds(at(q), gp)[1].cast("double")).alias(f"p{q * 100:g}".replace(".", "_")) for q in qs]
    return d.select("window", *keys, F.col("total").alias("added"), *ends)


def cumulative_histograms(sdf: DataFrame, key: str, n: int) -> DataFrame:
    """A snapshot of each series' counts so far (``buckets``) with every sample's ``bucket``: an array of state for each series."""
    size = _PIECE

    def snapshots(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = np.array(state.get[0] if state.exists else [0] * n, np.int64)
        ts, bucket = _columns(batches, ts_ns=np.int64, bucket=np.int32)
        order = np.argsort(ts, kind="stable")
        for piece in _pieces(len(ts), size):
            at = order[piece]
            run = counts + np.cumsum(bucket[at][:, None] == np.arange(n), axis=0)
            counts = run[-1]
            yield pd.DataFrame({key: k[0], "ts_ns": ts[at], "buckets": list(run)})
        state.update((counts.tolist(),))

    return sdf.select(key, "ts_ns", "bucket").groupBy(key).applyInPandasWithState(snapshots, f"{key} string, ts_ns long, buckets array<long>", "counts array<long>", "append", GroupStateTimeout.NoTimeout)


AGGS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def stream_window(sdf: DataFrame, width: str, slide: str, fn: str = "avg", keys: Sequence[str] = ("series",), delay: str = "10 minutes") -> DataFrame:
    return with_time(sdf, delay).groupBy(F.window("ts", width, slide), *keys).agg(AGGS[fn]("value").alias("value"))


def retain(df: DataFrame, lookback_ns: int) -> DataFrame:
    """Rows no older than the lookback before the newest row."""
    newest = df.agg(F.max("ts_ns").alias("__n"))  # one row
    return df.join(F.broadcast(newest), F.col("ts_ns") > F.col("__n") - lookback_ns).drop("__n")


def snapshot(df: DataFrame, start: int | None = None, end: int | None = None, last: int | None = None) -> DataFrame:
    from metrifold.operators.select import time_range

    return time_range(df, start, end, last)


def stream_jitter(sdf: DataFrame, key: str = "series", ttl_ms: int | None = None) -> DataFrame:
    """Gap to the last sample in ms, from state."""
    size = _PIECE

    def gaps(s: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (ts,) = _columns(batches, ts_ns=np.int64)
        ts.sort()
        newest = int(ts[-1])
        if state.exists:
            last = state.get[0]
            newest, ts = max(last, newest), np.concatenate([[last], ts[ts >= last]])
        for piece in _pieces(len(ts) - 1, size):
            at = ts[piece.start : piece.stop + 1]
            yield pd.DataFrame({key: s[0], "ts_ns": at[1:], "gap_ms": np.diff(at) / 1e6})
        state.update((newest,))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    return sdf.select(F.col(key).cast("string").alias(key), "ts_ns").groupBy(key).applyInPandasWithState(gaps, f"{key} string, ts_ns long, gap_ms double", "last long", "append", _timeout(ttl_ms))


def latest_with_ttl(df: DataFrame, keys: Sequence[str], ttl_ns: int, reserved: DataFrame, cap: int) -> DataFrame:
    """The latest value of each (metric, labels) not older than the TTL before the newest row; reserved names are refused, and the newest ``cap`` series held."""
    d = df.join(reserved.select("metric"), "metric", "left_anti")
    latest = d.groupBy("metric", *keys).agg(F.max_by("value", "ts_ns").alias("value"), F.max("ts_ns").alias("ts_ns"))
    return retain(latest, ttl_ns + 1).orderBy(F.desc("ts_ns"), "metric", *keys).limit(cap)
