"""A rolling buffer of live samples and the latest value of each series, as streams.

``rolling_buffer`` writes each micro-batch into partitions by time slot, a folder for each batch id, so that a batch that
runs again replaces itself; slots that lie wholly beyond the lookback, measured from the newest row seen, are
removed. ``latest_stream`` holds one value a series in state (``transformWithState``, RocksDB) and drops it by an event-time
timer once the watermark is a time-to-live beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from metrifold.operators.base import idiv

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folders(spark: SparkSession, path: str) -> tuple[object, list]:
    """The file system of a path, whichever store it is in, and the folders there."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, [s.getPath() for s in system.listStatus(at) if s.isDirectory()] if system.exists(at) else []


def store_batch(batch: DataFrame, batch_id: int, path: str, slot_ns: int, lookback_ns: int) -> None:
    """One micro-batch: its rows under batch=<id>/slot=<n>, in place of what an earlier run of it left; then old slots go."""
    spark = batch.sparkSession
    rows = batch.withColumn("slot", idiv(F.col("ts_ns"), slot_ns))
    rows.repartition("slot").sortWithinPartitions("slot", "ts_ns").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/batch={batch_id}")
    system, batches = _folders(spark, path)
    slots = [(int(s.getName().split("=")[1]), s, b) for b in batches if b.getName().startswith("batch=") for s in _folders(spark, b.toString())[1] if s.getName().startswith("slot=")]
    if not slots:
        return
    newest = spark.read.parquet(path).where(F.col("slot") == max(n for n, _, _ in slots)).agg(F.max("ts_ns")).first()[0]
    first = (newest - lookback_ns) // slot_ns  # the slot of the oldest time that is kept
    for n, slot, _ in slots:
        if n < first:
            system.delete(slot, True)
    for b in {b.toString(): b for _, _, b in slots}.values():
        if b.getName() != f"batch={batch_id}" and not _folders(spark, b.toString())[1]:
            system.delete(b, True)


def rolling_buffer(sdf: DataFrame, path: str, checkpoint: str, slot_ns: int, lookback_ns: int, available_now: bool = True):
    """A running query that keeps the rows of ``sdf`` (ts_ns, ...) for ``lookback_ns`` before the newest one."""
    w = sdf.writeStream.foreachBatch(lambda batch, i: store_batch(batch, i, path, slot_ns, lookback_ns)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def buffer_snapshot(spark: SparkSession, path: str, schema: str, slot_ns: int, start: int | None = None, end: int | None = None, last: int | None = None, lookback_ns: int | None = None) -> DataFrame:
    """The buffer's rows in [start, end], or the ``last`` ns before the newest; only their slots are read. With the lookback, rows beyond it in its oldest slot are left out too."""
    d = spark.read.schema(f"{schema}, batch long, slot long").parquet(path)
    if last is not None or lookback_ns is not None:
        newest = d.agg(F.max("slot")).first()[0]
        newest = d.where(F.col("slot") == newest).agg(F.max("ts_ns")).first()[0] if newest is not None else 0
        start = max(x for x in (start, None if last is None else newest - last, None if lookback_ns is None else newest - lookback_ns + 1) if x is not None)
    if start is not None:
        d = d.where((F.col("slot") >= start // slot_ns) & (F.col("ts_ns") >= start))
    if end is not None:
        d = d.where((F.col("slot") <= end // slot_ns) & (F.col("ts_ns") <= end))
    return d.drop("batch", "slot")


class Latest(StatefulProcessor):
    """One value of state: the newest (ts_ns, value); its timer removes it unless a newer one has come."""

    def __init__(self, names: Sequence[str], ttl_ms: int):
        self.names, self.ttl_ms = list(names), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ts_ns long, value double")

    def _row(self, key: tuple, ts: int, value: float | None, gone: bool) -> pd.DataFrame:
        return pd.DataFrame([(*key, ts, value, gone)], columns=[*self.names, "ts_ns", "value", "expired"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.latest.get() if self.latest.exists() else None
        best = held
        for part in rows:  # a micro-batch may come in parts; none is kept
            i = part["ts_ns"].idxmax()
            if best is None or part["ts_ns"][i] > best[0]:
                best = (int(part["ts_ns"][i]), float(part["value"][i]))
        if best is not held:
            if held is not None:
                self.handle.deleteTimer(held[0] // 1_000_000 + self.ttl_ms)
            self.latest.update(best)
            self.handle.registerTimer(best[0] // 1_000_000 + self.ttl_ms)
            yield self._row(key, best[0], best[1], False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, _ = self.latest.get()
        self.latest.clear()
        yield self._row(key, ts, None, True)

    def close(self) -> None:
        pass


def latest_stream(sdf: DataFrame, keys: Sequence[str], ttl_ms: int, reserved: Sequence[str] = (), delay: str = "10 minutes") -> DataFrame:
    """(keys, ts_ns, value, expired): a row whenever a series' latest value changes, and one when it is dropped. Rows of reserved metrics are refused.

    The state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass`` = ``ROCKSDB``).
    """
    d = sdf.where(~F.col("metric").isin(*reserved)) if reserved else sdf
    d = d.withColumn("ts", F.timestamp_micros(idiv(F.col("ts_ns"), 1000))).withWatermark("ts", delay)
    kinds = dict(d.dtypes)
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "ts_ns long, value double, expired boolean"])
    d = d.select(*keys, "ts", "ts_ns", F.col("value").cast("double").alias("value"))
    return d.groupBy(*keys).transformWithStateInPandas(statefulProcessor=Latest(keys, ttl_ms), outputStructType=out, outputMode="Append", timeMode="EventTime")


def newest_capped(changes: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """What stands now: each series' last change unless it is gone, the newest ``cap`` series."""
    now = changes.groupBy(*keys).agg(F.max_by(F.struct("value", "expired"), F.struct("ts_ns", "expired")).alias("x"), F.max("ts_ns").alias("ts_ns"))
    return now.where("not x.expired").select(*keys, "ts_ns", "x.value").orderBy(F.desc("ts_ns"), *keys).limit(cap)
