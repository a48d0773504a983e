"""Shared window and column helpers of the operators.

Samples are long: key columns, ``ts_ns`` (nanoseconds since the epoch, authoritative), ``value``, and where a
measurement band is known ``lo`` and ``hi``. Every operator takes the key columns that name a series.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

SECOND = 1_000_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86400 * SECOND


def series(keys: Sequence[str]) -> WindowSpec:
    """A series in time order."""
    return Window.partitionBy(*keys).orderBy("ts_ns")


def whole(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def has_band(df: DataFrame) -> bool:
    return {"lo", "hi"} <= set(df.columns)


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_zero(c: Column) -> Column:
    return F.when(finite(c), c).otherwise(F.lit(0.0))


def same(keys: Sequence[str], a: DataFrame, b: DataFrame) -> Column:
    """Equality of all keys, null matching null."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def idiv(c: Column, n: int | Column) -> Column:
    """Whole-number division; times in nanoseconds are beyond what doubles hold exactly."""
    return F.call_function("div", c, n if isinstance(n, Column) else F.lit(n))


def idiv_up(c: Column, n: int) -> Column:
    return idiv(c + F.lit(n - 1), n)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master without that setting one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its plan is not repeated by each reader, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(*steps: Callable[[], object]) -> list:
    """What each of ``steps`` gives, run side by side: jobs of short series leave most cores idle one by one."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [running.result() for running in [pool.submit(step) for step in steps]]


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[dict, pa.RecordBatch], pa.RecordBatch], schema: str, arrow: pa.Schema) -> DataFrame:
    """A sequential fold of each series over its sorted rows: ``step(state, rows)`` sees a series' rows in pieces and gives rows with the keys.

    A series streams through one task in Arrow batches with a state of fixed size, so its length bounds time and not memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, {}
        for batch in batches:
            at = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if batch.num_rows else []
            start = 0
            for i in [*[i for i in range(1, len(at)) if at[i] != at[i - 1]], len(at)] if at else []:
                if at[start] != now:
                    now, state = at[start], {}
                out = step(state, batch.slice(start, i - start))
                if out.num_rows:
                    yield pa.RecordBatch.from_arrays([out.column(f.name).cast(f.type) for f in arrow], schema=arrow)
                start = i

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
