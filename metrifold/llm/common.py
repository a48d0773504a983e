"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; read by Spark alone, so any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master without that setting one of our own."""
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not path:
        own = spark.sparkContext.getCheckpointDir()
        if not own and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not own:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
            own = spark.sparkContext.getCheckpointDir()
        path = own
    return path.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Arrow batches of at most ``rows`` rows and about ``mb`` MB, so that long texts do not add up in a worker."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", mb << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def free_name(columns: list[str], wish: str) -> str:
    """``wish`` with as many underscores before it as make it a name that no column has (Spark does not tell cases apart)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column, None where null."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def rows_of(batches: Iterator[pa.RecordBatch], schema: pa.Schema, make) -> Iterator[pa.RecordBatch]:
    """``make(batch)`` gives a dict of columns for each batch; empty batches give nothing."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict(make(batch), schema=schema)
