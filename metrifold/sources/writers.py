"""Writing recordings, exposition text, reports and records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrifold.operators.base import idiv


def write_recording(df: DataFrame, path: str, keys: Sequence[str] = ("metric",), row_group_bytes: int = 1 << 20, by: Sequence[str] = ()) -> None:
    """Parquet ranged by time and sorted by series and time, in small row groups, so that time windows skip most of it."""
    d = df.repartitionByRange("ts_ns").sortWithinPartitions(*keys, "ts_ns")
    w = d.write.option("parquet.block.size", row_group_bytes).option("parquet.enable.dictionary", "false").option("compression", "lz4_raw")
    (w.partitionBy(*by) if by else w).parquet(path)


def to_wide(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One column for each of the named metrics; the list is explicit, so there is no job to find it."""
    return df.groupBy("ts_ns").pivot("metric", list(metrics)).agg(F.first("value"))


def _label_text(c: str = "labels"):
    pairs = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))


def to_prometheus_text(df: DataFrame) -> DataFrame:
    """(metric, line): a TYPE line and the samples of each metric with times in ms, distinct."""
    head = df.select("metric", F.lit(0).alias("o"), F.concat_ws(" ", F.lit("# TYPE"), "metric", "kind").alias("line")).distinct()
    body = df.select("metric", F.lit(1).alias("o"), F.concat(F.col("metric"), _label_text(), F.lit(" "), F.col("value").cast("string"), F.lit(" "), idiv(F.col("ts_ns"), 1_000_000).cast("string")).alias("line")).distinct()
    return head.unionByName(body).orderBy("metric", "o", "line").select("metric", "line")


def histogram_text(df: DataFrame, keys: Sequence[str], gp: int) -> DataFrame:
    """Cumulative ``le`` lines of sparse histograms with +Inf, count, and the sum at bucket ends."""
    from metrifold.operators.histogram import bucket_bounds

    _, end = bucket_bounds(F.col("bucket"), gp)
    w = Window.partitionBy(*keys, "ts_ns").orderBy("bucket")
    d = df.withColumns({"cum": F.sum("count").over(w), "end": end})
    name = F.concat_ws("_", *keys)
    at = F.concat(F.lit(" "), idiv(F.col("ts_ns"), 1_000_000).cast("string"))
    lines = d.select(*keys, "ts_ns", F.concat(name, F.lit('_distribution_bucket{le="'), F.col("end").cast("string"), F.lit('"} '), F.col("cum").cast("string"), at).alias("line"))
    total = d.groupBy(*keys, "ts_ns").agg(F.sum("count").cast("string").alias("n"), F.sum(F.col("count") * F.col("end")).cast("string").alias("s"))
    tails = total.select(*keys, "ts_ns", F.explode(F.array(F.concat(name, F.lit('_distribution_bucket{le="+Inf"} '), F.col("n"), at), F.concat(name, F.lit("_distribution_count "), F.col("n"), at), F.concat(name, F.lit("_distribution_sum "), F.col("s"), at))).alias("line"))
    return lines.unionByName(tails)


def write_overview(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.text(path)


def save_report(df: DataFrame, metrics: DataFrame, annotations: DataFrame, path: str) -> None:
    """Only the series that the chosen queries use, with annotations and a marker."""
    write_recording(df.join(metrics.select("metric").distinct(), "metric", "left_semi").withColumn("report", F.lit("trimmed")), f"{path}/samples")
    annotations.write.parquet(f"{path}/annotations")


def write_ab(df: DataFrame, path: str) -> None:
    """Both arms unmodified, with a one-row manifest."""
    write_recording(df, f"{path}/samples", by=("arm",))
    df.groupBy("arm").agg(F.count("*").alias("rows"), F.min("ts_ns").alias("start"), F.max("ts_ns").alias("end")).agg(F.sort_array(F.collect_list(F.struct("arm", "rows", "start", "end"))).alias("arms")).write.json(f"{path}/manifest")


def save_stream(sdf: DataFrame, path: str, checkpoint: str):
    """A running query that appends live samples."""
    return sdf.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def describe_recording(df: DataFrame, table: str = "table") -> DataFrame:
    """Rows, metrics, span and mean cadence of each table."""
    times = df.groupBy(table).agg(F.count("*").alias("rows"), F.countDistinct("metric").alias("metrics"), F.min("ts_ns").alias("start"), F.max("ts_ns").alias("end"), F.countDistinct("ts_ns").alias("n"))
    return times.withColumn("cadence_ns", F.try_divide((F.col("end") - F.col("start")).cast("double"), F.col("n") - 1)).drop("n")
