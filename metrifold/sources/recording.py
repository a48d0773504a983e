"""Recordings as they lie on disk: wide Parquet whose columns are series, named and labelled in the files' footers.

Spark's reader gives the values but drops the field metadata, where a series' metric, kind, labels and bucket layout
stand. ``footers`` reads that metadata as a Spark job: the files are listed as a DataFrame and each task opens its files at
the tail only. The values go through one unpivot for each class of column, so nothing passes through a double that is
not one: counters stay decimal(20,0), as Spark reads unsigned 64-bit numbers, until an operator has taken their
differences; bucket lists stay lists of such numbers; window sidecars are rows' begin and width.

Columns: ``timestamp`` (ns) and ``duration`` belong to the row; ``:wall_offset``, ``:window_begin`` and ``:window_width`` to the
table; ``<series>:window_begin`` (an offset from the timestamp) and ``<series>:window_width`` to a series, whose own window wins;
``<series>:buckets``, or any list, is a histogram, which is left out without both powers of its layout. In a combined
recording a name is ``node::series``. All that the metadata says besides name, kind, unit, description and layout is a label.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of field metadata that are no labels; fixed values.
PLAIN = ("metric", "metric_type", "unit", "description", "grouping_power", "max_value_power", "PARQUET:field_id")
_ROW = ("timestamp", "duration")
_WIDE = T.DecimalType(20, 0)
_FOOTER = "file string, rows long, start_ns decimal(20,0), end_ns decimal(20,0), place int, column string, arrow_type string, meta map<string,string>"
_SPARK_KEY = b"org.apache.spark.sql.parquet.row.metadata"


def _fields(schema: pa.Schema) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Name, type and metadata of each field: as Arrow wrote it, or as Spark did, whose writer keeps it in a document of its own."""
    own: dict[str, dict] = {}
    if _SPARK_KEY in (schema.metadata or {}):
        own = {f["name"]: f.get("metadata") or {} for f in json.loads(schema.metadata[_SPARK_KEY])["fields"]}
    for f in schema:
        meta = {k.decode(): v.decode() for k, v in (f.metadata or {}).items()} | {k: v if isinstance(v, str) else json.dumps(v) for k, v in own.get(f.name, {}).items()}
        meta.pop("PARQUET:field_id", None)
        yield f.name, str(f.type), meta


def _read_footer(path: str) -> Iterator[tuple]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    with system.open_input_file(inside) as f:
        found = pq.ParquetFile(f)
        schema, meta = found.schema_arrow, found.metadata
        at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}.get("timestamp")
        seen = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)] if at is not None else []
        seen = [s for s in seen if s is not None and s.has_min_max and isinstance(s.min, int)]
        low, high = (min(s.min for s in seen), max(s.max for s in seen)) if seen else (None, None)
        spark = schema.with_metadata({**(schema.metadata or {}), **{k: v for k, v in (meta.metadata or {}).items() if k == _SPARK_KEY}})
        for place, (name, kind, own) in enumerate(_fields(spark)):
            yield path, meta.num_rows, low, high, place, name, kind, own


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, start_ns, end_ns, place, column, arrow_type, meta): a row for each column of each file.

    Only the ends of files are read, by the file systems that Arrow knows (local, HDFS, S3, GCS, Azure).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    schema = pa.schema([("file", pa.string()), ("rows", pa.int64()), ("start_ns", pa.decimal128(20, 0)), ("end_ns", pa.decimal128(20, 0)), ("place", pa.int32()), ("column", pa.string()), ("arrow_type", pa.string()), ("meta", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("path").to_pylist():
                rows = list(_read_footer(at.replace("file:///", "file:/").replace("file:/", "file:///")))
                columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in schema]
                columns[7] = [list(m.items()) for m in columns[7]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return files.mapInArrow(run, _FOOTER)


def _power(key: str) -> Column:
    """A layout's power, where the metadata has one that fits a byte."""
    p = F.try_element_at("meta", F.lit(key)).try_cast("int")
    return F.when(p.between(0, 255), p)


def catalog_of(footer: DataFrame) -> DataFrame:
    """(file, column, metric, kind, labels, unit, gp, mvp) of the series columns; kinds as the metadata says, else by the column's type.

    A name ``prefix::series`` is the series'; the labels say which node or instance it is of.
    """
    is_list, given = F.col("arrow_type").startswith("list") | F.col("arrow_type").startswith("large_list"), F.try_element_at("meta", F.lit("metric_type"))
    sidecar = F.col("column").rlike(r"(^|:):?(window_begin|window_width|wall_offset)$")
    base = F.regexp_replace(F.element_at(F.split("column", "::"), -1), ":buckets$", "")
    kind = F.when(is_list | (given == "histogram"), "histogram").when(given.isin("counter", "gauge"), given).when(F.col("arrow_type") == "uint64", "counter").when(F.col("arrow_type").startswith("decimal"), "counter").otherwise("gauge")
    d = footer.where(~F.col("column").isin(*_ROW) & ~sidecar & (F.coalesce(given, F.lit("")) != "timestamp"))
    d = d.select("file", "column", F.coalesce(F.try_element_at("meta", F.lit("metric")), base).alias("metric"), kind.alias("kind"), F.map_filter("meta", lambda k, v: ~k.isin(*PLAIN)).alias("labels"), F.try_element_at("meta", F.lit("unit")).alias("unit"), _power("grouping_power").alias("gp"), _power("max_value_power").alias("mvp"))
    return d.where((F.col("kind") != "histogram") | (F.col("gp").isNotNull() & F.col("mvp").isNotNull()))


def series_catalog(catalog: DataFrame) -> DataFrame:
    """(metric, kind, label_names, series): the names by kind with the union of their label names and how many series they have."""
    one = catalog.select("metric", "kind", F.array_sort(F.map_entries("labels")).alias("l")).distinct()
    names = one.select("metric", "kind", "l", F.explode_outer(F.transform("l", lambda e: e["key"])).alias("name"))
    return names.groupBy("metric", "kind").agg(F.array_sort(F.collect_set("name")).alias("label_names"), F.countDistinct("l").alias("series"))


def tables_of(footer: DataFrame) -> DataFrame:
    """(file, rows, columns, start_ns, end_ns) of each file without reading a row."""
    return footer.groupBy("file").agg(F.max("rows").alias("rows"), F.count("*").alias("columns"), F.max("start_ns").cast("long").alias("start_ns"), F.max("end_ns").cast("long").alias("end_ns"))


@dataclass
class Recording:
    """``catalog`` and long samples by class, each with metric, labels, file, ts_ns, wall_offset, window_begin_ns and window_width_ns (null without a window).

    ``counters`` have value decimal(20,0), ``gauges`` value double, ``histograms`` gp, mvp and buckets array<decimal(20,0)>.
    """

    catalog: DataFrame
    counters: DataFrame
    gauges: DataFrame
    histograms: DataFrame

    def samples(self) -> DataFrame:
        """Counters and gauges together, values as doubles: for display, not for differences of large counters."""
        return self.counters.withColumn("value", F.col("value").cast("double")).withColumn("kind", F.lit("counter")).unionByName(self.gauges.withColumn("kind", F.lit("gauge")))


def _unpivoted(df: DataFrame, names: Sequence[str], kind: T.DataType) -> DataFrame:
    """(file, column, ts_ns, wall_offset, value, window_begin_ns, window_width_ns) of columns of one class."""
    have = set(df.columns)
    quoted = lambda c: F.col(f"`{c}`")

    def side(name: str, what: str) -> Column:
        prefix, _, bare = name.rpartition("::")
        table = [f"{prefix}:::{what}"] if prefix else []
        found = [quoted(c).cast("long") for c in (f"{name.removesuffix(':buckets')}:{what}", *table, f":{what}") if c in have]
        return F.coalesce(*found) if found else F.lit(None).cast("long")

    fixed = [F.col("_metadata.file_path").alias("file"), quoted("timestamp").cast("long").alias("ts_ns"), (quoted(":wall_offset").cast("long") if ":wall_offset" in have else F.lit(None).cast("long")).alias("wall_offset")]
    if not names:
        return df.select(*fixed).limit(0).select("file", F.lit("").alias("column"), "ts_ns", "wall_offset", F.lit(None).cast(kind).alias("value"), *(F.lit(None).cast("long").alias(c) for c in ("window_begin_ns", "window_width_ns")))
    packed = [F.struct(quoted(c).cast(kind).alias("value"), side(c, "window_begin").alias("begin"), side(c, "window_width").alias("width")).alias(c) for c in names]
    long = df.select(*fixed, *packed).unpivot(["file", "ts_ns", "wall_offset"], [f"`{c}`" for c in names], "column", "x").where("x.value is not null")
    whole = F.col("x.begin").isNotNull() & F.col("x.width").isNotNull()
    return long.select("file", "column", "ts_ns", "wall_offset", "x.value", F.when(whole, F.col("ts_ns") + F.col("x.begin")).alias("window_begin_ns"), F.when(whole, F.col("x.width")).alias("window_width_ns"))


def read_recording(spark: SparkSession, path: str, metrics: Sequence[str] | None = None) -> Recording:
    """The recording at ``path``, one or many files; of ``metrics`` only, then only their columns are read.

    The class of a column is its type in Parquet and its kind in the catalog; the driver holds the column names, as the plan does.
    """
    df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    catalog = catalog_of(footers(spark, path))
    if metrics is not None:
        catalog = catalog.where(F.col("metric").isin(*metrics))
    catalog = catalog.withColumn("file", F.regexp_replace("file", "^file:/+", "file:///"))
    known = {r["column"]: r["kind"] for r in catalog.groupBy("column").agg(F.min("kind").alias("kind")).collect()}  # as many as the table's columns
    of = lambda kind: [c for c in df.columns if known.get(c) == kind]

    def named(long: DataFrame, *more: str) -> DataFrame:
        long = long.withColumn("file", F.regexp_replace("file", "^file:/+", "file:///"))
        return long.join(catalog.select("file", "column", "metric", "labels", *more), ["file", "column"]).drop("column")

    histograms = named(_unpivoted(df, of("histogram"), T.ArrayType(_WIDE)), "gp", "mvp").withColumnRenamed("value", "buckets")
    return Recording(catalog, named(_unpivoted(df, of("counter"), _WIDE)), named(_unpivoted(df, of("gauge"), T.DoubleType())), histograms)


def read_tables(spark: SparkSession, **paths: str) -> Recording:
    """Per-sampler tables as one source: ``table`` names the sampler, ``segment`` counts a table's files in the order of their first times."""
    parts: list[Recording] = []
    for name, path in paths.items():
        r = read_recording(spark, path)
        order = tables_of(footers(spark, path)).withColumn("file", F.regexp_replace("file", "^file:/+", "file:///"))
        ranks = order.agg(F.array_sort(F.collect_list(F.struct("start_ns", "file"))).alias("files")).select(F.posexplode("files").alias("segment", "f")).select("segment", F.col("f.file").alias("file"))  # one row for each file

        def placed(d: DataFrame, name: str = name, ranks: DataFrame = ranks) -> DataFrame:
            return d.join(ranks, "file").withColumn("table", F.lit(name))

        parts.append(Recording(placed(r.catalog), placed(r.counters), placed(r.gauges), placed(r.histograms)))
    out = parts[0]
    for p in parts[1:]:
        out = Recording(*(a.unionByName(b) for a, b in ((out.catalog, p.catalog), (out.counters, p.counters), (out.gauges, p.gauges), (out.histograms, p.histograms))))
    return out


def described(column: Column, name: str, metric: str, kind: str, labels: dict[str, str] | None = None, **layout: int | str) -> Column:
    """A column of a wide recording with the metadata that ``read_recording`` reads back; Spark's writer keeps it in the footer."""
    return column.alias(name, metadata={"metric": metric, "metric_type": kind, **(labels or {}), **{k: str(v) for k, v in layout.items()}})


def sparse(histograms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ts_ns, bucket, count) of the buckets that hold something."""
    out = histograms.select(*keys, "ts_ns", F.posexplode("buckets").alias("bucket", "count")).where("count > 0")
    return out.withColumns({"bucket": F.col("bucket").cast("long"), "count": F.col("count").cast("long")})
