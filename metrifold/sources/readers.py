"""Reading recordings, scrapes, annotations and templates into long tables; all as Spark jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrifold.functions.scalar import merge_labels

_SIDE = ("timestamp", "duration")
ANNOTATIONS = "timestamp string, ts string, description string, kind string, details string, source string, node string, instance string, labels map<string,string>, duration string, duration_ns long, id string, chart_id string"


def wide_to_long(df: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """(metric, ts_ns, value) of a wide table of unlabelled doubles with one column for each series; time, duration, window and offset columns are no metrics. Columns are chosen before the unpivot, so only they are read. Recordings with counters, lists, windows and labels are read by ``recording``."""
    names = [c for c in df.columns if c not in _SIDE and ":window_" not in c and ":wall_offset" not in c and not isinstance(df.schema[c].dataType, T.ArrayType)]
    names = [c for c in names if metrics is None or c.split("::")[-1] in metrics]
    if not names:
        return df.select(F.lit("").alias("metric"), F.col("timestamp").cast("long").alias("ts_ns"), F.lit(0.0).alias("value")).limit(0)
    d = df.select(F.col("timestamp").cast("long").alias("ts_ns"), *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return d.unpivot(["ts_ns"], names, "metric", "value").where("value is not null").select("metric", "ts_ns", "value")


def metrics_in_two_tables(df: DataFrame) -> DataFrame:
    """Metrics that more than one table claims, of samples or of a catalog."""
    return df.groupBy("metric").agg(F.countDistinct("table").alias("tables")).where("tables > 1")


def catalog(df: DataFrame) -> DataFrame:
    """Distinct (metric, kind, labels), as far as the samples have them."""
    return df.select(*[c for c in ("recording", "source", "metric", "kind", "series_id", "labels", "sampler") if c in df.columns]).distinct()


_LABELS = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def parse_labels(c):
    """A label map from ``k="v",...``; the usual escapes are resolved."""
    keys = F.regexp_extract_all(c, F.lit(_LABELS), F.lit(1))
    clean = F.transform(F.regexp_extract_all(c, F.lit(_LABELS), F.lit(2)), lambda v: F.replace(F.replace(F.replace(v, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    return F.map_from_arrays(keys, clean)


def read_prometheus_text(lines: DataFrame, scrape_ns: str = "ts_ns") -> DataFrame:
    """Samples from exposition text, rows (scrape, ts_ns, value): types from the TYPE lines of the same scrape; untyped _total, _sum and _count are counters, else gauges; numbers that are not finite are dropped."""
    line = F.trim("value")
    types = lines.where(line.startswith("# TYPE ")).select("scrape", F.split(line, r"\s+")[2].alias("family"), F.split(line, r"\s+")[3].alias("type")).dropDuplicates(["scrape", "family"])
    d = lines.where((line != "") & ~line.startswith("#"))
    d = d.select("scrape", F.col(scrape_ns).alias("ts_ns"), F.regexp_extract(line, r"^([a-zA-Z_:][a-zA-Z0-9_:]*)", 1).alias("raw"), F.regexp_extract(line, r"\{(.*)\}", 1).alias("l"), F.regexp_extract(line, r"(?:\}|\s)\s*([^\s{}]+)(?:\s+-?\d+)?$", 1).try_cast("double").alias("value"))
    d = d.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).withColumn("family", F.regexp_replace("raw", r"_(bucket|sum|count)$", ""))
    d = d.join(types.withColumnRenamed("type", "own"), (d["scrape"] == types["scrape"]) & (d["raw"] == types["family"]), "left").select(d["*"], "own")
    fam = types.select(F.col("scrape").alias("s2"), F.col("family").alias("f2"), F.col("type").alias("of_family"))
    d = d.join(fam, (F.col("scrape") == F.col("s2")) & (F.col("family") == F.col("f2")), "left").drop("s2", "f2")
    suffix = F.col("raw").rlike(r"_(total|sum|count)$")
    kind = F.when(F.col("own").isin("counter", "gauge"), F.col("own")).when((F.col("of_family") == "histogram") & F.col("raw").endswith("_bucket"), "histogram_bucket").when(F.col("of_family").isin("histogram", "summary") & suffix, "counter").when(F.col("own") == "summary", "gauge").otherwise(F.when(suffix, "counter").otherwise("gauge"))
    return d.select("scrape", F.translate("raw", ":", "_").alias("metric"), kind.alias("kind"), parse_labels(F.col("l")).alias("labels"), "ts_ns", "value")


def read_line_protocol(lines: DataFrame) -> DataFrame:
    """Samples and histograms from ``name{k="v"} counter:n | gauge:n | histogram:gp,mvp:c c``, rows (file, ts_ns, value): comments are skipped, labels of ``# SESSION`` lines are merged under the metric's own."""
    line = F.trim("value")
    sess = lines.where(line.startswith("# SESSION")).select("file", F.explode(parse_labels(line)).alias("k", "v")).groupBy("file", "k").agg(F.max("v").alias("v")).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("session"))
    pat = r"^([a-zA-Z_][a-zA-Z0-9_]*)(?:\{(.*)\})?\s+(counter|gauge|histogram):(.*)$"
    d = lines.where(~line.startswith("#") & line.rlike(pat)).select("file", "ts_ns", *[F.regexp_extract(line, pat, i).alias(n) for i, n in ((1, "metric"), (2, "l"), (3, "kind"), (4, "rest"))])
    d = d.join(sess, "file", "left")
    labels = merge_labels(F.coalesce("session", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), parse_labels(F.col("l")))
    head = F.split("rest", ":")
    hist = F.col("kind") == "histogram"
    size = lambda i: F.when(hist, F.split(head[0], ",")[i].try_cast("int"))
    counts = F.when(hist, F.transform(F.split(F.trim(F.get(head, F.lit(1))), r"\s+"), lambda x: x.try_cast("long")))
    return d.select("file", "metric", "kind", labels.alias("labels"), "ts_ns", F.when(~hist, F.trim("rest").try_cast("double")).alias("value"), size(0).alias("gp"), size(1).alias("mvp"), counts.alias("buckets"))


def parse_annotations(docs: DataFrame) -> DataFrame:
    """Annotations from JSON text rows (value): an object, an array, or a line each."""
    from metrifold.functions.scalar import to_duration_ns, to_ts_ns

    text = F.trim("value")
    one, many = F.from_json(text, ANNOTATIONS), F.from_json(text, f"array<struct<{ANNOTATIONS.replace(' string', ':string').replace(' long', ':long').replace(' map', ':map')}>>")
    d = docs.where(text != "").select(F.explode(F.when(text.startswith("["), many).otherwise(F.array(one))).alias("a")).select("a.*")
    ts = to_ts_ns(F.coalesce("timestamp", "ts"))
    return d.select(ts.alias("ts_ns"), "description", "kind", "details", "source", "node", "instance", "labels", F.coalesce("duration_ns", to_duration_ns(F.col("duration"))).alias("duration_ns"), "id", "chart_id").where("ts_ns is not null")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """A file that begins with a bracket or an indented object is one document, else each line is."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    jsonl = F.size(F.filter(lines, lambda x: F.trim(x).startswith("{") & F.trim(x).endswith("}"))) == F.size(lines)
    return parse_annotations(whole.select(F.explode(F.when(jsonl, lines).otherwise(F.array("value"))).alias("value")))


def load_kpis(spark: SparkSession, path: str) -> DataFrame:
    """(service, aliases, title, role, query, type, subtype, percentiles, denominator) of a directory of templates."""
    schema = "service_name string, aliases array<string>, kpis array<struct<role:string,title:string,query:string,type:string,subtype:string,percentiles:array<double>,denominator:boolean>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.col("service_name").alias("service"), "aliases", F.inline("kpis"))


def duplicate_services(kpis: DataFrame) -> DataFrame:
    """Names and aliases that more than one template claims."""
    d = kpis.select("service", F.explode(F.concat(F.array("service"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).distinct()
    return d.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def check_categories(categories: DataFrame, kpis: DataFrame) -> DataFrame:
    """Categories (category, members) with fewer than two members or members without a template."""
    m = categories.select("category", F.explode_outer("members").alias("service"))
    missing = m.where("service is not null").join(kpis.select("service").distinct(), "service", "left_anti").groupBy("category").agg(F.array_sort(F.collect_list("service")).alias("missing"))
    few = m.groupBy("category").agg(F.count("service").alias("members"))
    return few.join(missing, "category", "left").where("members < 2 or missing is not null")


def read_ab(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("arm", F.lit("baseline")).unionByName(b.withColumn("arm", F.lit("experiment")), allowMissingColumns=True)


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_a_batch: int = 1000) -> DataFrame:
    """Live samples from files as they arrive, so many in a micro-batch at most."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_a_batch).load(path)


GROUND_TRUTH = "schema_version int, class string, subsystem string, mechanism string, direction string, induced_window_s array<double>, expected_signals array<struct<metric:string,check:string>>, experiment struct<spec_file:string,params:map<string,string>,host_tag:string>"
_EVIDENCE = "array<struct<metric:string,anomaly_index:bigint,regime_shift_index:bigint,correlation_index:bigint,rationale:string>>"
_FINDING = f"summary:string,confidence:string,evidence:{_EVIDENCE}"
ASSESSMENT = f"schema_version int, overall struct<{_FINDING},status:string>, findings array<struct<{_FINDING},priority:string,kind:struct<type:string,subsystem:string,mechanism:string,direction:string,missing:string>>>, ruled_out array<struct<{_FINDING}>>"


def read_ground_truth(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents of their own, or one a line with ``lines``."""
    return spark.read.schema(GROUND_TRUTH).json(path, multiLine=not lines)


def read_assessments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ASSESSMENT).json(path, multiLine=True)


def recording_labels(meta: DataFrame) -> DataFrame:
    """Labels of a recording: source, the host of its systeminfo document, and the user's own, which win."""
    host = F.get_json_object("systeminfo", "$.hostname")
    base = F.map_filter(F.create_map(F.lit("source"), F.col("source"), F.lit("host"), host), lambda k, v: v.isNotNull())
    return meta.select("recording", merge_labels(base, F.coalesce("user_labels", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))).alias("labels"))


def dense_segments(df: DataFrame) -> DataFrame:
    """Rows of one table's segments in order, each with its place."""
    return df.withColumn("segment_row", F.row_number().over(Window.partitionBy("table", "segment").orderBy("ts_ns")) - 1)
