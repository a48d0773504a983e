"""Column functions: arithmetic, labels, names, times and durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: PromQL math functions by name.
MATH = {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": F.round, "sqrt": F.sqrt, "exp": F.exp, "ln": F.ln, "log2": F.log2, "log10": F.log10, "sgn": F.signum}


def clamp(c: Column, lo, hi) -> Column:
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))


def clamp_min(c: Column, lo) -> Column:
    return F.greatest(c, F.lit(lo))


def clamp_max(c: Column, hi) -> Column:
    return F.least(c, F.lit(hi))


def time_of(df: DataFrame) -> DataFrame:
    """Each sample's own time, in seconds, as its value."""
    return df.withColumn("value", F.col("ts_ns") / 1e9)


def offset(df: DataFrame, ns: int) -> DataFrame:
    """Samples as seen ``ns`` later."""
    return df.withColumn("ts_ns", F.col("ts_ns") + F.lit(ns))


def vector(grid: DataFrame, x: float) -> DataFrame:
    return grid.select("ts_ns", F.lit(float(x)).alias("value"))


def absent(df: DataFrame, grid: DataFrame) -> DataFrame:
    """1 at each grid time where ``df`` has no sample."""
    return grid.select("ts_ns").join(df.select("ts_ns").distinct(), "ts_ns", "left_anti").withColumn("value", F.lit(1.0))


def scalar(df: DataFrame) -> DataFrame:
    """The value at each time where exactly one series has one, else null."""
    return df.groupBy("ts_ns").agg(F.when(F.count("*") == 1, F.max("value")).alias("value"))


def merge_labels(a: Column, b: Column) -> Column:
    """Labels of both maps; those of ``b`` win."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def label_replace(df: DataFrame, dst: str, replacement: str, src: str, regex: str) -> DataFrame:
    """``dst`` from ``src`` where the whole of it matches; $1 in the replacement is the first group."""
    s = F.coalesce(F.col(src), F.lit(""))
    whole = f"^(?:{regex})$"
    old = F.col(dst) if dst in df.columns else F.lit("")
    return df.withColumn(dst, F.when(s.rlike(whole), F.regexp_replace(s, whole, replacement)).otherwise(old))


def label_join(df: DataFrame, dst: str, sep: str, *src: str) -> DataFrame:
    return df.withColumn(dst, F.concat_ws(sep, *src))


def labels_text(labels: Column) -> Column:
    """Sorted ``k=v`` pairs of a label map, comma-joined: the canonical form of a series."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


def series_id(metric: Column, labels: Column) -> Column:
    return F.xxhash64(metric, labels_text(labels))


def series_key(labels: Column, exclude: Sequence[str] = ()) -> Column:
    """The quantile first, then the other dimensions sorted, without the excluded capture names."""
    rest = F.map_filter(labels, lambda k, v: ~k.isin("quantile", "percentile", *exclude))
    quantile = quantile_label(F.coalesce(F.element_at(labels, "quantile"), F.element_at(labels, "percentile")))
    return F.concat_ws("·", quantile, F.when(F.size(rest) > 0, labels_text(rest)))


def quantile_label(c: Column) -> Column:
    """0.5, "50" and "p99" to p50, p50 and p99; tails keep their digits: 0.999 is p999."""
    raw = F.regexp_extract(c, r"^\s*[pP]?([0-9]*\.?[0-9]+)\s*$", 1)
    number = raw.try_cast("decimal(20,10)")
    percent = F.when(number <= 1, number * 100).otherwise(number)
    digits = F.regexp_replace(F.regexp_replace(percent.cast("decimal(20,8)").cast("string"), r"0+$", ""), r"\.", "")
    return F.when(raw != "", F.concat(F.lit("p"), F.when(percent == F.floor(percent), percent.cast("long").cast("string")).otherwise(digits)))


#: Domain names that differ from the metric's first word; fixed values.
DOMAIN_ALIASES = {"drive": "drivehealth", "gpmu": "gpu"}


def domain_of(metric: Column) -> Column:
    """The first word of a metric's name, without the cgroup prefix, by its domain's name."""
    first = F.split(F.regexp_replace(metric, "^cgroup_", ""), "_")[0]
    for a, b in DOMAIN_ALIASES.items():
        first = F.when(first == a, b).otherwise(first)
    return first


def base_name(metric: Column) -> Column:
    return F.regexp_replace(metric, r":p(50|90|99)$", "")


#: Labels that name a consumer, best first; fixed values.
CONSUMER_LABELS = ("name", "id", "op", "direction", "interface", "cpu")


def consumer_name(labels: Column) -> Column:
    pairs = F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(*[F.try_element_at(labels, F.lit(k)) for k in CONSUMER_LABELS], F.array_min(pairs))


def to_ts_ns(c: Column) -> Column:
    """Nanoseconds from an integer, RFC 3339, or a naive time taken as UTC; null before the epoch or if unreadable."""
    number = F.when(c.rlike(r"^\d+$"), c.try_cast("long"))
    iso = F.when(c.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d"), F.regexp_replace(c, r"^(\S{10}[Tt ]\d\d:\d\d)(?=$|[Zz+-])", "$1:00"))
    micros = F.unix_micros(iso.try_cast("timestamp"))
    ns = F.coalesce(number, micros * 1000)
    return F.when(ns >= 0, ns)


#: Nanoseconds in each unit of a written duration; fixed values.
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000}


def to_duration_ns(c: Column) -> Column:
    """Nanoseconds from an integer or a text like 1m30s; null if unreadable."""
    total = F.lit(0).cast("long")
    for unit, ns in UNITS.items():
        found = F.regexp_extract_all(c, F.lit(rf"(\d+)\s*{unit}(?![a-z])"), F.lit(1))
        total = total + F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")) * ns
    return F.when(c.rlike(r"^\d+$"), c.try_cast("long")).when(c.rlike(r"^\s*(\d+\s*(ns|us|ms|s|m|h|d)\s*)+$"), total)


#: Least |r| for each wording; fixed values.
STRENGTHS = ((0.9, "very strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak"))


def corr_label(r: Column) -> Column:
    sign = F.when(r > 0, " positive").when(r < 0, " negative").otherwise("")
    word = F.lit("negligible")
    for least, name in reversed(STRENGTHS):
        word = F.when(F.abs(r) >= least, F.concat(F.lit(name), sign)).otherwise(word)
    return word


def parse_json(c: Column, schema: str) -> Column:
    """Null where the document can't be read."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def last_rank(n: Column, q: float) -> Column:
    """Nearest rank of a quantile among ``n`` values, 1 at least."""
    return F.greatest(F.ceil(n * F.lit(q)), F.lit(1).cast("long"))


def count_of(flag: Column) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0)).cast("long")
