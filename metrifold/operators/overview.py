"""The overview record: features, tiers, rankings and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrifold.operators.aggregate import rank_consumers, summary_stats
from metrifold.operators.anomaly import detect
from metrifold.operators.base import cut, finite, finite_or_zero
from metrifold.operators.rates import rate_raw

SCHEMA_VERSION = 2


def magnitude(value: Column, median: Column, mad: Column) -> Column:
    """Distance from the median in scaled MADs, 0 where there is none."""
    return finite_or_zero(F.try_divide(F.abs(value - median), 1.4826 * mad))


def feature_columns(shifts: DataFrame) -> DataFrame:
    """Regime shifts by index: direction (equal means count as a decrease) and the size of the mean's change in percent, without a sign."""
    direction = F.when(F.col("after") > F.col("before"), "Increase").otherwise("Decrease")
    pct = F.try_divide(F.abs(F.col("after") - F.col("before")) * 100, F.abs("before"))
    return shifts.withColumns({"direction": direction, "pct_change": finite_or_zero(pct)}).orderBy("idx")


def analysis_status(stats: DataFrame) -> DataFrame:
    """NoData, Constant (whose findings are dropped) or Analyzed."""
    return stats.withColumn("status", F.when(F.coalesce("n", F.lit(0)) == 0, "NoData").when(F.col("min") == F.col("max"), "Constant").otherwise("Analyzed"))


def tier_metrics(metrics: DataFrame, anomalous: DataFrame, shifted: DataFrame, consumers: DataFrame, correlated: DataFrame) -> DataFrame:
    """``promotion``: the first of anomalous, regime_shift, top_consumer, strong_correlation that holds; ``tier`` Full with one, else Summary."""
    d = metrics
    for name, t in (("anomalous", anomalous), ("regime_shift", shifted), ("top_consumer", consumers), ("strong_correlation", correlated)):
        d = d.join(t.select("metric").distinct().withColumn(name, F.lit(True)), "metric", "left")
    names = ("anomalous", "regime_shift", "top_consumer", "strong_correlation")
    d = d.withColumn("promotion", F.coalesce(*[F.when(F.col(n), n) for n in names])).drop(*names)
    return d.withColumn("tier", F.when(F.col("promotion").isNull(), "Summary").otherwise("Full"))


#: The six rankings: domain, counter, the label that names a consumer, and the unit's scale; fixed values. Memory has none.
RANKED = (
    ("cpu", "cpu_usage", "id", 1e9),
    ("cpu", "cgroup_cpu_usage", "name", 1e9),
    ("io", "blockio_operations", "op", 1.0),
    ("io", "blockio_bytes", "op", 1.0),
    ("network", "network_bytes", "direction", 1.0),
    ("network", "network_packets", "direction", 1.0),
)


def build_rankings(counters: DataFrame, series: Sequence[str] = ("metric", "labels"), ranked: Sequence[tuple[str, str, str, float]] = RANKED, n: int = 10) -> DataFrame:
    """(domain, metric, name, avg, max, share, rank): top consumers of each ranked counter by its summed rate; shares are of all its consumers.

    From counters (``series`` columns, ts_ns, value) with a map ``labels`` and a column ``metric``; counters without samples are not there.
    """
    domain, name, scale = (F.lit(None).cast(t) for t in ("string", "string", "double"))
    for at, metric, label, unit in ranked:
        here = F.col("metric") == metric
        domain, name, scale = F.when(here, at).otherwise(domain), F.when(here, F.col("labels")[label]).otherwise(name), F.when(here, unit).otherwise(scale)
    d = counters.withColumns({"__domain": domain, "name": name, "__scale": scale}).where("__domain is not null and name is not null")
    keys = [k for k in series if k not in ("metric", "labels")]
    rates = rate_raw(d.withColumn("__key", F.to_json("labels")), ["__domain", "metric", "name", "__scale", "__key", *keys])
    summed = rates.groupBy("__domain", F.col("metric").alias("domain"), "name", "ts_ns").agg(F.sum(F.col("value") / F.col("__scale")).alias("value"))
    return rank_consumers(summed, ["__domain"], n).select(F.col("__domain").alias("domain"), F.col("domain").alias("metric"), "name", "avg", "max", "share", "rank").orderBy("domain", "metric", F.desc("avg"), "name")


def extract_features(df: DataFrame, consumers: DataFrame | None = None, correlated: DataFrame | None = None, step_s: float = 1.0) -> dict[str, DataFrame]:
    """``metrics``, one row a metric: status, statistics, noise, anomaly, severity and shift counts, promotion and tier; its ``anomalies`` and ``shifts``.

    From indexed samples (metric, idx, ts_ns, value). The first of these promotes to full detail: an anomaly of any
    severity, a shift, being a top consumer, a strong correlation. Constant series have no findings.
    """
    keys = ["metric"]
    df = cut(df, "indexed")  # its places are not worked out again by each reader
    stats = summary_stats(df, keys).join(df.groupBy("metric").agg(F.count_if(finite(F.col("value"))).alias("n")), "metric")
    stats = cut(analysis_status(stats), "statistics")
    found = detect(df.where(finite(F.col("value"))), keys, step_s)
    analyzed = stats.where("status = 'Analyzed'").select("metric")
    anomalies, shifts = found["anomalies"].join(analyzed, "metric", "left_semi"), feature_columns(found["changes"].join(analyzed, "metric", "left_semi"))
    counts = anomalies.groupBy("metric").agg(F.count("*").alias("anomalies"), F.count_if(F.col("severity").isin("High", "Critical")).alias("severe"))
    moved = shifts.groupBy("metric").agg(F.count("*").alias("shifts"))
    d = stats.join(found["noise"].select("metric", "noise"), "metric", "left").join(counts, "metric", "left").join(moved, "metric", "left").na.fill(0, ["anomalies", "severe", "shifts"])
    none = df.select("metric").limit(0)
    tiers = tier_metrics(stats.select("metric"), counts, moved, none if consumers is None else consumers, none if correlated is None else correlated)
    return {"metrics": cut(d.join(tiers, "metric"), "features"), "anomalies": anomalies, "shifts": shifts}


def overview_document(features: DataFrame, rankings: DataFrame, correlations: DataFrame) -> DataFrame:
    """The record as one JSON row, in a fixed order; its parts are display-sized after their cuts."""
    part = lambda d, order, name: d.agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in d.columns if c not in order]))).alias(name))
    m, r, c = part(features, ["metric"], "metrics"), part(rankings, ["domain", "rank"], "rankings"), part(correlations, ["a", "b"], "correlations")
    return m.join(F.broadcast(r)).join(F.broadcast(c)).select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "metrics", "correlations", "rankings")).alias("value"))


def assert_finite(df: DataFrame) -> DataFrame:
    """Rows in which any number is null, NaN or infinite, by column: none for a sound record."""
    numbers = [n for n, t in df.dtypes if t in ("double", "float")]
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(finite(F.col(n)), F.lit(False)), F.lit(n)) for n in numbers])) if numbers else F.array().cast("array<string>")
    return df.withColumn("not_finite", bad).where(F.size("not_finite") > 0)


def verify(signals: DataFrame, metrics: DataFrame, findings: DataFrame, present: DataFrame) -> DataFrame:
    """``signals`` (experiment, metric, check, from_idx, to_idx) with ``passed``: whether the record shows what an experiment must show.

    Checks: RegimeShiftIncreaseInWindow asks for a shift upwards within the window, ends included; ElevatedInWindow for
    any finding there on a metric of full detail, or p99 over twice p50; SubsystemPresent for the metric's ``sampler`` among
    ``present`` (sampler). ``metrics`` are (metric, tier, p50, p99, sampler), ``findings`` (metric, kind, direction,
    idx) with kinds shift and anomaly. A metric that is not in the record fails.
    """
    inside = signals.join(findings.select("metric", "kind", "direction", "idx"), "metric").where("idx between from_idx and to_idx")
    rises = F.bool_or((F.col("kind") == "shift") & (F.col("direction") == "Increase"))
    hits = inside.groupBy("experiment", "metric", "from_idx", "to_idx").agg(rises.alias("rises"), F.lit(True).alias("any"))
    d = signals.join(hits, ["experiment", "metric", "from_idx", "to_idx"], "left").join(metrics.select("metric", "tier", "p50", "p99", "sampler", F.lit(True).alias("known")), "metric", "left")
    d = d.join(present.select("sampler").distinct().withColumn("there", F.lit(True)), "sampler", "left")
    elevated = (F.col("tier") == "Full") & F.coalesce("any", F.lit(False)) | (F.col("p99") > 2 * F.col("p50"))
    test = F.when(F.col("check") == "RegimeShiftIncreaseInWindow", F.col("rises")).when(F.col("check") == "ElevatedInWindow", elevated).when(F.col("check") == "SubsystemPresent", F.col("there"))
    return d.select(*signals.columns, (F.coalesce("known", F.lit(False)) & F.coalesce(test, F.lit(False))).alias("passed"))


def check_truth(truth: DataFrame, signals: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Ground-truth documents (experiment, class, window_start, window_end, duration) with their faults: unknown class, malformed window, one beyond the duration, or no upward shift among the signals."""
    anchors = signals.where("check = 'RegimeShiftIncreaseInWindow'").select("experiment").distinct().withColumn("anchored", F.lit(True))
    start, end = F.col("window_start").cast("double"), F.col("window_end").cast("double")
    sound = F.coalesce(finite(start) & finite(end) & (start >= 0) & (start < end), F.lit(False))
    why = F.array(F.when(~F.coalesce(F.col("class").isin(*classes), F.lit(False)), "class"), F.when(~sound, "window"), F.when(end > F.col("duration"), "duration"), F.when(F.col("anchored").isNull(), "anchor"))
    return truth.join(anchors, "experiment", "left").withColumn("why", F.array_compact(why)).where(F.size("why") > 0).drop("anchored")


def matches_assessment(truth: DataFrame, findings: DataFrame) -> DataFrame:
    """Whether each experiment's assessment has exactly one bottleneck of any priority, which is High and has the truth's subsystem, mechanism and direction."""
    fields = ("subsystem", "mechanism", "direction")
    g = findings.where("kind = 'bottleneck'").groupBy("experiment").agg(F.count("*").alias("n"), F.first(F.struct("priority", *fields)).alias("f"))
    same = F.lit(True)
    for name in fields:
        same = same & F.col(f"f.{name}").eqNullSafe(F.col(name))
    return truth.join(g, "experiment", "left").select("experiment", F.coalesce((F.col("n") == 1) & (F.col("f.priority") == "High") & same, F.lit(False)).alias("matches"))


def validate_assessment(findings: DataFrame, evidence: DataFrame, metrics: DataFrame) -> DataFrame:
    """Findings (finding, confidence, summary) that do not hold, with every reason.

    ``summary``: it is blank; ``evidence``: High without any; ``pointer``: High and none of its evidence (finding, metric,
    anomaly_index, shift_index, correlation_index) points anywhere; ``metric``: evidence names one that is not in ``metrics`` (metric,
    anomalies, shifts, within_band), ``index``: one beyond the metric's findings; ``within_band``: High on a metric that
    moved within its measurement band.
    """
    e = evidence.join(metrics.select("metric", "anomalies", "shifts", "within_band", F.lit(True).alias("known")), "metric", "left")
    beyond = lambda i, n: F.coalesce(F.col(i) >= F.col(n), F.lit(False))
    points = F.coalesce(F.col("metric").cast("string"), F.col("anomaly_index").cast("string"), F.col("shift_index").cast("string"), F.col("correlation_index").cast("string")).isNotNull()
    g = e.groupBy("finding").agg(
        F.bool_or(points).alias("pointed"),
        F.bool_or(F.col("metric").isNotNull() & F.col("known").isNull()).alias("unknown"),
        F.bool_or(beyond("anomaly_index", "anomalies") | beyond("shift_index", "shifts")).alias("beyond"),
        F.bool_or(F.coalesce("within_band", F.lit(False))).alias("band"),
    )
    high = F.col("confidence") == "High"
    why = F.array(
        F.when(F.trim(F.coalesce("summary", F.lit(""))) == "", "summary"), F.when(high & F.col("pointed").isNull(), "evidence"), F.when(high & ~F.col("pointed"), "pointer"),
        F.when(F.col("unknown"), "metric"), F.when(F.col("beyond"), "index"), F.when(high & F.col("band"), "within_band"),
    )
    return findings.join(g, "finding", "left").select("finding", F.array_compact(why).alias("why")).where(F.size("why") > 0)


def normalised(cost: DataFrame, throughput: DataFrame) -> DataFrame:
    """Resource cost for each unit of throughput at equal times."""
    from metrifold.operators.joins import binop

    return binop(cost, throughput, "/", on=[])
