"""Outliers, level shifts and change points of indexed series, and their scoring."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from metrifold.operators import scan
from metrifold.operators.base import cut, finite, folded, idiv, together, whole
from metrifold.operators.ranks import order_statistics
from metrifold.operators.stability import all_noise_transitions, allan, dev_at, smooth, smoothing_tau

#: Multiplier of the scaled MAD by noise class; fixed values.
MAD_MULTIPLIERS = {"WhitePhase": 4.0, "FlickerPhase": 4.0, "RandomWalk": 6.5, "FlickerWalk": 6.5}
#: (k, h) in standard deviations; fixed values.
CUSUM_LEVELS = ((0.5, 5.0), (1.0, 6.0), (1.5, 8.0), (2.5, 10.0))


def mad_multiplier(noise: Column) -> Column:
    out = F.lit(5.0)
    for name, m in MAD_MULTIPLIERS.items():
        out = F.when(noise == name, m).otherwise(out)
    return out


def medians(df: DataFrame, keys: Sequence[str], column: Column, name: str) -> DataFrame:
    """(keys, name): the exact median, the mean of the middle two for even counts."""
    return order_statistics(df, keys, column, (0.5, 0.5), {"__a": F.floor((F.col("n") + 1) / 2), "__b": F.floor((F.col("n") + 2) / 2)}).select(*keys, ((F.col("__a") + F.col("__b")) / 2).alias(name))


def mad_stats(df: DataFrame, keys: Sequence[str], column: str = "value") -> DataFrame:
    """(keys, median, mad) of each series."""
    med = medians(df.where(F.col(column).isNotNull()), keys, F.col(column).cast("double"), "median")
    mad = medians(df.join(med, list(keys)), keys, F.abs(F.col(column) - F.col("median")), "mad")
    return med.join(mad, list(keys))


def mad_outliers(df: DataFrame, keys: Sequence[str], m: Column | float = 5.0, column: str = "value", stats: DataFrame | None = None) -> DataFrame:
    """Rows strictly farther from the median than m x 1.4826 x MAD, with median, mad and threshold."""
    d = df.join(mad_stats(df, keys, column) if stats is None else stats, list(keys))
    d = d.withColumn("threshold", (m if isinstance(m, Column) else F.lit(m)) * 1.4826 * F.col("mad"))
    return d.where(F.abs(F.col(column) - F.col("median")) > F.col("threshold"))


def _arrow(df: DataFrame, columns: Sequence[str]) -> pa.Schema:
    return to_arrow_schema(df.select(*columns).schema)


def spaced(df: DataFrame, keys: Sequence[str], gap: str | int) -> DataFrame:
    """Of candidates in idx order those at least ``gap`` after the last one kept: a fold with one number of state."""
    d = df.withColumn("__w", (F.col(gap) if isinstance(gap, str) else F.lit(gap)).cast("long"))

    def step(state: dict, rows: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for idx, w in zip(rows.column("idx").to_pylist(), rows.column("__w").to_pylist(), strict=True):
            keep.append("last" not in state or idx - state["last"] >= w)
            if keep[-1]:
                state["last"] = idx
        return rows.filter(pa.array(keep, pa.bool_()))

    kinds = dict(df.dtypes)
    return folded(d, keys, ["idx"], step, ", ".join(f"`{c}` {kinds[c]}" for c in df.columns), _arrow(df, df.columns))


def cliffs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, idx, magnitude, direction, kind): sustained steps, and level changes apart from them.

    A step is a difference beyond s deviations or beyond a share p of the mean (s and p by the coefficient of variation:
    5 and 0.5 over 0.4, 4 and 0.35 over 0.25, else 3 and 0.25), after which the next difference is under half of it.
    A level change is a difference of 1.5 s deviations between the means of the two points before and the two after;
    next to a step none counts, and of neighbouring ones every second.
    """
    v = F.col("value").cast("double")
    means = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))
    # chunks of neighbouring places, with the three rows on either side that their windows see
    d = scan.numbered(scan.with_series(scan.chunked(df.select(*keys, "idx", v.alias("value")), keys, "idx"), means, keys), "__p", "idx")
    near = F.array_distinct(F.transform(F.array(*[F.lit(i) for i in (-3, 0, 3)]), lambda i: idiv(F.greatest(F.col("__p") + i, F.lit(0)), scan.ROWS)))
    d = d.withColumns({"__home": idiv(F.col("__p"), scan.ROWS), "__c": F.explode(near)})
    w = Window.partitionBy("__k", "__c").orderBy("idx")
    d = d.withColumns({**{f"b{i}": F.lag("value", i).over(w) for i in (1, 2)}, **{f"a{i}": F.lead("value", i).over(w) for i in (1, 2)}})
    cv = F.when(F.col("mean") != 0, F.col("sd") / F.abs("mean")).otherwise(0.0)
    d = d.withColumns({"far": F.when(cv > 0.4, 5.0).when(cv > 0.25, 4.0).otherwise(3.0) * F.col("sd"), "share": F.when(cv > 0.4, 0.5).when(cv > 0.25, 0.35).otherwise(0.25), "diff": F.col("value") - F.col("b1")})
    size = F.abs("diff")
    big = (size > F.col("far")) | (F.col("mean") != 0) & (size / F.abs("mean") > F.col("share"))
    lasts = F.col("a1").isNull() | (F.abs(F.col("a1") - F.col("value")) < 0.5 * size)
    change = (F.col("a1") + F.col("a2")) / 2 - (F.col("b1") + F.col("b2")) / 2
    d = d.withColumns({"step": F.coalesce(big & lasts, F.lit(False)), "change": change})
    beside = F.col("step") | F.coalesce(F.lag("step").over(w), F.lit(False)) | F.coalesce(F.lead("step").over(w), F.lit(False))
    d = d.withColumn("level", F.coalesce(F.abs("change") > 1.5 * F.col("far"), F.lit(False)) & ~beside)
    found = cut(d.where("(step or level) and __c = __home").select(*keys, "idx", "step", F.when(F.col("step"), F.col("diff")).otherwise(F.col("change")).alias("by")), "cliffs")
    levels = scan.numbered(scan.chunked(found.where("not step"), keys, "idx"), "place", "idx").withColumn("island", F.col("idx") - F.col("place"))
    odd = (F.row_number().over(Window.partitionBy(*keys, "island").orderBy("idx")) % 2) == 1
    found = found.where("step").unionByName(levels.withColumn("odd", odd).where("odd").select(*found.columns))
    return found.select(*keys, "idx", F.abs("by").alias("magnitude"), F.when(F.col("by") > 0, "Increase").otherwise("Decrease").alias("direction"), F.when(F.col("step"), "step").otherwise("level").alias("kind"))


def _alarms(c: np.ndarray, s: float, h: float) -> tuple[list[int], float]:
    """Where sums of ``c`` held at 0 from below, starting at ``s``, pass ``h`` and start anew; and the last sum. Blocks keep the work linear."""
    out, at = [], 0
    while at < len(c):
        run = np.cumsum(c[at : at + 256])
        run[:] = run + s - np.minimum(np.minimum.accumulate(run + s), 0)
        over = np.flatnonzero(run > h)
        if len(over):
            at += int(over[0]) + 1
            out.append(at - 1)
            s = 0.0
        else:
            at, s = at + len(run), float(run[-1])
    return out, s


#: Jobs at most that hand sums from chunk to chunk; what is not settled by then is folded in order.
ROUNDS = 6


def cusum(df: DataFrame, keys: Sequence[str], levels: Sequence[tuple[float, float]] = CUSUM_LEVELS[1:2]) -> DataFrame:
    """(keys, idx, level, side): alarms of the two-sided CUSUM at each (k, h) in standard deviations; a sum that alarms starts anew, the other goes on.

    Values that are not finite are no points. Series of up to ``scan.ROWS`` points are one fold each, of every level and side
    with two sums. Longer ones are cut into chunks that run side by side from 0; then each chunk whose sums begin
    elsewhere, by what the chunk before ends with, runs again, until no end changes. Paths meet where both touch 0 or
    start anew, so that a few rounds settle all but a steady drift; after ``ROUNDS`` such series are folded in order.
    """
    v = F.col("value").cast("double")
    points = df.where(finite(v)).select(*keys, F.col("idx").cast("long").alias("idx"), v.alias("v"))
    stats = points.groupBy(*keys).agg(F.avg("v").alias("__m"), F.stddev_pop("v").alias("__s"))
    points = points.withColumn("__k", F.struct(*keys)).join(stats.select(F.struct(*keys).alias("__k"), "__m", "__s"), "__k")
    d = points.select(*keys, "idx", F.try_divide(F.col("v") - F.col("__m"), F.col("__s")).alias("z")).where("z is not null")
    longest = df.groupBy(*keys).agg(F.max("idx").alias("n")).agg(F.max("n")).first()[0]
    if longest is None or longest < scan.ROWS:
        return _folds(d, keys, levels).where("side <> 'end'").select(*keys, "idx", "level", "side")
    return _chunk_folds(d, keys, levels)


def _folds(d: DataFrame, keys: Sequence[str], levels: Sequence[tuple[float, float]]) -> DataFrame:
    """(keys, idx, level, side, ends): alarms, and for each piece of rows a row of side "end" with all sums after it. A row without z sets the sums to its ``begins``.

    Other rows have an empty one: a column of arrays that are null takes Spark's writer of Arrow batches a time quadratic in a batch's rows.
    """
    none = F.array().cast("array<double>")
    d = d.withColumn("begins", F.coalesce("begins", none) if "begins" in d.columns else none)
    schema = _arrow(d, keys)
    for field in (pa.field("idx", pa.int64()), pa.field("level", pa.int64()), pa.field("side", pa.string()), pa.field("ends", pa.list_(pa.float64()))):
        schema = schema.append(field)
    sides = (("up", 1.0), ("down", -1.0))

    def step(state: dict, rows: pa.RecordBatch) -> pa.RecordBatch:
        first = rows.column("begins")[0].as_py()
        if first:
            state["sums"] = first
            rows = rows.slice(1)
        sums = state.setdefault("sums", [0.0] * (2 * len(levels)))
        zs = rows.column("z").to_numpy(zero_copy_only=False)
        at: list[int] = []
        level: list[int] = []
        side: list[str] = []
        for i, (k, h) in enumerate(levels):
            for j, (name, sign) in enumerate(sides):
                found, sums[2 * i + j] = _alarms(sign * zs - k, sums[2 * i + j], h)
                at += found
                level += [i] * len(found)
                side += [name] * len(found)
        if rows.num_rows:
            at, level, side = [*at, rows.num_rows - 1], [*level, -1], [*side, "end"]
        got = rows.take(pa.array(at, pa.int64()))
        ends = [None] * (len(at) - 1) + [list(sums)] if at else []
        return pa.RecordBatch.from_arrays([*(got.column(x) for x in (*keys, "idx")), pa.array(level, pa.int64()), pa.array(side, pa.string()), pa.array(ends, pa.list_(pa.float64()))], names=[*keys, "idx", "level", "side", "ends"])

    kinds = dict(d.dtypes)
    return folded(d, keys, ["idx"], step, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "idx long, level long, side string, ends array<double>"]), schema)


def _chunk_folds(d: DataFrame, keys: Sequence[str], levels: Sequence[tuple[float, float]]) -> DataFrame:
    d = cut(scan.chunked(d, keys, "idx").drop("__k").withColumn("__c", F.col("__c").cast("long")), "cusum-points")
    parts, zero = [*keys, "__c"], F.array_repeat(F.lit(0.0), 2 * len(levels))
    series_of = lambda x: F.struct(*[F.col(k) for k in keys]).alias(x)
    found = cut(_folds(d, parts, levels).withColumn("begins", zero), "cusum-round")
    for at in range(ROUNDS + 1):
        ends = found.where("side = 'end'").groupBy(*parts).agg(F.max_by("ends", "idx").alias("ends"), F.first("begins").alias("was"))
        now = ends.withColumn("begins", F.coalesce(F.lag("ends").over(Window.partitionBy(*keys).orderBy("__c")), zero))
        again = cut(now.where(~F.col("begins").eqNullSafe(F.col("was"))).select(*parts, "begins"), "cusum-again")
        if again.isEmpty():
            break
        over = series_of("__k")
        if at == ROUNDS:  # from each series' first unsettled chunk on, in order
            first = again.groupBy(*keys).agg(F.min("__c").alias("__from"), F.min_by("begins", "__c").alias("begins"))
            rest = d.withColumn("__k", over).join(first.select(over, "__from"), "__k").where("__c >= __from").select(*keys, "idx", "z")
            seeds = first.select(*keys, F.lit(-1).cast("long").alias("idx"), "begins")
            done = _folds(rest.unionByName(seeds, allowMissingColumns=True), keys, levels)
            kept = found.withColumn("__k", over).join(first.select(over, "__from"), "__k", "left").where("__from is null or __c < __from")
            return kept.select(*keys, "idx", "level", "side").unionByName(done.select(*keys, "idx", "level", "side")).where("side <> 'end'")
        place = lambda x: F.struct(*[F.col(k) for k in parts]).alias(x)
        rows = d.withColumn("__p", place("__p")).join(again.select(place("__p")), "__p", "left_semi").drop("__p")
        seeds = again.select(*parts, F.lit(-1).cast("long").alias("idx"), "begins")
        new = _folds(rows.unionByName(seeds, allowMissingColumns=True), parts, levels)
        new = new.withColumn("__p", place("__p")).join(again.select(place("__p"), "begins"), "__p").drop("__p")
        old = found.withColumn("__p", place("__p")).join(again.select(place("__p")), "__p", "left_anti").drop("__p")
        found = cut(old.unionByName(new), "cusum-round")
    return found.where("side <> 'end'").select(*keys, "idx", "level", "side")


def change_points(df: DataFrame, keys: Sequence[str], devs: DataFrame | None = None, step_s: float = 1.0, tau: DataFrame | int = 30) -> DataFrame:
    """(keys, idx, before, after, pct, significance, confidence): where the means of the windows on either side differ, spaced a window apart.

    Windows are clamp(2 tau, 30, 120) s in steps (rounded), ten at least and a quarter of the series at most; series have
    60 points or more. Centres are half a window apart; the last window may be as short as half. ``tau`` is a number of
    steps or (keys, tau). Kept are t > 3, change over deviation > 2, change over 10 % of the mean before, confidence over 0.4.
    """
    devs = allan(df, keys) if devs is None else devs
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 60")
    n = n.withColumn("tau", F.lit(tau)) if isinstance(tau, int) else n.join(tau.select(*keys, "tau"), list(keys))
    span = F.least(F.greatest(2 * F.col("tau") * step_s, F.lit(30.0)), F.lit(120.0)) / step_s
    sizes = n.withColumn("span", span).withColumn("w", F.least(F.greatest(F.round("span"), F.lit(10.0)), F.floor(F.col("n") / 4)).cast("long"))
    v = F.col("value").cast("double")
    # values are taken from their series' mean first, so that the difference of two sums of squares keeps its digits
    middle = df.groupBy(*keys).agg(F.avg(v).alias("middle"))
    d = scan.with_series(scan.chunked(df.select(*keys, "idx", v.alias("v")), keys, "idx"), middle, keys)
    x = F.col("v") - F.col("middle")
    sums = scan.prefix_sums(d, {"s": x, "q": x * x}, "idx").select(*keys, "idx", "middle", "s", "q")
    half = F.floor(F.col("w") / 2)
    c = sizes.withColumn("mid", F.explode(F.sequence(F.col("w"), F.least(F.col("n") - half, F.col("n") - 1), half.cast("long"))))
    c = c.withColumns({"lo": F.col("mid") - F.col("w"), "hi": F.least(F.col("mid") + F.col("w"), F.col("n"))})
    at = lambda name: sums.select(*keys, (F.col("idx") + 1).alias(name), F.col("s").alias(f"s_{name}"), F.col("q").alias(f"q_{name}"), *(["middle"] if name == "mid" else []))
    for name in ("lo", "mid", "hi"):
        c = c.join(at(name), [name, *keys], "left")  # the place leads: a sort by a name first compares whole rows
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    nb, na = F.col("w"), F.col("hi") - F.col("mid")
    mb, ma = (F.col("s_mid") - zero("s_lo")) / nb, (F.col("s_hi") - F.col("s_mid")) / na
    vb = F.greatest((F.col("q_mid") - zero("q_lo")) / nb - mb * mb, F.lit(0.0))
    va = F.greatest((F.col("q_hi") - F.col("q_mid")) / na - ma * ma, F.lit(0.0))
    c = c.withColumns({"before": mb + F.col("middle"), "after": ma + F.col("middle"), "se": F.sqrt((vb + va) / 2) * F.sqrt(1 / nb + 1 / na)})
    c = c.join(dev_at(devs, keys, sizes.select(*keys, F.col("span").alias("at"))).select(*keys, "dev"), list(keys))
    change = F.abs(F.col("after") - F.col("before"))
    c = c.withColumns({"t": F.when(F.col("se") > 0, change / F.col("se")).otherwise(0.0), "significance": change / F.col("dev"), "pct": F.coalesce(F.try_divide(change, F.abs("before")), F.lit(0.0))})
    one = lambda e: F.least(e, F.lit(1.0))
    c = c.withColumn("confidence", 0.5 * one(F.col("significance") / 10) + 0.3 * one(F.col("t") / 10) + 0.2 * one(2 * F.col("pct"))).where("t > 3 and significance > 2 and pct > 0.1 and confidence > 0.4")
    return spaced(c.select(*keys, F.col("mid").alias("idx"), "before", "after", "pct", "significance", "confidence", "w"), keys, "w").drop("w")


def detrend_norm(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``z``: residuals of a line on the index over their population deviation; 0 where that is under 1e-10."""
    w = whole(keys)
    x, y = F.col("idx").cast("double"), F.col("value").cast("double")
    mx, my = F.avg(x).over(w), F.avg(y).over(w)
    d = df.withColumns({"__x": x - mx, "__y": y - my})
    slope = F.coalesce(F.try_divide(F.sum(F.col("__x") * F.col("__y")).over(w), F.sum(F.col("__x") * F.col("__x")).over(w)), F.lit(0.0))
    d = d.withColumn("__r", F.col("__y") - slope * F.col("__x"))
    sd = F.stddev_pop("__r").over(w)
    return d.withColumn("z", F.when(sd < 1e-10, F.lit(0.0)).otherwise(F.col("__r") / sd)).drop("__x", "__y", "__r")


#: Weight at the index, share of it (for cliffs the weight itself) at its neighbours, and their reach; fixed values.
WEIGHTS = {"mad": (1.0, 0.0, 0), "cliff": (3.0, 0.8, 1), "up": (2.0, 0.0, 0), "down": (2.0, 0.0, 0), "change": (4.0, 0.3, 5), "allan": (3.5, 0.2, 10), "hadamard": (3.0, 0.2, 10), "mod_allan": (3.2, 0.2, 10)}
#: What a transition adds where the deviation changes beyond a ratio of 3 or 0.33 (half of it otherwise); fixed values.
DRAMATIC = {"allan": 1.0, "hadamard": 0.8, "mod_allan": 0.9}


def _by_kind(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kind, value in values.items() for x in (kind, value)])[F.col("kind")]


def score(findings: DataFrame, values: DataFrame, keys: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """(keys, idx, value, type, score, confidence, severity) of the indices with enough evidence.

    ``findings`` (keys, idx, kind, confidence, ratio) are outliers (mad), cliffs, CUSUM sides (up, down), alarms of any
    CUSUM level (cusum), change points (change) and noise transitions of three kinds; confidence scales the weight of
    the last two. Neighbours get a share. An alarm that is no cliff and no shift adds a half. ``values`` (keys, idx,
    value) are the analysed ones; a value's distance is that from the median in MADs.
    """
    stats = mad_stats(values, keys) if stats is None else stats
    scaled = F.when(F.col("kind").isin("change", *DRAMATIC), F.coalesce("confidence", F.lit(1.0))).otherwise(1.0)
    more = F.coalesce(_by_kind(DRAMATIC), F.lit(0.0)) * F.when((F.col("ratio") > 3) | (F.col("ratio") < 0.33), 1.0).when(F.col("ratio").isNotNull(), 0.5).otherwise(0.0)
    own = F.coalesce(_by_kind({k: v[0] for k, v in WEIGHTS.items()}), F.lit(0.0)) * scaled + more
    share = F.coalesce(_by_kind({k: v[1] for k, v in WEIGHTS.items()}), F.lit(0.0))
    reach = F.coalesce(_by_kind({k: v[2] for k, v in WEIGHTS.items()}), F.lit(0))
    d = findings.withColumns({"own": own, "share": share}).withColumn("by", F.explode(F.sequence(-reach, reach)))
    near = F.when(F.col("kind") == "cliff", F.col("share")).otherwise(F.col("own") * F.col("share"))
    here = F.col("by") == 0
    d = d.select(*keys, (F.col("idx") + F.col("by")).alias("idx"), F.when(here, F.col("own")).otherwise(near).alias("weight"), F.when(here, F.col("kind")).alias("kind"))
    has = lambda *kinds: F.coalesce(F.bool_or(F.col("kind").isin(*kinds)), F.lit(False))
    g = d.groupBy(*keys, "idx").agg(F.sum("weight").alias("score"), has("mad").alias("outlier"), has("up", "down").alias("shift"), has("cusum").alias("alarm"), has("cliff").alias("cliff"))
    g = g.withColumn("score", F.col("score") + F.when(F.col("alarm") & ~F.col("cliff") & ~F.col("shift"), 0.5).otherwise(0.0))
    g = g.join(values.select(*keys, "idx", F.col("value").cast("double").alias("value")), ["idx", *keys]).join(stats.select(*keys, "median", "mad"), list(keys))
    g = g.withColumn("far", F.when(F.col("mad") > 0, F.abs(F.col("value") - F.col("median")) / F.col("mad")).otherwise(0.0))
    s, far = F.col("score"), F.col("far")
    single = F.when(far > 10, 0.8).when(far > 7, 0.7).when(far > 5, 0.6).otherwise(0.4)
    g = g.withColumn("confidence", F.when(s >= 3, 0.95).when(s >= 2.5, 0.9).when(s >= 2, 0.85).when(s >= 1.5, 0.7).when(s >= 1, single).otherwise(0.3)).where("confidence >= 0.7 or (far > 7 and score >= 1.5)")
    c = F.col("confidence")
    severity = F.when((c >= 0.95) & (far > 10), "Critical").when((c >= 0.9) | (c >= 0.85) & (far > 7), "High").when((c >= 0.8) | (far > 7), "Medium").otherwise("Low")
    kind = F.when(F.col("outlier") & F.col("alarm"), "Combined").when(F.col("outlier"), "PointOutlier").when(F.col("shift"), "LevelShift").otherwise("TrendChange")
    return g.select(*keys, "idx", "value", kind.alias("type"), "score", "confidence", severity.alias("severity"))


def detect(df: DataFrame, keys: Sequence[str], step_s: float = 1.0) -> dict[str, DataFrame]:
    """Every detector over every series of at least ten seconds, in a few Spark jobs: ``anomalies`` and, of each series, ``changes`` (change points), ``noise`` (class and tau) and ``sizes``.

    Outliers, and the values and distances that the anomalies report, are those of the smoothed series; cliffs, CUSUM,
    change points (windows by each series' own tau) and the noise transitions of three deviations go by the raw one.
    What several detectors read is written once to the shared folder, so plans stay small and nothing stays in memory.
    Detectors that do not read each other run side by side.
    """
    df = cut(df.select(*keys, "idx", F.col("value").cast("double").alias("value")), "samples")
    sizes = cut(df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") - 1) * step_s >= 10), "sizes")
    df = df.join(sizes.select(*keys), list(keys))

    def by_tau() -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        devs = cut(allan(df, keys), "deviations")
        noise = cut(smoothing_tau(devs, keys).join(sizes.select(*keys), list(keys), "right").select(*keys, F.coalesce("noise", F.lit("Unknown")).alias("noise"), F.coalesce("tau", F.lit(30)).cast("long").alias("tau")), "noise")

        def smoothing() -> tuple[DataFrame, DataFrame]:
            smoothed = cut(smooth(df.join(noise, list(keys)), keys, F.col("tau")).select(*keys, "idx", F.col("smoothed").alias("value"), mad_multiplier(F.col("noise")).alias("m")), "smoothed")
            return smoothed, cut(mad_stats(smoothed, keys), "medians")

        (smoothed, stats), changes = together(smoothing, lambda: cut(change_points(df, keys, devs, step_s, noise), "changes"))
        return noise, smoothed, stats, changes

    (noise, smoothed, stats, changes), steps, alarms, turns = together(
        by_tau,
        lambda: cliffs(df, keys),
        lambda: cut(cusum(df, keys, CUSUM_LEVELS), "alarms"),
        lambda: cut(all_noise_transitions(df, keys).select(*keys, "idx", "kind", "confidence", "ratio"), "transitions"),
    )
    one, none = F.lit(1.0).alias("confidence"), F.lit(None).cast("double").alias("ratio")
    mad = mad_outliers(smoothed, keys, F.col("m"), stats=stats).select(*keys, "idx", F.lit("mad").alias("kind"), one, none)
    steps = steps.select(*keys, "idx", F.lit("cliff").alias("kind"), one, none)
    any_level = alarms.select(*keys, "idx", F.lit("cusum").alias("kind"), one, none).distinct()
    shifts = alarms.where("level = 1").select(*keys, "idx", F.col("side").alias("kind"), one, none)
    points = changes.select(*keys, "idx", F.lit("change").alias("kind"), "confidence", none)
    found = cut(mad.unionByName(steps).unionByName(any_level).unionByName(shifts).unionByName(points).unionByName(turns), "findings")
    return {"anomalies": cut(score(found, smoothed, keys, stats), "anomalies"), "changes": changes, "noise": noise, "sizes": sizes}


def anomaly_summary(anomalies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by severity, most first."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return anomalies.groupBy(*keys).agg(F.count("*").alias("total"), n("Critical"), n("High"), n("Medium"), n("Low")).orderBy(F.desc("total"), *keys)


def confidence_score(anomalies: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, confidence) of every series in ``sizes``: the mean confidence of its anomalies, less by what their share is over a tenth (by a half at most); 1 without any."""
    g = sizes.join(anomalies.groupBy(*keys).agg(F.avg("confidence").alias("__c"), F.count("*").alias("__found")), list(keys), "left")
    rate = F.col("__found") / F.col("n")
    less = F.when(rate > 0.1, 1 - F.least(rate - 0.1, F.lit(0.5))).otherwise(1.0)
    return g.select(*keys, F.coalesce(F.col("__c") * less, F.lit(1.0)).alias("confidence"))
