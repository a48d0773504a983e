"""Stability deviations of indexed series (keys, idx, value) and what follows from them.

Estimators are the published ones (IEEE 1139), values taken as phase data at unit spacing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrifold.operators import scan
from metrifold.operators.base import idiv


def taus_up_to(n: int) -> list[int]:
    """1, then half as much again (one more at least), up to n / 3."""
    out, t = [], 1
    while t <= n // 3:
        out.append(t)
        t = max(t + 1, int(t * 1.5))
    return out


_TAUS = tuple(taus_up_to(3 * 10**12))
_CHUNK = 4096
#: In segments of _CHUNK points: a block, its longest tau and the residues of a tile (at most the longest tau); and a tile's places.
_LAYOUT = (64, 16, 8, 8)
#: Of each kind of deviation what it takes differences of, values or running sums, and their order.
_PARTS = {"allan": ("x", 2), "hadamard": ("x", 3), "mod_allan": ("s", 3)}
_STEPS = {2: (1.0, -2.0, 1.0), 3: (-1.0, 3.0, -3.0, 1.0)}


def _squares(x: np.ndarray, there: np.ndarray | None, valued: np.ndarray | None, order: int, tau: int, starts: int) -> tuple[float, int]:
    """Sum of the squared differences over rows that are ``tau`` apart from each of the first ``starts`` rows, and their number; differences of a null are counted with no square."""
    m = min(starts, x.shape[0] - order * tau)
    if m <= 0:
        return 0.0, 0
    part = lambda a, k: a[k * tau : k * tau + m]
    diff = sum(c * part(x, k) for k, c in enumerate(_STEPS[order]))
    if there is None:
        return float(np.sum(diff * diff)), diff.size
    both = np.logical_and.reduce([part(there, k) for k in range(order + 1)])
    use = np.logical_and.reduce([part(valued, k) for k in range(order + 1)])
    return float(np.sum(diff[use] ** 2)), int(both.sum())


def _difference_sums(df: DataFrame, keys: Sequence[str], order: int, column: str = "value", spare: int = 0) -> DataFrame:
    """(keys, tau, squares, count): the differences of points at idx, idx + tau, ... for each tau that the series' length allows.

    Points are packed into segments. For short taus a segment goes to its block, and to those before it that reach
    into it; for each longer tau, to tiles of neighbouring residues (points a multiple of tau apart have one residue) and some
    places of each. A tile or block is a matrix of bounded size, and no task holds a series. ``spare`` rows of a series are no points.
    """
    size, places = _CHUNK, _LAYOUT[3]
    span, reach, width = (size * k for k in _LAYOUT[:3])
    at = lambda c, n: F.call_function("div", c, n if isinstance(n, Column) else F.lit(n))
    span_of = lambda a, b: F.explode(F.sequence(a, b))
    d = df.select(*keys, F.col("idx").cast("long").alias("idx"), F.col(column).cast("double").alias("x"))
    segments = d.groupBy(*keys, at(F.col("idx"), size).alias("segment")).agg(F.array_sort(F.collect_list(F.struct((F.col("idx") % size).cast("int").alias("o"), "x"))).alias("p"))
    sizes = segments.groupBy(*keys).agg((F.sum(F.size("p")) - spare).alias("n"))
    whole_one = F.element_at("p", -1)["o"] == F.size("p") - 1
    segments = segments.select(*keys, (F.col("segment") * size).alias("s0"), F.when(~whole_one, F.col("p.o")).alias("o"), F.col("p.x").alias("x"))
    j = segments.withColumn("__k", F.struct(*keys)).join(sizes.select(F.struct(*keys).alias("__k"), "n"), "__k").drop("__k").where("n >= 3")
    last = F.col("s0") + size - 1
    blocks = j.select("*", F.lit(0).cast("long").alias("tau"), F.lit(0).cast("long").alias("tile"), span_of(F.greatest(F.lit(0), at(F.col("s0") - order * reach, span)), at(last, span)).alias("part"))
    long_taus = F.filter(F.array(*[F.lit(t).cast("long") for t in _TAUS if t > reach]), lambda t: t * 3 <= F.col("n"))
    tiles = j.where(F.col("n") > 3 * reach).select("*", F.explode(long_taus).alias("tau"))
    tiles = tiles.select("*", span_of(at(F.col("s0"), F.col("tau")), at(last, F.col("tau"))).alias("place"))
    base = F.col("place") * F.col("tau")
    tiles = tiles.select("*", span_of(at(F.greatest(F.col("s0") - base, F.lit(0)), width), at(F.least(last - base, F.col("tau") - 1), width)).alias("tile"))
    part = at(F.col("place"), places)
    early = (F.col("place") % places < order) & (part > 0)
    tiles = tiles.withColumn("part", F.explode(F.when(early, F.array(part - 1, part)).otherwise(F.array(part)))).drop("place")

    def sums(group: pa.Table) -> pa.Table:
        n, tau, tile, at_part = (group.column(c)[0].as_py() for c in ("n", "tau", "tile", "part"))
        # the runs of points that stand one below the other: a block is one run, a tile one for each place
        if tau:
            runs, length, starts = range(at_part * places, at_part * places + places + order), min(width, tau - tile * width), places
            origin = {p: p * tau + tile * width for p in runs}
        else:
            runs, length, starts = range(1), span + order * reach, span
            origin = {0: at_part * span}
        x = np.full((len(runs), length), np.nan)
        there, valued = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
        for s0, o, v in zip(group.column("s0").to_pylist(), group.column("o"), group.column("x"), strict=True):
            v = v.values
            i = s0 + (o.values.to_numpy() if o.is_valid else np.arange(len(v)))
            known, v = v.is_valid().to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False)
            for row, p in enumerate(runs):
                a, b = np.searchsorted(i, (origin[p], origin[p] + length))
                if a < b:
                    to = i[a:b] - origin[p]
                    x[row, to], there[row, to], valued[row, to] = v[a:b], True, known[a:b]
        if not tau:
            end = int(np.flatnonzero(there[0])[-1]) + 1
            x, there, valued = x[0, :end], there[0, :end], valued[0, :end]
        full = there.all() and valued.all()
        steps = [(tau, 1)] if tau else [(t, t) for t in _TAUS if t <= reach and t * 3 <= n]
        out = [(t, *_squares(x, None if full else there, None if full else valued, order, by, starts)) for t, by in steps]
        out = [r for r in out if r[2]]
        names = pa.table({k: pa.chunked_array([group.column(k).slice(0, 1).combine_chunks().take(pa.array([0] * len(out), pa.int64()))]) for k in keys})
        for name, kind, c in (("tau", pa.int64(), 0), ("squares", pa.float64(), 1), ("count", pa.int64(), 2)):
            names = names.append_column(name, pa.array([r[c] for r in out], kind))
        return names

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "tau long, squares double, count long"])
    parts = blocks.unionByName(tiles).groupBy(*keys, "tau", "tile", "part").applyInArrow(sums, schema)
    return parts.groupBy(*keys, "tau").agg(F.sum("squares").alias("squares"), F.sum("count").alias("count"))


def _deviation(sums: DataFrame, keys: Sequence[str], scale: Column) -> DataFrame:
    return sums.select(*keys, "tau", F.sqrt(F.col("squares") / (scale * F.col("count"))).alias("dev"))


def allan(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, tau, dev): Allan deviation."""
    return _deviation(_difference_sums(df, keys, 2), keys, 2.0 * F.col("tau") * F.col("tau"))


def hadamard(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, tau, dev): Hadamard deviation."""
    return _deviation(_difference_sums(df, keys, 3), keys, 6.0 * F.col("tau") * F.col("tau"))


def _sums_before(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, idx, value, s): the sum of the values before each idx, and a last row with the sum of all and no value."""
    sums = scan.prefix_sums(scan.chunked(df, keys, "idx"), {"s": F.col("value").cast("double")}, "idx").withColumn("s", F.col("s") - F.col("value"))
    ends = df.groupBy(*keys).agg((F.max("idx") + 1).alias("idx"), F.sum(F.col("value").cast("double")).alias("s"))
    return sums.select(*keys, "idx", "value", "s").unionByName(ends, allowMissingColumns=True)


def mod_allan(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, tau, dev): modified Allan deviation, by differences of running sums."""
    t = F.col("tau").cast("double")
    return _deviation(_difference_sums(_sums_before(df, keys), keys, 3, "s", spare=1), keys, 2.0 * t * t * t * t)


DEVIATIONS = {"allan": allan, "hadamard": hadamard, "mod_allan": mod_allan}


def noise_class_of(slope: Column) -> Column:
    return F.when(slope < -0.75, "WhitePhase").when(slope < -0.25, "FlickerPhase").when(slope < 0.25, "FlickerFrequency").when(slope < 0.75, "RandomWalk").otherwise("FlickerWalk")


def noise_class(devs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Class from the slope of log deviation over log tau; Unknown with fewer than three taus or two usable."""
    use = F.col("dev") > 0
    x, y = F.when(use, F.ln("tau")), F.when(use, F.ln("dev"))
    g = devs.groupBy(*keys).agg(F.count("*").alias("n"), F.count(x).alias("u"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"))
    slope = F.try_divide(F.col("u") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("u") * F.col("sxx") - F.col("sx") * F.col("sx"))
    known = (F.col("n") >= 3) & (F.col("u") >= 2) & slope.isNotNull()
    return g.select(*keys, F.when(known, slope).alias("slope"), F.when(known, noise_class_of(slope)).otherwise("Unknown").alias("noise"))


def cycle_minima(devs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Local minima over tau: likely cycles, with confidence min(depth / mean deviation, 1); cyclic above 0.7."""
    w = Window.partitionBy(*keys).orderBy("tau")
    d = devs.withColumns({"l": F.lag("dev").over(w), "r": F.lead("dev").over(w), "mean": F.avg("dev").over(Window.partitionBy(*keys))})
    d = d.where((F.col("dev") < F.col("l")) & (F.col("dev") < F.col("r")))
    depth = (F.col("l") + F.col("r")) / 2 - F.col("dev")
    conf = F.least(F.coalesce(F.try_divide(depth, F.col("mean")), F.lit(0.0)), F.lit(1.0))
    return d.select(*keys, "tau", "dev", conf.alias("confidence"), (conf > 0.7).alias("cyclic"))


def dev_at(devs: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """The deviation at each of ``wanted`` (keys, at): log-log between non-zero points, clamped at the ends."""
    j = devs.where("dev > 0").join(wanted, list(keys))
    g = j.groupBy(*keys, "at").agg(
        F.max(F.when(F.col("tau") <= F.col("at"), F.struct("tau", "dev"))).alias("a"),
        F.min(F.when(F.col("tau") >= F.col("at"), F.struct("tau", "dev"))).alias("b"),
    )
    part = (F.ln("at") - F.ln("a.tau")) / (F.ln("b.tau") - F.ln("a.tau"))
    mid = F.exp(F.ln("a.dev") + part * (F.ln("b.dev") - F.ln("a.dev")))
    return g.select(*keys, "at", F.when(F.col("a").isNull(), F.col("b.dev")).when(F.col("b").isNull(), F.col("a.dev")).when(F.col("a.tau") == F.col("b.tau"), F.col("a.dev")).otherwise(mid).alias("dev"))


def smoothing_tau(devs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most confident cycle's tau, else by noise class 15 steps for phase noise, 60 for random and flicker walk, and 30."""
    best = cycle_minima(devs, keys).groupBy(*keys).agg(F.max_by("tau", F.struct("confidence", -F.col("tau"))).alias("cycle"))
    steps = F.when(F.col("noise").isin("WhitePhase", "FlickerPhase"), 15).when(F.col("noise").isin("RandomWalk", "FlickerWalk"), 60).otherwise(30)
    return noise_class(devs, keys).join(best, list(keys), "left").select(*keys, "noise", F.coalesce("cycle", steps.cast("long")).alias("tau"))


def smooth(df: DataFrame, keys: Sequence[str], width: Column | int) -> DataFrame:
    """Centred moving mean; unchanged if width <= 2 or n < 2 width.

    Inside the series it spans half the width (rounded down) on either side of a point and the point itself; nearer
    to an end than that, the first or last ``width`` points. The width (a column or number) may differ by series, so
    the mean is a difference of running sums joined at computed bounds.
    """
    d = df.withColumn("w", (width if isinstance(width, Column) else F.lit(width)).cast("long"))
    sizes = d.groupBy(*keys).agg(F.count("*").alias("n"))
    d = scan.plain(scan.with_series(scan.prefix_sums(scan.chunked(d, keys, "idx"), {"s": F.col("value").cast("double")}, "idx"), sizes, keys))
    half, i = F.floor(F.col("w") / 2), F.col("idx")
    early, late = i < half, i + half >= F.col("n")
    start = F.when(early, 0).when(late, F.col("n") - F.col("w")).otherwise(i - half)
    end = F.when(early, F.col("w")).when(late, F.col("n")).otherwise(i + half + 1)
    d = d.withColumns({"from": (start - 1).cast("long"), "to": (end - 1).cast("long")})
    at = d.select(*keys, F.col("idx").alias("__i"), F.col("s").alias("__s"))
    hi = at.withColumnsRenamed({"__i": "to", "__s": "s_to"})
    lo = at.withColumnsRenamed({"__i": "from", "__s": "s_from"})
    # the place leads the join keys: sorts by a name first compare whole rows
    j = d.join(hi, ["to", *keys], "left").join(lo, ["from", *keys], "left").select(*d.columns, "s_to", "s_from")
    mean = (F.col("s_to") - F.coalesce("s_from", F.lit(0.0))) / (F.col("to") - F.col("from"))
    out = F.when((F.col("w") <= 2) | (F.col("n") < 2 * F.col("w")), F.col("value").cast("double")).otherwise(mean)
    return j.withColumn("smoothed", out).drop("w", "n", "s", "from", "to", "s_to", "s_from")


def noise_transitions(df: DataFrame, keys: Sequence[str], kind: str = "allan") -> DataFrame:
    """The transitions of one deviation."""
    return all_noise_transitions(df, keys, (kind,)).drop("kind")


def all_noise_transitions(df: DataFrame, keys: Sequence[str], kinds: Sequence[str] = tuple(DEVIATIONS)) -> DataFrame:
    """Windows of max(n/4, 50) points, each half over the last: where the deviation at tau max(w/10, 2) more than doubles or halves.

    Series of at least 100 points; confidence is 0.8 beyond a ratio of 3 or 0.33, else 0.7.

    One pass serves all kinds: a point goes once to each window that it is in, to a tile of neighbouring residues by tau, where
    differences are those of a matrix's rows; the windows of a short series share a tile. Differences that reach beyond a window lack a part and are not counted.
    """
    size = _CHUNK
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("w", F.greatest(F.floor(F.col("n") / 4), F.lit(50)).cast("long")).where("n >= 100").withColumn("m", F.greatest(F.floor(F.col("w") / 10), F.lit(2)).cast("long"))
    hop = F.floor(F.col("w") / 2)
    d = scan.plain(scan.with_series(scan.chunked(_sums_before(df, keys), keys, "idx"), sizes, keys)).withColumn("win", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("idx") - F.col("w") - 1) / hop) + 1).cast("long"), F.floor(F.col("idx") / hop).cast("long"))))
    end = F.col("win") * hop + F.col("w")
    d = d.where((F.col("idx") >= F.col("win") * hop) & (F.col("idx") <= end) & (end <= F.col("n")))  # a running sum stands at the end, a value does not
    at = (F.col("idx") - F.col("win") * hop).cast("long")
    pts = d.select(*keys, "win", "w", F.col("m").alias("tau"), at.alias("at"), F.when(F.col("idx") < end, F.col("value").cast("double")).alias("x"), "s")
    pts = pts.withColumns({"tile": idiv(F.col("at") % F.col("tau"), size), "part": F.when(F.col("w") > size, F.col("win")).otherwise(-1)})

    def squares(group: pa.Table) -> pa.Table:
        w, tau, tile = (group.column(c)[0].as_py() for c in ("w", "tau", "tile"))
        win, at = group.column("win").to_numpy(), group.column("at").to_numpy()
        wins, nth = np.unique(win, return_inverse=True)
        shape = (len(wins), w // tau + 1, min(size, tau - tile * size))
        to = (nth, at // tau, at % tau - tile * size)
        values, known = {}, {}
        for name in ("x", "s"):
            c = group.column(name).combine_chunks()
            values[name], known[name] = np.zeros(shape), np.zeros(shape, bool)
            valid = c.is_valid().to_numpy(zero_copy_only=False)
            known[name][to] = valid
            values[name][to] = np.where(valid, c.to_numpy(zero_copy_only=False), 0.0)
        out = pa.table({k: group.column(k).take(pa.array([0] * len(wins), pa.int64())) for k in keys})
        out = out.append_column("win", pa.array(wins, pa.int64())).append_column("w", pa.array([w] * len(wins), pa.int64())).append_column("tau", pa.array([tau] * len(wins), pa.int64()))
        for kind in kinds:
            name, order = _PARTS[kind]
            rows = max(shape[1] - order, 0)
            part = lambda a: [a[:, k : k + rows] for k in range(order + 1)]  # noqa: B023, E731
            use = np.logical_and.reduce(part(known[name]))
            diff = sum(c * v for c, v in zip(_STEPS[order], part(values[name]), strict=True))
            out = out.append_column(f"q_{kind}", pa.array(np.sum(np.where(use, diff * diff, 0.0), axis=(1, 2)), pa.float64())).append_column(f"n_{kind}", pa.array(use.sum(axis=(1, 2)), pa.int64()))
        return out

    of = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {of[k]}" for k in keys), "win long, w long, tau long", *(f"q_{kind} double, n_{kind} long" for kind in kinds)])
    parts = pts.groupBy(*keys, "part", "tile").applyInArrow(squares, schema)
    t = F.col("tau").cast("double")
    scales = {"allan": 2.0 * t * t, "hadamard": 6.0 * t * t, "mod_allan": 2.0 * t * t * t * t}
    dev = lambda kind: F.sqrt(F.try_divide(F.sum(f"q_{kind}"), scales[kind] * F.sum(f"n_{kind}")))
    devs = parts.groupBy(*keys, "win", "w", "tau").agg(*[dev(kind).alias(kind) for kind in kinds])
    devs = devs.select(*keys, "win", "w", F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("dev")) for kind in kinds])))
    ratio = F.try_divide(F.col("dev"), F.lag("dev").over(Window.partitionBy(*keys, "kind").orderBy("win")))
    out = devs.withColumn("ratio", ratio).where((F.col("ratio") > 2) | (F.col("ratio") < 0.5))
    conf = F.when((F.col("ratio") > 3) | (F.col("ratio") < 0.33), 0.8).otherwise(0.7)
    return out.select(*keys, (F.col("win") * F.floor(F.col("w") / 2)).cast("long").alias("idx"), "kind", "dev", "ratio", conf.alias("confidence"))
