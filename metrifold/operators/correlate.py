"""Lagged cross-correlation of series pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lags in seconds that are tried on either side of 0; fixed values.
LAG_SECONDS = (1, 2, 5, 10, 15, 30, 60, 120, 300)


def lag_steps(step_s: float) -> list[int]:
    """The lags in steps."""
    out = {0} | {int(s / step_s) for s in LAG_SECONDS if s >= step_s}
    return sorted(out | {-x for x in out})


def span_steps(df: DataFrame) -> DataFrame:
    """One row: how many steps the series (idx) span."""
    return df.agg((F.max("idx") + 1).alias("steps"))


def candidate_pairs(c: DataFrame) -> DataFrame:
    """Ordered pairs of candidates (rank, metric, base) with different base metrics; the list is capped before (T03), so this is a join of a dozen rows."""
    a, b = c.select([F.col(x).alias(f"{x}_a") for x in c.columns]), c.select([F.col(x).alias(f"{x}_b") for x in c.columns])
    return a.join(b, (F.col("rank_a") < F.col("rank_b")) & (F.col("base_a") != F.col("base_b")))


def lag_join(df: DataFrame, pairs: DataFrame, lags: Sequence[int], span: DataFrame | None = None) -> DataFrame:
    """(pair, lag, x, y): x[i + lag] with y[i] for every pair (pair, a, b) of series in ``df`` (series, idx, value); lags spread the rows, joins are equi-joins. With ``span`` only lags of up to a third of it."""
    left = df.join(pairs, F.col("series") == F.col("a")).withColumn("lag", F.explode(F.array(*[F.lit(x).cast("long") for x in lags]))).select("pair", "lag", "b", (F.col("idx") - F.col("lag")).alias("i"), F.col("value").cast("double").alias("x"))
    if span is not None:
        left = left.join(F.broadcast(span), F.abs("lag") * 3 <= F.col("steps"))  # one row
    right = df.select(F.col("series").alias("b"), F.col("idx").alias("i"), F.col("value").cast("double").alias("y"))
    return left.join(right, ["b", "i"]).select("pair", "lag", "x", "y")


def xcorr(joined: DataFrame, least: int = 3) -> DataFrame:
    """Pearson r of each (pair, lag) with at least ``least`` points; 0 where a side hardly varies."""
    # central moments merge without the loss of digits that sums of squares have at large means
    g = joined.groupBy("pair", "lag").agg(F.count("*").alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c")).where(F.col("n") >= least)
    flat = F.sqrt(F.col("vx") * F.col("vy")) * F.col("n") * F.col("n") < 1e-10
    return g.select("pair", "lag", "n", F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.col("c"), F.sqrt("vx") * F.sqrt("vy"))).alias("r"))


def best_lag(r: DataFrame, step_s: float, least: int = 5) -> DataFrame:
    """The lag of the greatest |r| over 0 (the lowest on ties), in whole seconds too; none where it rests on fewer than ``least`` points."""
    g = r.where(F.abs("r") > 0).groupBy("pair").agg(F.max_by(F.struct("lag", "r", "n"), F.struct(F.abs("r"), -F.col("lag"))).alias("b"))
    g = g.where(F.col("b.n") >= least)
    return g.select("pair", F.col("b.lag").alias("lag"), (F.col("b.lag") * int(step_s)).alias("lag_s"), F.col("b.r").alias("r"), F.col("b.n").alias("n"))


def correlate(df: DataFrame, pairs: DataFrame, step_s: float) -> DataFrame:
    """Every pair's best lag of up to 300 s and a third of the span, strongest first."""
    return best_lag(xcorr(lag_join(df, pairs, lag_steps(step_s), span_steps(df))), step_s).orderBy(F.desc(F.abs("r")), "pair")


def _extreme(x: np.ndarray, y: np.ndarray, boxes: tuple, sign: float, rounds: int = 50) -> float:
    """A local extreme of r over the boxes' corners by greedy moves from five starts."""
    xl, xh, yl, yh = boxes
    best = -2.0
    starts = [(x, y), (xl, yl), (xh, yh), (np.where(x > x.mean(), xh, xl), np.where(y > y.mean(), yh, yl)), (np.where(x > x.mean(), xl, xh), np.where(y > y.mean(), yl, yh))]
    for a, b in starts:
        a, b = a.copy(), b.copy()
        now = _r(a, b) * sign
        for _ in range(rounds):
            da, db = a - a.mean(), b - b.mean()
            sa, sb = max((da * da).sum(), 1e-12), max((db * db).sum(), 1e-12)
            num = (da * db).sum()
            ga = (db - num / sa * da) * sign  # the direction in which each point raises r
            gb = (da - num / sb * db) * sign
            a2, b2 = np.where(ga > 0, xh, np.where(ga < 0, xl, a)), np.where(gb > 0, yh, np.where(gb < 0, yl, b))
            options = [(a2, b), (a, b2), (a2, b2)]
            values = [_r(p, q) * sign for p, q in options]
            k = int(np.argmax(values))
            if values[k] <= now + 1e-12:
                break
            (a, b), now = options[k], values[k]
        best = max(best, now)
    return float(np.clip(best * sign, -1, 1))


def _r(a: np.ndarray, b: np.ndarray) -> float:
    da, db = a - a.mean(), b - b.mean()
    den = np.sqrt((da * da).sum() * (db * db).sum())
    return 0.0 if den < 1e-10 else float((da * db).sum() / den)


def r_band(points: DataFrame) -> DataFrame:
    """(pair, r, r_min, r_max): what r can be while each point moves within its box; ``points`` has pair, x, xlo, xhi, y, ylo, yhi.

    One task handles one pair's points, a display-sized series; pairs run in parallel.
    """

    def band(pdf: pd.DataFrame) -> pd.DataFrame:
        x, xl, xh, y, yl, yh = (pdf[c].to_numpy(float) for c in ("x", "xlo", "xhi", "y", "ylo", "yhi"))
        r = _r(x, y)
        lo, hi = _extreme(x, y, (xl, xh, yl, yh), -1.0), _extreme(x, y, (xl, xh, yl, yh), 1.0)
        return pd.DataFrame({"pair": [pdf["pair"].iat[0]], "r": [r], "r_min": [min(lo, r)], "r_max": [max(hi, r)]})

    return points.groupBy("pair").applyInPandas(band, "pair string, r double, r_min double, r_max double")


def correlation_features(r: DataFrame, attributes: DataFrame, least: float = 0.7, n: int = 10) -> DataFrame:
    """Finite |r| of at least ``least``, the strongest ``n``, with whether both sides are of one subsystem; ``r`` has a, b, r."""
    s = attributes.select("metric", "subsystem")
    d = r.where(r["r"].isNotNull() & ~F.isnan("r") & (F.abs("r") >= least))
    d = d.join(s.select(F.col("metric").alias("a"), F.col("subsystem").alias("sa")), "a", "left").join(s.select(F.col("metric").alias("b"), F.col("subsystem").alias("sb")), "b", "left")
    return top_correlations(d.withColumn("scope", F.when(F.col("sa") == F.col("sb"), "SameSubsystem").otherwise("CrossSubsystem")), n)


def top_correlations(d: DataFrame, n: int = 10) -> DataFrame:
    return d.orderBy(F.desc(F.abs("r")), "a", "b").limit(n)


def select_candidates(metrics: DataFrame, consumers: DataFrame, cap: int = 12) -> DataFrame:
    """The ``cap`` most salient metrics, top consumers joining with salience 0; names break ties."""
    extra = consumers.join(metrics, "metric", "left_anti").select("metric", F.lit(0.0).alias("salience"))
    d = metrics.select("metric", "salience").unionByName(extra).orderBy(F.desc("salience"), "metric").limit(cap)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("salience"), "metric")))  # of at most ``cap`` rows
