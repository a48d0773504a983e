"""Joins of series with series, of samples with annotations, and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrifold.operators.base import has_band, idiv


def _op(op: str, a: Column, b: Column) -> Column:
    return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op]


def band(op: str, alo: Column, ahi: Column, blo: Column, bhi: Column) -> tuple[Column, Column]:
    """Bounds over the four corners; a quotient has none where the divisor may be zero."""
    corners = [_op(op, x, y) for x in (alo, ahi) for y in (blo, bhi)]
    lo, hi = F.least(*corners), F.greatest(*corners)
    if op == "/":
        crosses = (blo <= 0) & (bhi >= 0)
        lo, hi = F.when(~crosses, lo), F.when(~crosses, hi)
    return lo, hi


def binop(a: DataFrame, b: DataFrame, op: str, on: Sequence[str] | None = None, ignoring: Sequence[str] = (), many: str | None = None, align: int | None = None, widen: bool = False) -> DataFrame:
    """``a op b`` at equal times and labels.

    ``on`` names the matching labels (all common ones if None, less ``ignoring``); with [] a single series is met
    by every row. ``many`` ("left") keeps all labels of the left side. ``align`` puts both on a grid of that step
    first, bands and windows with it; ``widen`` adds the time between the two acquisition windows' ends (in s) times the
    value's own band to either side. A label that both sides lack matches. Keys that stand twice on the right, or on the
    left where not all its labels are kept, are an error when the query runs, as in one-to-one matching.
    """
    value = {"value", "lo", "hi", "ts_ns", "window_end_ns", "window_begin_ns", "window_width_ns"}
    labels = [c for c in a.columns if c not in value]
    if on is None:
        on = [c for c in labels if c in b.columns and c not in ignoring]
    if align:
        from metrifold.operators.rates import gauge_grid

        a = gauge_grid(a, labels, align)
        b = gauge_grid(b, [c for c in b.columns if c not in value], align)
    keep = labels if many == "left" or not on else list(on)
    key = F.struct(*on, "ts_ns").alias("__k")  # a struct, so that nulls match
    left = a.select(key, *keep, "ts_ns", *[F.col(c).alias(f"__a_{c}") for c in a.columns if c in value - {"ts_ns"}])
    right = b.select(key, *[F.col(c).alias(f"__b_{c}") for c in b.columns if c in value - {"ts_ns"}])
    if keep == list(on) and on:
        left = _single(left, "left")
    j = left.join(_single(right, "right"), "__k")
    out = {"value": _op(op, F.col("__a_value").cast("double"), F.col("__b_value").cast("double"))}
    if has_band(a) or has_band(b):
        side = lambda s, d: (F.coalesce(F.col(f"__{s}_lo"), F.col(f"__{s}_value")), F.coalesce(F.col(f"__{s}_hi"), F.col(f"__{s}_value"))) if has_band(d) else (F.col(f"__{s}_value"),) * 2
        out["lo"], out["hi"] = band(op, *side("a", a), *side("b", b))
        if widen and "window_end_ns" in a.columns and "window_end_ns" in b.columns:
            apart = (F.greatest("__a_window_end_ns", "__b_window_end_ns") - F.least("__a_window_begin_ns", "__b_window_begin_ns")) / 1e9
            spread = (out["hi"] - out["lo"]) * apart
            out["lo"], out["hi"] = out["lo"] - spread, out["hi"] + spread
    return j.select(*keep, "ts_ns", *[c.alias(n) for n, c in out.items()])


def _single(df: DataFrame, side: str) -> DataFrame:
    """``df`` with one row for each ``__k``; a second one fails the query."""
    rest = [c for c in df.columns if c != "__k"]
    one = df.groupBy("__k").agg(F.count("*").alias("__n"), F.first(F.struct(*rest)).alias("__r"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"several samples on the {side} match at "), F.col("__k").cast("string"))).cast(one.schema["__r"].dataType)).otherwise(F.col("__r"))
    return one.select("__k", checked.alias("__r")).select("__k", *[F.col(f"__r.{c}").alias(c) for c in rest])


def duplicate_matches(b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Right-side keys that stand more than once: a many-to-one match must have none."""
    return b.groupBy(*on, "ts_ns").agg(F.count("*").alias("n")).where("n > 1")


def annotate_samples(df: DataFrame, annotations: DataFrame, slot: int) -> DataFrame:
    """Samples with the annotations in whose time and scope they lie; null scopes fit all.

    An annotation is dealt to the time slots it touches, so the range join is an equi-join on slots. They are ``slot`` wide,
    or as wide as the longest annotation where that is less: then each touches two at most and few pairs miss it.
    """
    longest = annotations.agg(F.greatest(F.lit(1), F.least(F.lit(slot), F.max("duration_ns"))).cast("long").alias("__width"))
    end = F.col("ts_ns") + F.coalesce(F.col("duration_ns"), F.lit(0))
    a = annotations.select(F.col("ts_ns").alias("a_start"), end.alias("a_end"), "id", "description", *[F.col(c).alias(f"a_{c}") for c in ("source", "node", "instance")])
    width = F.col("__width")
    a = a.join(F.broadcast(longest)).withColumn("__slot", F.explode(F.sequence(idiv(F.col("a_start"), width), idiv(F.col("a_end"), width)))).drop("__width")  # one row
    j = df.join(F.broadcast(longest)).withColumn("__slot", idiv(F.col("ts_ns"), width)).drop("__width").join(a, "__slot").where(F.col("ts_ns").between(F.col("a_start"), F.col("a_end")))
    for c in ("source", "node", "instance"):
        if c in df.columns:
            j = j.where(F.coalesce(F.col(f"a_{c}"), F.col(c)).eqNullSafe(F.col(c)))
    return j.drop("__slot", "a_source", "a_node", "a_instance")


def attribute(catalog: DataFrame, exact: DataFrame, prefixes: DataFrame, ambiguous: Sequence[str] = (), agent: str = "agent") -> DataFrame:
    """``subsystem`` of each metric: its sampler label, else for the agent's metrics the exact table, else the longest prefix that ends at an underscore; ambiguous names stay without."""
    c = catalog.join(exact.select("metric", F.col("subsystem").alias("__exact")), "metric", "left")
    heads = F.transform(F.sequence(F.lit(1), F.size(F.split("metric", "_"))), lambda n: F.array_join(F.slice(F.split("metric", "_"), F.lit(1), n), "_"))
    hits = catalog.select("metric").distinct().withColumn("prefix", F.explode(heads)).join(prefixes.select("prefix", F.col("subsystem").alias("__prefix")), "prefix")
    best = hits.groupBy("metric").agg(F.max_by("__prefix", F.length("prefix")).alias("__prefix"))
    c = c.join(best, "metric", "left")
    known = F.when((F.col("source") == agent) & ~F.col("metric").isin(*ambiguous), F.coalesce("__exact", "__prefix"))
    return c.withColumn("subsystem", F.coalesce("sampler", known)).drop("__exact", "__prefix")


def coverage(universe: DataFrame, present: DataFrame, uncertain_domains: DataFrame, uncertain_samplers: DataFrame) -> DataFrame:
    """Metrics of the universe that are surely absent: not present, and of no uncertain domain or sampler."""
    return universe.join(present.select("metric"), "metric", "left_anti").join(uncertain_domains.select("domain"), "domain", "left_anti").join(uncertain_samplers.select("sampler"), "sampler", "left_anti")


def describe_metrics(catalog: DataFrame, by_source: DataFrame, top: DataFrame) -> DataFrame:
    """A metric's description from its source, else from the top level."""
    c = catalog.join(by_source.select("source", "metric", F.col("description").alias("__own")), ["source", "metric"], "left")
    return c.join(top.select("metric", F.col("description").alias("__top")), "metric", "left").withColumn("description", F.coalesce("__own", "__top")).drop("__own", "__top")


def pair_kpis(members: DataFrame, titles: DataFrame, available: DataFrame) -> DataFrame:
    """(category, title, ok, missing): a category's KPIs, present in all its members under each one's own title for it; the members without it otherwise.

    ``members`` (category, member), ``titles`` (category, title, member, own_title), ``available`` (member, title).
    """
    want = titles.select("category", "title").distinct().join(members.select("category", "member"), "category").join(titles.select("category", "title", "member", "own_title"), ["category", "title", "member"], "left")
    have = available.select("member", F.col("title").alias("__t"), F.lit(True).alias("__have")).distinct()
    w = want.withColumn("__t", F.coalesce("own_title", "title")).join(have, ["member", "__t"], "left")
    return w.groupBy("category", "title").agg(F.bool_and(F.coalesce("__have", F.lit(False))).alias("ok"), F.array_sort(F.collect_list(F.when(F.col("__have").isNull(), F.col("member")))).alias("missing"))


def common_labels(a: DataFrame, b: DataFrame, labels: Sequence[str]) -> DataFrame:
    return a.select(*labels).intersect(b.select(*labels))


def normalize_annotations(*sets: DataFrame) -> DataFrame:
    """All annotations, of equal non-empty ids the earliest, by time and id."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy("ts_ns", "description")
    named = out.where("id is not null and id <> ''").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return named.unionByName(out.where("id is null or id = ''")).orderBy("ts_ns", "id")
