"""KPI templates compiled to one aggregation.

A template is a JSON document of a service: ``service``, ``aliases`` and ``kpis``. A KPI says in structure, not in
query text, what it is: ``kind`` (counter, gauge or histogram), ``select`` (selectors whose product is taken), ``over`` (a product
to divide by), ``plus`` (added to the divisor), ``scale``, ``by`` (a label), ``fn`` (sum, avg or max), ``quantiles``, ``role`` and
``denominator``. All KPIs of a directory become one aggregation of samples and one of histograms; a KPI that can't be
compiled is a failure row with its reason. A file more is a KPI more, without code.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrifold.operators import compare as M
from metrifold.operators import histogram as H

TEMPLATE = "service string, aliases array<string>, kpis array<struct<role:string,title:string,kind:string,select:array<string>,over:array<string>,plus:array<string>,scale:double,by:string,fn:string,quantiles:array<double>,denominator:boolean>>"
QUANTILES = (0.5, 0.9, 0.99, 0.999, 0.9999)
MOST = 10_000  # KPIs of a directory: they are configuration, and the plan holds them
_SELECTOR = r"([^{]+)(?:\{(\w+)(=~|!~|=)(.*)\})?"


@dataclass(frozen=True)
class View:
    """scale x product of ``num`` / product of ``den`` (1 less that with ``rest``), each summed by ``by``; selectors are ``metric`` or ``metric{label=value}``, with ``=~`` or ``!~`` a pattern of the whole label (``!~`` also where it is missing)."""

    name: str
    num: tuple[str, ...]
    den: tuple[str, ...] = ()
    scale: float = 1.0
    by: str | None = None
    rest: bool = False
    fn: str = "sum"
    also: tuple[str, ...] = field(default=())  # added to the divisor


FNS = {"sum": F.sum, "avg": F.avg, "max": F.max}


def parts(selector: str) -> tuple[str, str | None, str | None, str | None]:
    """Metric, label, operator and value."""
    m = re.fullmatch(_SELECTOR, selector)
    return m[1], m[2], m[3], m[4]


def matches(selector: str) -> Column:
    name, key, op, value = parts(selector)
    test = F.col("metric") == name
    if key is None:
        return test
    label = F.try_element_at("labels", F.lit(key))
    if op == "=":
        return test & (label == value)
    hit = F.coalesce(label, F.lit("")).rlike(f"^(?:{value})$")
    return test & (hit if op == "=~" else ~hit)


def evaluate(df: DataFrame, views: Sequence[View], times: Sequence[str] = ("ts_ns",)) -> DataFrame:
    """(view, grp, ts_ns, value) of all views in one aggregation; ``df`` has metric, labels, ts_ns, value (rates already taken).

    Each row goes once to the total and once to each label that a view groups by.
    """
    names = {parts(s)[0] for w in views for s in (*w.num, *w.den, *w.also)}
    labels = sorted({w.by for w in views}, key=str)
    groups = [F.struct(F.lit(by).cast("string").alias("by"), (F.try_element_at("labels", F.lit(by)) if by else F.lit(None).cast("string")).alias("grp")) for by in labels]
    df = df.where(F.col("metric").isin(*sorted(names))).withColumn("__g", F.explode(F.array(*groups)))
    used = sorted({(s, w.fn) for w in views for s in (*w.num, *w.den, *w.also)})
    at = {u: f"m{i}" for i, u in enumerate(used)}
    g = df.groupBy(F.col("__g.by").alias("by"), F.col("__g.grp").alias("grp"), *times).agg(*[FNS[fn](F.when(matches(s), F.col("value"))).alias(at[s, fn]) for s, fn in used])
    cells = []
    for w in views:
        top, low = F.lit(1.0), F.lit(1.0)
        for s in w.num:
            top = top * F.col(at[s, w.fn])
        for s in w.den:
            low = low * F.col(at[s, w.fn])
        for s in w.also:
            low = low + F.col(at[s, w.fn])
        value = F.try_divide(top, low) * w.scale
        cells.append(F.struct(F.lit(w.name).alias("view"), F.when(F.col("by").eqNullSafe(F.lit(w.by)), 1 - value if w.rest else value).alias("value")))
    return g.select("grp", *times, F.inline(F.array(*cells))).where("value is not null").select("view", "grp", *times, "value")


@dataclass(frozen=True)
class Panel:
    """A histogram KPI."""

    name: str
    select: str
    by: str | None
    scale: float
    quantiles: tuple[float, ...]


@dataclass
class Compiled:
    """What KPIs become: views (with their kind) and panels, named ``service/title``, and (service, title, reason) of those that failed."""

    views: list[tuple[View, str]] = field(default_factory=list)
    panels: list[Panel] = field(default_factory=list)
    failures: list[tuple[str, str, str]] = field(default_factory=list)
    titles: list[tuple[str, str, str, bool]] = field(default_factory=list)  # service, title, role, denominator


def _reason(kpi: dict, seen: set) -> str | None:
    select = kpi.get("select") or []
    selectors = [*select, *(kpi.get("over") or []), *(kpi.get("plus") or [])]
    if not kpi.get("title"):
        return "no title"
    if kpi["title"] in seen:
        return "title given twice"
    if kpi.get("kind") not in ("counter", "gauge", "histogram"):
        return "unknown kind"
    if not select:
        return "nothing selected"
    if bad := [s for s in selectors if not s or not re.fullmatch(_SELECTOR, s)]:
        return f"selector {bad[0]}"
    for s in selectors:
        try:
            re.compile(parts(s)[3] or "")
        except re.error:
            return f"pattern {parts(s)[3]}"
    if (kpi.get("fn") or "sum") not in FNS:
        return "unknown function"
    if kpi["kind"] == "histogram" and (len(selectors) > 1 or any(not 0 <= q <= 1 for q in kpi.get("quantiles") or [])):
        return "one selector and quantiles of 0 to 1 for a histogram"
    return None


def compile_templates(documents: Sequence[dict], bare: bool = False) -> Compiled:
    """The plan of templates as dictionaries; ``bare`` names are titles alone."""
    out = Compiled()
    for doc in documents:
        seen: set[str] = set()
        for kpi in doc.get("kpis") or []:
            service, title = doc.get("service") or "", kpi.get("title") or ""
            if reason := _reason(kpi, seen):
                out.failures.append((service, title, reason))
                continue
            seen.add(title)
            name = title if bare else f"{service}/{title}"
            scale = 1.0 if kpi.get("scale") is None else float(kpi["scale"])
            out.titles.append((service, title, kpi.get("role") or "", bool(kpi.get("denominator"))))
            if kpi["kind"] == "histogram":
                out.panels.append(Panel(name, kpi["select"][0], kpi.get("by"), scale, tuple(kpi.get("quantiles") or QUANTILES)))
            else:
                out.views.append((View(name, tuple(kpi["select"]), tuple(kpi.get("over") or ()), scale, kpi.get("by"), False, kpi.get("fn") or "sum", tuple(kpi.get("plus") or ())), kpi["kind"]))
    return out


def packaged() -> Compiled:
    """The templates that come with the engine."""
    documents = [json.loads(f.read_text()) for f in sorted((files("metrifold") / "templates").iterdir(), key=lambda f: f.name) if f.name.endswith(".json")]
    return compile_templates(documents, bare=True)


def read_templates(spark: SparkSession, path: str) -> Compiled:
    """The templates of a directory; a file that is no JSON object with a service fails as a whole."""
    docs = spark.read.schema(TEMPLATE + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path, multiLine=True)
    rows = [r.asDict(recursive=True) for r in docs.withColumn("file", F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)).orderBy("file").limit(MOST + 1).collect()]
    if sum(len(r["kpis"] or []) or 1 for r in rows) > MOST:
        raise ValueError(f"more than {MOST} KPIs")
    good = [r for r in rows if r["service"] and not r["_broken"]]
    out = compile_templates(good)
    out.failures += [(r["file"], "", "no template") for r in rows if r not in good]
    return out


def run_kpis(c: Compiled, samples: DataFrame, increments: DataFrame, gp: int) -> DataFrame:
    """(service, title, grp, ts_ns, stat, value) of all KPIs; stat is "value" or a quantile such as "0.99".

    ``samples`` (metric, labels, ts_ns, value) are rates and gauges, ``increments`` (metric, labels, ts_ns, bucket, count) what histograms gained.
    """
    split = lambda name: [F.substring_index(name, "/", 1).alias("service"), F.expr(f"substring({name}, instr({name}, '/') + 1)").alias("title")]
    values = evaluate(samples, [w for w, _ in c.views]).select(*split("view"), "grp", "ts_ns", F.lit("value").alias("stat"), "value") if c.views else None
    hist = None
    if c.panels:
        hist = _quantiles(c, increments, gp).select(*split("panel"), "grp", "ts_ns", "stat", "value")
    if values is None or hist is None:
        return values if hist is None else hist
    return values.unionByName(hist)


def _chosen(c: Compiled, increments: DataFrame) -> DataFrame:
    """Each increment once for each histogram KPI that selects it, with its panel, group, unit and quantiles."""
    rows = [F.when(matches(p.select), F.struct(F.lit(p.name).alias("panel"), (F.try_element_at("labels", F.lit(p.by)) if p.by else F.lit(None).cast("string")).alias("grp"), F.lit(p.scale).alias("scale"), F.array(*[F.lit(float(q)) for q in p.quantiles]).alias("qs"))) for p in c.panels]
    return increments.withColumn("__p", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull()))).select("__p.panel", "__p.grp", "__p.scale", "__p.qs", *[x for x in increments.columns if x not in ("metric", "labels")])


def _quantiles(c: Compiled, increments: DataFrame, gp: int) -> DataFrame:
    wanted = sorted({q for p in c.panels for q in p.quantiles})
    keys = ["panel", "grp", "scale", "qs"]
    q = H.quantiles(_chosen(c, increments), keys, gp, wanted).where(F.array_contains("qs", F.col("quantile")))
    return q.select("panel", "grp", "ts_ns", F.col("quantile").cast("string").alias("stat"), (F.col("value") * F.col("scale")).alias("value"))


def statuses(spark: SparkSession, c: Compiled, results: DataFrame) -> DataFrame:
    """(service, title, role, denominator, status): ok, empty (no row) or the reason why it failed."""
    known = spark.createDataFrame(c.titles or [("", "", "", False)], "service string, title string, role string, denominator boolean").where("title <> ''")
    rows = results.select("service", "title").distinct().withColumn("__has", F.lit(True))
    out = known.join(rows, ["service", "title"], "left").select("service", "title", "role", "denominator", F.when(F.col("__has"), "ok").otherwise("empty").alias("status"))
    failed = spark.createDataFrame(c.failures or [("", "", "")], "service string, title string, status string").where("status <> ''")
    return out.unionByName(failed.select("service", "title", F.lit(None).cast("string").alias("role"), F.lit(None).cast("boolean").alias("denominator"), "status"))


def ab_document(c: Compiled, samples: DataFrame, increments: DataFrame, gp: int, step_ns: int, points: int = 48) -> DataFrame:
    """The A/B report of all KPIs in one table of rows (part, service, title, arm, x, stat, value).

    ``samples`` and ``increments`` have ``arm`` (baseline or experiment). Parts: "kpi" the figures of both arms on
    relative time, "box" the box plot of each arm by bin (x), "spectrum" the hundred quantiles (x) of each arm's whole histogram, and
    "difference" the experiment's less the baseline's.
    """
    arm = lambda d, name: d.where(F.col("arm") == name).drop("arm")
    blank = lambda kind: F.lit(None).cast(kind)
    values = {a: evaluate(arm(samples, a), [w for w, _ in c.views]).where("grp is null").select(F.col("view").alias("title"), "ts_ns", "value") for a in ("baseline", "experiment")}
    titles = values["baseline"].select("title").unionByName(values["experiment"].select("title")).distinct()
    figures = M.ab_report(values["baseline"], values["experiment"], titles, step_ns)
    names = ("steps", "baseline", "experiment", "delta", "widest", "higher", "pct")
    out = figures.select(F.lit("kpi").alias("part"), "title", blank("string").alias("arm"), blank("double").alias("x"), F.inline(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).cast("double").alias("value")) for n in names])))
    for a, v in values.items():
        box = M.boxplot(v, ["title"], points)
        out = out.unionByName(box.select(F.lit("box").alias("part"), "title", F.lit(a).alias("arm"), F.col("bin").cast("double").alias("x"), F.inline(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("value")) for n in ("min", "lo", "median", "hi", "max")]))))
    if c.panels:
        whole = _chosen(c, increments).groupBy("arm", "panel", "scale", "bucket").agg(F.sum("count").alias("count")).withColumn("ts_ns", F.lit(0).cast("long"))
        spectra = H.spectrum(whole, ["arm", "panel", "scale"], gp).select("arm", F.col("panel").alias("title"), F.col("quantile").alias("x"), (F.col("value") * F.col("scale")).alias("value"))
        both = spectra.groupBy("title", "x").agg(*[F.max(F.when(F.col("arm") == a, F.col("value"))).alias(a) for a in ("baseline", "experiment")])
        out = out.unionByName(spectra.select(F.lit("spectrum").alias("part"), "title", "arm", "x", F.lit("value").alias("stat"), "value"))
        out = out.unionByName(both.select(F.lit("difference").alias("part"), "title", blank("string").alias("arm"), "x", F.lit("value").alias("stat"), (F.col("experiment") - F.col("baseline")).alias("value")))
    return out.where("value is not null").select("part", F.substring_index("title", "/", 1).alias("service"), F.expr("substring(title, instr(title, '/') + 1)").alias("title"), "arm", "x", "stat", "value")
