"""Named metric views: products and quotients of summed rates or gauges, as a declarative table, and its queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrifold.operators import base as B
from metrifold.operators import histogram as H
from metrifold.operators.rates import gauge_grid, rate_grid, rate_raw
from metrifold.plans.registry import C, G, counters, end_sql, gauges, increments, query, r6, start_sql
from metrifold.plans.registry import H as HS
from metrifold.plans.templates import View, evaluate, packaged, parts

SERVICES = packaged()


def v(name, num, den="", scale=1.0, by=None, rest=False, fn="sum", also=""):
    return View(name, tuple(num.split()), tuple(den.split()), scale, by, rest, fn, tuple(also.split()))


#: Metric names, label values and unit factors are fixed values.
RATES: dict[str, list[View]] = {
    "v01_cpu": [
        v("busy", "cpu_usage", "cpu_cores", 1e-9),
        v("busy_by_id", "cpu_usage", "", 1e-9, by="id"),
        v("user", "cpu_usage{state=user}", "cpu_cores", 1e-9),
        v("system", "cpu_usage{state=system}", "cpu_cores", 1e-9),
        v("ipc", "cpu_instructions", "cpu_cycles"),
        v("ipc_by_id", "cpu_instructions", "cpu_cycles", by="id"),
        v("ipns", "cpu_instructions cpu_tsc cpu_aperf", "cpu_cycles cpu_mperf cpu_cores", 1e-9),
        v("l3_hit", "cpu_l3_miss", "cpu_l3_access", rest=True),
        v("frequency", "cpu_tsc cpu_aperf", "cpu_mperf cpu_cores"),
        v("branch_miss_ratio", "cpu_branch_misses", "cpu_branch_instructions"),
        v("branch_instructions", "cpu_branch_instructions"),
        v("dtlb_misses", "cpu_dtlb_miss"),
        v("dtlb_mpki", "cpu_dtlb_miss", "cpu_instructions", 1000.0),
        v("migrations_to", "cpu_migrations{direction=to}"),
        v("migrations_from", "cpu_migrations{direction=from}"),
        v("tlb_flush", "cpu_tlb_flush"),
        v("tlb_flush_task_switch", "cpu_tlb_flush{reason=task_switch}"),
    ],
    "v02_gpu": [
        v("energy", "gpu_energy_consumption", "", 1e-3),
        v("busy_ratio", "gpmu_busy_cycles", "gpmu_clock"),
        v("valu", "gpmu_valu_instructions"),
        v("salu", "gpmu_salu_instructions"),
        v("lds", "gpmu_lds_instructions"),
        v("valu_per_cycle", "gpmu_valu_instructions", "gpmu_busy_cycles"),
        v("valu_per_wave", "gpmu_valu_instructions", "gpmu_waves"),
        v("cycles_per_wave", "gpmu_busy_cycles", "gpmu_waves"),
        v("occupancy", "gpmu_wave_cycles", "gpmu_busy_cycles"),
        v("icache_hit", "gpmu_icache_hits", "gpmu_icache_requests"),
        v("l2_hit", "gpmu_l2_hits", "gpmu_l2_hits", also="gpmu_l2_misses"),
        v("vram_read_bytes", "gpmu_vram_read_requests", "", 128.0),
        v("vram_write_bytes", "gpmu_vram_write_requests", "", 64.0),
    ],
    "v03_memory_numa": [v("numa_local", "memory_numa_local"), v("numa_foreign", "memory_numa_foreign")],
    "v04_network": [
        v("tx_bits", "network_bytes{direction=transmit}", "", 8.0),
        v("rx_bits", "network_bytes{direction=receive}", "", 8.0),
        v("tx_packets", "network_packets{direction=transmit}"),
        v("rx_packets", "network_packets{direction=receive}"),
        v("drops", "network_drop"),
        v("retransmits", "tcp_retransmit"),
    ],
    "v05_blockio": [
        v("bytes", "blockio_bytes"),
        v("operations", "blockio_operations"),
        v("read_bytes", "blockio_bytes{op=read}"),
        v("write_bytes", "blockio_bytes{op=write}"),
        v("read_operations", "blockio_operations{op=read}"),
        v("write_operations", "blockio_operations{op=write}"),
    ],
    "v06_scheduler": [
        v("runqueue_wait", "scheduler_runqueue_wait", "cpu_cores"),
        v("runqueue_wait_by_id", "scheduler_runqueue_wait", by="id"),
        v("context_switches", "scheduler_context_switch"),
        v("context_switches_by_id", "scheduler_context_switch", by="id"),
    ],
    "v07_softirq": [
        v("total", "softirq"),
        v("total_by_id", "softirq", by="id"),
        v("time", "softirq_time", "cpu_cores", 1e-9),
        v("net_rx_time", "softirq_time{kind=net_rx}", "cpu_cores", 1e-9),
        v("time_by_id", "softirq_time", "", 1e-9, by="id"),
        v("net_rx", "softirq{kind=net_rx}"),
        v("timer", "softirq{kind=timer}"),
    ],
    "v08_syscall": [v("total", "syscall"), v("read", "syscall{op=read}"), v("write", "syscall{op=write}")],
    "v09_cgroups": [
        v("cores", "cgroup_cpu_usage", "", 1e-9, by="name"),
        v("user", "cgroup_cpu_usage{state=user}", "", 1e-9, by="name"),
        v("system", "cgroup_cpu_usage{state=system}", "", 1e-9, by="name"),
        v("ipc", "cgroup_cpu_instructions", "cgroup_cpu_cycles", by="name"),
        v("migrations", "cgroup_cpu_migrations", by="name"),
        v("throttled_time", "cgroup_cpu_throttled_time", "", 1e-9),
        v("tlb_flush", "cgroup_cpu_tlb_flush", by="name"),
        v("syscall_read", "cgroup_syscall{op=read}", by="name"),
    ],
    "v10_exceptions": [
        v("network_drops", "network_drop"),
        v("transmit_timeouts", "network_transmit_timeout"),
        v("retransmits", "tcp_retransmit"),
        v("ena_bandwidth_in", "network_ena_bandwidth_allowance_exceeded{direction=receive}"),
        v("ena_pps", "network_ena_pps_allowance_exceeded"),
        v("ena_conntrack", "network_ena_conntrack_allowance_exceeded"),
        v("throttled", "cgroup_cpu_throttled"),
        v("throttled_time", "cgroup_cpu_throttled_time", "", 1e-9),
        v("io_errors_by_op", "blockio_errors", by="op"),
        v("io_requeues_by_op", "blockio_requeues", by="op"),
    ],
    "v11_overview": [
        v("cpu", "cpu_usage", "cpu_cores", 1e-9),
        v("rx_bits", "network_bytes{direction=receive}", "", 8.0),
        v("tx_bits", "network_bytes{direction=transmit}", "", 8.0),
        v("syscalls", "syscall"),
        v("softirq_time", "softirq_time", "cpu_cores", 1e-9),
        v("io_read", "blockio_bytes{op=read}"),
        v("cpu_per_request", "cpu_usage", "requests"),
    ],
    "v12_self": [
        v("cpu", "agent_cpu_usage", "", 1e-9),
        v("ipc", "cgroup_cpu_instructions{name=agent}", "cgroup_cpu_cycles{name=agent}"),
        v("bpf_time", "agent_bpf_run_time", "", 1e-9),
        v("bpf_time_by_sampler", "agent_bpf_run_time", "", 1e-9, by="sampler"),
        v("bpf_time_per_run", "agent_bpf_run_time", "agent_bpf_run_count", 1e-9, by="sampler"),
    ],
    "v13_services": [w for w, _ in SERVICES.views],
}
GAUGES: dict[str, list[View]] = {
    "v02_gpu_gauges": [
        v("utilization", "gpu_utilization", "", 0.01, fn="avg"),
        v("memory_utilization", "gpu_memory_utilization", "", 0.01, fn="avg"),
        v("tensor", "gpu_tensor_utilization", "", 0.01, fn="avg"),
        v("power", "gpu_power_usage", "", 1e-3),
        v("power_by_id", "gpu_power_usage", "", 1e-3, by="id"),
        v("temperature", "gpu_temperature", fn="max"),
        v("pcie_bandwidth", "gpu_pcie_bandwidth"),
        v("memory_used_share", "gpu_memory{state=used}", "gpu_memory{state=used}", also="gpu_memory{state=free}"),
    ],
    "v03_memory": [
        v("total", "memory_total"),
        v("available", "memory_available"),
        v("free", "memory_free"),
        v("buffers", "memory_buffers"),
        v("cached", "memory_cached"),
        v("utilization", "memory_available", "memory_total", rest=True),
    ],
}


def cgroup_views(selected: str) -> list[View]:
    """The cgroup views of the names that match ``selected``, each by itself, and of all others together."""
    out = []
    for w in RATES["v09_cgroups"]:
        if w.by != "name" or any("{" in s for s in (*w.num, *w.den)):
            continue
        pick = lambda op, ss: tuple(f"{s}{{name{op}{selected}}}" for s in ss)
        out += [View(f"{w.name}_selected", pick("=~", w.num), pick("=~", w.den), w.scale, "name"), View(f"{w.name}_rest", pick("!~", w.num), pick("!~", w.den), w.scale)]
    return out


def on_grid(counters_: DataFrame, gauges_: DataFrame, step: int) -> DataFrame:
    """Rates of counters and values of gauges (metric, labels, ts_ns, value) at the multiples of ``step``, so that series whose clocks differ meet."""
    keyed = lambda d: d.withColumn("__l", F.array_sort(F.map_entries("labels"))).drop("labels")
    keys = ["metric", "__l"]
    both = rate_grid(keyed(counters_), keys, step).unionByName(gauge_grid(keyed(gauges_), keys, step).withColumn("value", F.col("value").cast("double")).select(*keys, "ts_ns", "value"))
    return both.select("metric", F.map_from_entries("__l").alias("labels"), "ts_ns", "value")


#: Histogram panels: metric, label that splits it (or none) and unit factor; fixed values. Latencies are in nanoseconds.
HISTOGRAMS: dict[str, tuple[tuple[str, str | None, float], ...]] = {
    "v04_network_latency": (("tcp_packet_latency", None, 1e-9),),
    "v05_blockio_latency_size": (("blockio_latency", "op", 1e-9), ("blockio_size", "op", 1.0)),
    "v06_scheduler_times": (("scheduler_runqueue_latency", None, 1e-9), ("scheduler_offcpu", None, 1e-9), ("scheduler_running", None, 1e-9)),
    "v08_syscall_latency": (("syscall_latency", "op", 1e-9),),
    "v11_overview_latency": (("scheduler_runqueue_latency", None, 1e-9), ("syscall_latency", None, 1e-9), ("blockio_latency", None, 1e-9)),
    "v13_service_latency": tuple((p.select, p.by, p.scale) for p in SERVICES.panels),
}
PANEL = (0.5, 0.9, 0.99, 0.999, 0.9999)


def histogram_panels(df: DataFrame, panels: Sequence[tuple[str, str | None, float]], gp: int, qs: Sequence[float] = PANEL) -> DataFrame:
    """(metric, grp, ts_ns, view, value) from increments (metric, labels, ts_ns, bucket, count): percentiles, observations a second and the mean of each panel."""
    grp, scale, known = F.lit(None).cast("string"), F.lit(1.0), F.lit(False)
    for metric, label, unit in panels:
        here = F.col("metric") == metric
        grp, scale, known = F.when(here, F.try_element_at("labels", F.lit(label)) if label else F.lit(None)).otherwise(grp), F.when(here, unit).otherwise(scale), known | here
    d = df.where(known).withColumn("grp", grp)
    q = H.quantiles(d, ["metric", "grp"], gp, qs).select("metric", "grp", "ts_ns", F.concat(F.lit("p"), (F.col("quantile") * 100).cast("float").cast("string")).alias("view"), (F.col("value") * scale).alias("value"))
    rm = H.rate_mean(H.merge(d, ["metric", "grp"]), ["metric", "grp"], gp)
    pair = F.inline(F.array(F.struct(F.lit("rate").alias("view"), F.col("rate").alias("value")), F.struct(F.lit("mean").alias("view"), (F.col("mean") * scale).alias("value"))))
    return q.unionByName(rm.select("metric", "grp", "ts_ns", pair))


def view(df: DataFrame, pattern: str) -> DataFrame:
    """Views by name, such as ``cpu.*`` or ``memory.free``, over rates and gauges; of series with clocks of their own take ``on_grid`` first."""
    group, _, name = pattern.partition(".")
    found = [w for k, ws in (RATES | GAUGES).items() if k.split("_", 1)[1].startswith(group) for w in ws if name in ("*", w.name)]
    return evaluate(df, found)


def any_metric(rates: DataFrame, gauges_: DataFrame, hist: DataFrame, gp: int) -> DataFrame:
    """Each metric by its kind: counters as summed rates, gauges as sums, histograms as p50, p90 and p99."""
    a = rates.groupBy("metric", "ts_ns").agg(F.sum("value").alias("value")).withColumn("view", F.lit("rate"))
    b = gauges_.groupBy("metric", "ts_ns").agg(F.sum("value").alias("value")).withColumn("view", F.lit("gauge"))
    c = H.quantiles(hist, ["metric"], gp, (0.5, 0.9, 0.99)).select("metric", "ts_ns", "value", F.concat(F.lit("p"), F.round(F.col("quantile") * 100).cast("int").cast("string")).alias("view"))
    return a.unionByName(b).unionByName(c)


# --- queries over the driver's events ------------------------------------------------------------------------------
_TYPES = ("click", "error", "purchase", "signup", "view")


def _selectors(views: Sequence[View]) -> list[str]:
    """The distinct selectors, patterns by their bare metric."""
    return sorted({s if parts(s)[2] in (None, "=") else parts(s)[0] for w in views for s in (*w.num, *w.den, *w.also)})


def _derived(df: DataFrame, views: Sequence[View]) -> DataFrame:
    """Each selector's series from one event type, ids from the user, daily means."""
    day = df.groupBy("metric", "usr", (B.idiv(F.col("ts_ns"), B.DAY) * B.DAY).alias("ts_ns")).agg(F.avg("value").alias("value"))
    rows = []
    for i, s in enumerate(_selectors(views)):
        name, key, _, value = parts(s)
        labels = [F.lit(x) for k in ("id", "name", "op", "sampler") if k != key for x in (k,)]
        pairs = [x for k in labels for x in (k, (F.col("usr") % 4).cast("string"))] + ([F.lit(key), F.lit(value)] if key else [])
        rows.append(F.struct(F.lit(_TYPES[i % 5]).alias("t"), F.lit(name).alias("m"), F.create_map(*pairs).alias("labels")))
    e = day.withColumn("s", F.explode(F.filter(F.array(*rows), lambda x: x["t"] == F.col("metric"))))
    return e.select(F.col("s.m").alias("metric"), F.col("s.labels").alias("labels"), "ts_ns", "value")


def _sql(views: Sequence[View], base: str) -> str:
    sel = _selectors(views)
    rows = ", ".join(f"({i}, '{_TYPES[i % 5]}')" for i in range(len(sel)))
    head = f"WITH {base}, dv AS (SELECT metric, usr, ts_ns // {B.DAY} * {B.DAY} AS ts_ns, avg(value) AS value FROM src GROUP BY ALL), sl AS (SELECT k, usr % 4 AS lab, ts_ns, value FROM dv JOIN (VALUES {rows}) t(k, m) ON m = metric)"

    def term(s: str, fn: str) -> str:
        name, key, op, value = parts(s)
        ks = [i for i, x in enumerate(sel) if parts(x)[0] == name and (x == s or key is None or op != "=")]
        label = "" if op in (None, "=") else f" AND {'NOT ' if op == '!~' else ''}regexp_full_match(lab::VARCHAR, '{value}')"
        return f"({fn}(value) FILTER (k IN ({', '.join(map(str, ks))}){label}))"

    selects = []
    for w in views:
        top = " * ".join(term(s, w.fn) for s in w.num)
        low = " * ".join(term(s, w.fn) for s in w.den) or "1.0"
        low = f"({low} + {' + '.join(term(s, w.fn) for s in w.also)})" if w.also else f"({low})"
        value = f"{w.scale!r}::DOUBLE * {top} / {low}"
        value = f"1 - {value}" if w.rest else value
        grp = "CAST(lab AS VARCHAR)" if w.by else "CAST(NULL AS VARCHAR)"
        selects.append(f"SELECT '{w.name}' AS view, {grp} AS grp, ts_ns, {value} AS value FROM sl GROUP BY ts_ns{', lab' if w.by else ''}")
    return f"{head} SELECT view, grp, ts_ns, CAST(value AS FLOAT) AS value FROM ({' UNION ALL '.join(selects)}) WHERE value IS NOT NULL"


_RATE_BASE = C + ", src AS (SELECT metric, usr, ts_ns, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END * 1e9 / (ts_ns - lag(ts_ns) OVER w) AS value FROM c WINDOW w AS (PARTITION BY metric, usr ORDER BY ts_ns))"
_GAUGE_BASE = G + ", src AS (SELECT metric, usr, ts_ns, value FROM g)"


def _register(name: str, views: list[View], rates: bool) -> None:
    @query(name, _sql(views, _RATE_BASE if rates else _GAUGE_BASE))
    def run(s, d):
        if rates:
            src = rate_raw(counters(s, d).select("metric", "usr", "ts_ns", "value"), ["metric", "usr"])
        else:
            src = gauges(s, d)
        return evaluate(_derived(src, views), views).withColumn("value", F.col("value").cast("float"))


for _name, _views in RATES.items():
    _register(_name, _views, True)
for _name, _views in GAUGES.items():
    _register(_name, _views, False)
_register("v09_cgroups_selected", cgroup_views("0|3"), True)


def _flagged(d: DataFrame, panels: Sequence[tuple[str, str | None, float]]) -> DataFrame:
    """Monthly price increments stand for each panel's histogram, their flag for the label."""
    names = F.array(*[F.lit(m) for m, _, _ in panels])
    return d.withColumn("metric", F.explode(names)).withColumn("labels", F.create_map(F.lit("op"), F.col("flag")))


def _panel_sql(panels: Sequence[tuple[str, str | None, float]]) -> str:
    rows = ", ".join(f"('{m}', {'true' if label else 'false'}, {unit!r}::DOUBLE)" for m, label, unit in panels)
    lo, hi = start_sql("bucket", 3), end_sql("bucket", 3)
    return f"""WITH {HS}, pn AS (SELECT * FROM (VALUES {rows}) t(metric, split, unit)), pd AS (SELECT metric, CASE WHEN split THEN flag END AS grp, unit, ts_ns, bucket, sum(count) AS count FROM h, pn GROUP BY ALL),
 cu AS (SELECT *, sum(count) OVER (PARTITION BY metric, grp, ts_ns ORDER BY bucket) AS cum, sum(count) OVER (PARTITION BY metric, grp, ts_ns) AS total FROM pd),
 qs AS (SELECT metric, grp, ts_ns, unit, q, min(bucket) AS bucket FROM cu, (VALUES (0.5::DOUBLE),(0.9::DOUBLE),(0.99::DOUBLE),(0.999::DOUBLE),(0.9999::DOUBLE)) t(q) WHERE cum >= greatest(ceil(q*total), 1) GROUP BY ALL),
 st AS (SELECT metric, grp, ts_ns, unit, sum(count) AS n, sum(count*({lo}+{hi})/2.0::DOUBLE)/sum(count) AS mean FROM pd GROUP BY ALL),
 rm AS (SELECT *, n*1e9/(ts_ns-lag(ts_ns) OVER (PARTITION BY metric, grp ORDER BY ts_ns)) AS rate FROM st)
SELECT metric, grp, ts_ns, CASE q WHEN 0.5 THEN 'p50.0' WHEN 0.9 THEN 'p90.0' WHEN 0.99 THEN 'p99.0' WHEN 0.999 THEN 'p99.9' ELSE 'p99.99' END AS view, CAST(({end_sql('bucket', 3)})*unit AS FLOAT) AS value FROM qs UNION ALL SELECT metric, grp, ts_ns, 'rate', CAST(rate AS FLOAT) FROM rm WHERE rate IS NOT NULL UNION ALL SELECT metric, grp, ts_ns, 'mean', CAST(mean*unit AS FLOAT) FROM rm WHERE rate IS NOT NULL"""


def _register_panels(name: str, panels: Sequence[tuple[str, str | None, float]]) -> None:
    @query(name, _panel_sql(panels))
    def run(s, d):
        return histogram_panels(_flagged(increments(s, d), panels), panels, 3).withColumn("value", F.col("value").cast("float"))


for _name, _panels in HISTOGRAMS.items():
    _register_panels(_name, _panels)


_ANY = f"r AS (SELECT metric, ts_ns, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END * 1e9 / (ts_ns - lag(ts_ns) OVER w) AS v FROM c WINDOW w AS (PARTITION BY metric, usr ORDER BY ts_ns)), hh AS (SELECT flag AS metric, ts_ns, bucket, sum(count) OVER (PARTITION BY flag, ts_ns ORDER BY bucket) AS cum, sum(count) OVER (PARTITION BY flag, ts_ns) AS total FROM h)"


@query("p13_auto_series_v14_any_metric", f"WITH {C}, {HS}, {_ANY} SELECT metric, ts_ns, round(sum(v),6) AS value, 'rate' AS view FROM r WHERE v IS NOT NULL GROUP BY metric, ts_ns UNION ALL SELECT metric, ts_ns, round(sum(value),6), 'gauge' FROM g GROUP BY metric, ts_ns UNION ALL SELECT metric, ts_ns, {end_sql('min(bucket)', 3)}::DOUBLE, 'p' || q FROM hh, (VALUES (50),(90),(99)) t(q) WHERE cum >= greatest(ceil(q/100.0*total),1) GROUP BY metric, ts_ns, q")
def p13(s, d):
    rates = rate_raw(counters(s, d).select("metric", "usr", "ts_ns", "value"), ["metric", "usr"])
    return any_metric(rates, gauges(s, d), increments(s, d).withColumnRenamed("flag", "metric"), 3).withColumn("value", r6("value"))
