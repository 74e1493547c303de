"""Registered queries of the ingest (A), decoder (B/G), snapshot (C),
publication (F) and streaming (S) operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobscope import fixtures
from jobscope.functions import decode as B
from jobscope.operators import olap
from jobscope.operators import reports as R
from jobscope.operators import snapshot as C
from jobscope.plans.joins import binned_range_join
from jobscope.plans.materialize import materialize, scratch_path
from jobscope.queries import analysis, round_doubles
from jobscope.sources import derived as D
from jobscope.sources import ingest as A
from jobscope.sources import publish as P
from jobscope.streaming import stream as S


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# ---- A -----------------------------------------------------------------------------------
def a01(spark, sf):
    return A.latest_jobinfo(A.normalize_jobs(D.jobs_raw(spark, sf)))


def a02(spark, sf):
    m = A.accounting_measurements(D.jobs_raw(spark, sf), F.lit(0))
    return m.select("jobid", "stepid", "dev_in", "dev_out", "user_sec", "user_usec", "sys_sec", "sys_usec",
                    "res_size")


def a03(spark, sf):
    return A.scrape_measurements(D.envelopes(spark, sf))


def a04(spark, sf):
    return A.scrape_gpu_measurements(D.envelopes(spark, sf))


def a05(spark, sf):
    return A.application_usage_of(D.envelopes(spark, sf))


def a06(spark, sf):
    return A.cpu_available(D.envelopes(spark, sf))


def a07(spark, sf):
    mon = fixtures.load(spark, sf)
    return A.quality_gate(mon.measurements, mon.watcher).select("recordid", "watcherid", "jobid", "stepid")


def a08(spark, sf):
    return A.interval_change_log(D.interval_settings(spark, sf))


def a09(spark, sf):
    r = A.watcher_registry(D.registrations(spark, sf))
    return r.select("jobstep_str", "target_node", "accuracy", "id", "pid", "source", "lastfetch", "prev_lastfetch")


def a10(spark, sf):
    out = None
    for table, df in D.constraint_rows(spark, sf).items():
        _, bad = A.validate(table, df)
        c = bad.select(F.explode("failed_rules").alias("rule")).groupBy("rule").agg(
            F.count(F.lit(1)).alias("n_bad")).select(F.lit(table).alias("table_name"), "rule", "n_bad")
        out = c if out is None else out.unionByName(c)
    return out


def a11(spark, sf):
    mon = fixtures.load(spark, sf)
    state = mon.measurements.agg(F.call_function("div", F.max("recordid"), F.lit(2).cast("bigint"))
                                 .alias("analysis_offset"), F.lit(0).cast("bigint").alias("period_started"))
    return A.analysis_range(mon.measurements, state, F.lit(7 * 86400), 7 * 86400)


def a12(spark, sf):
    """Every third registration is a first fetch."""
    r = D.registrations(spark, sf).withColumn("lastfetch", F.when(F.col("id") % 3 != 0, F.col("lastfetch")))
    return A.fetch_range(r, F.lit(1_000_000_000).cast("bigint"))


def a14_replace(spark, sf):
    mon = fixtures.load(spark, sf)
    out = A.replace_global(mon.measurements, D.new_global_rows(mon.measurements), mon.watcher)
    return out.select("recordid", "watcherid", "jobid", "stepid", "user_sec", "user_usec", "sys_sec", "tot_time", "res_size")


def a15(spark, sf):
    """A seventh of the rows come from before watchers were told apart."""
    mon = fixtures.load(spark, sf)
    old = mon.measurements.withColumn("watcherid", F.when(F.col("recordid") % 7 == 0, F.lit(0).cast("bigint")).otherwise(F.col("watcherid")))
    return A.backfill_watcher(old, mon.watcher).select("recordid", "jobid", "stepid", "watcherid")


def a16(spark, sf):
    mon = fixtures.load(spark, sf)
    out = None
    for version in (2, 3, 4, 5):
        up = A.upgrade_schema(D.old_jobinfo(mon.jobinfo, version), "jobinfo", version)
        up = up.select(F.lit(version).alias("from_version"), "jobid", "stepid", "mem", "ncpu", "timelimit", "started_at",
                       "ended_at", "nnodes", "peak_res_size")
        out = up if out is None else out.unionByName(up)
    return out


def a13(spark, sf):
    return A.filter_states(D.jobs_raw(spark, sf), "import").select("jobid", "state")


def a14(spark, sf):
    mon = fixtures.load(spark, sf)
    return A.latest_global_record(mon.measurements, mon.watcher)


# ---- B / G ---------------------------------------------------------------------------------
def b01(spark, sf):
    j = D.jobs_raw(spark, sf).select("jobid", B.tres_map(F.col("tres_alloc_str")).alias("t"))
    return j.select("jobid", *[B.tres_get(F.col("t"), i).alias(f"tres_{i}") for i in (1, 2, 3, 4, 1001)])


def b02(spark, sf):
    return B.explode_hostlist(D.jobs_raw(spark, sf), "nodes").select("jobid", "node")


def b03(spark, sf):
    e = _read(spark, sf, "events")
    s = F.concat((F.col("event_id") % 8).cast("string"), F.lit("-"),
                 (F.col("event_id") % 8 + F.col("user_id") % 4).cast("string"), F.lit(","),
                 (F.col("user_id") % 64).cast("string"))
    return e.select("event_id", B.cpuset_count(s).alias("ncpu"))


def b04(spark, sf):
    e = _read(spark, sf, "events")
    mask = (F.col("event_id") % 128).bitwiseOR(F.when(F.col("event_type") == "error", 0x1000).otherwise(0))
    x = e.select("event_id", mask.cast("bigint").alias("mask"))
    x = x.withColumn("reasons", B.clock_reasons(F.col("mask")))
    return x.withColumn("mask_back", B.clock_mask(F.col("reasons")))


def b05(spark, sf):
    j = fixtures.load(spark, sf).jobinfo
    return j.select("jobid", "stepid", B.step_name(F.col("stepid")).alias("step"))


def b06(spark, sf):
    e = _read(spark, sf, "events")
    ent = F.concat(F.lit('hostname="node-'), (F.col("user_id") % 5).cast("string"), F.lit('",job_id="'),
                   F.col("user_id").cast("string"), F.lit('",gpu="'),
                   F.when(F.col("event_type") == "view", F.lit("x")).otherwise((F.col("event_id") % 4).cast("string")),
                   F.lit('"'))
    return B.parse_entity(e.select("event_id", ent.alias("entity")), "entity").select(
        "event_id", "entity_host", "entity_jobid", "gpuid")


def b07(spark, sf):
    o = _read(spark, sf, "orders")
    return o.select("o_orderkey", B.slurm_duration(F.col("o_orderkey") * 3671 + F.col("o_custkey")).alias("duration"))


def b08(spark, sf):
    e = _read(spark, sf, "events")
    sec, usec = B.split_ticks(F.floor(F.col("value") * 100), 100)
    return e.select("event_id", sec.alias("sec"), usec.alias("usec"))


def _stat_line():
    e, v = F.col("event_id"), F.col("value")
    s = lambda c: c.cast("string")
    return F.concat_ws(" ", s(e), F.concat(F.lit("("), F.col("event_type"), F.lit(" "), F.col("props"), F.lit(")")),
                       F.lit("S"), s(F.floor(e / 3)), F.lit("1 1 0 -1 4194304"), s(e % 100), s(e % 11), F.lit("0 0"),
                       s(F.floor(v * 10)), s(F.floor(v * 3)), s(e % 7), s(e % 5), F.lit("20 0 1 0 123 4096"),
                       s(F.floor(v * 1000)), F.lit("18446744073709551615"))


def b09(spark, sf):
    e = _read(spark, sf, "events").select("event_id", _stat_line().alias("line"))
    return B.parse_proc_stat(e, "line").drop("line")


def g01(spark, sf):
    d = _read(spark, sf, "documents")
    return d.select("doc_id", B.machine_name(F.concat_ws(" ", "source", "lang")).alias("machine_name"))


def g02(spark, sf):
    c = _read(spark, sf, "customer")
    return c.select("c_custkey", B.user_of_address(F.concat(F.col("c_name"), F.lit("@example.org"))).alias("user"))


# ---- C ---------------------------------------------------------------------------------------
def c01(spark, sf):
    procs, roots = D.proc_snapshot(spark, sf)
    return C.process_tree_rollup(procs, roots, D.gpu_pid_rows(spark, sf))


def c03(spark, sf):
    procs, roots = D.proc_snapshot(spark, sf)
    return C.step_applications(procs, roots)


def c04(spark, sf):
    procs, roots = D.proc_snapshot(spark, sf)
    return C.attribute_gpu_by_pid(D.gpu_pid_rows(spark, sf), procs, roots)


def c05(spark, sf):
    mon = fixtures.load(spark, sf)
    nodes = mon.watcher.where(F.col("target_node").isNotNull()).select(F.col("id").alias("watcherid"),
                                                                       F.col("target_node").alias("host"))
    steps = mon.measurements.join(nodes, "watcherid").select(
        "host", F.floor(F.col("recordid") / 40).cast("bigint").alias("ts"), "jobid", "stepid",
        F.col("recordid").alias("seen"))
    gpu = mon.gpu_measurements.join(nodes, "watcherid").select(
        "host", F.floor(F.col("batch") / 40).cast("bigint").alias("ts"), "batch", "pid", "gpuid", "jobid")
    return C.attribute_gpu_by_job(gpu, steps)


def c06(spark, sf):
    return C.latest_gpu_job(D.gpu_entities(spark, sf))


def c07(spark, sf):
    return C.pivot_gpu_metrics(D.gpu_metrics(spark, sf))


def c08(spark, sf):
    return C.gpu_process_rows(D.gpu_devices(spark, sf)).select("host", "ts", "gpuid", "util", "pid",
                                                               "clock_limit_reason")


def c09(spark, sf):
    return C.node_load(D.jobs_raw(spark, sf))


def c10(spark, sf):
    return C.node_partition(D.partitions(spark, sf))


def c11(spark, sf):
    return C.ranked_nodes(C.node_load(D.jobs_raw(spark, sf)), C.node_partition(D.partitions(spark, sf)))


def c12(spark, sf):
    s = C.job_accounting_summary(D.jobs_raw(spark, sf))
    return s.select("jobid", "nsteps", "user_usec", "sys_usec", "tot_usec", "sys_user_pct",
                    F.try_element_at("tres_in", F.lit(6)).alias("tres_in_6"),
                    F.try_element_at("tres_in", F.lit(1)).alias("tres_in_1"),
                    F.try_element_at("tres_out", F.lit(6)).alias("tres_out_6"))


# ---- F ------------------------------------------------------------------------------------------
def _sections(spark, sf):
    a = analysis(spark, sf)
    return a, {name: fn(a, spark) for name, fn in R.SECTIONS.items()}


def f01(spark, sf):
    a, secs = _sections(spark, sf)
    rows = P.section_rows(secs, a.per.start, a.per.start, a.per.end)
    pub_path = scratch_path(spark, "publication")
    P.write_period(rows, pub_path)
    return olap.list_periods(P.read_periods(spark, pub_path), admin=True)


def f01_viewer(spark, sf):
    """Two published periods, as one user sees them."""
    a = analysis(spark, sf)
    rows = materialize(R.export_user_documents(a, spark).where(F.col("section").isNotNull()), "documents")
    pub = rows.select(a.per.start.cast("bigint").alias("period"), "user", a.per.start.alias("started"), a.per.end.alias("updated")).unionByName(
        rows.select((a.per.end + 1).cast("bigint").alias("period"), "user", (a.per.end + 1).alias("started"), (a.per.end + 5).alias("updated")))
    return olap.list_periods(pub, viewer="u2@example.org")


def f02(spark, sf):
    """A published period and one that isn't, for one user."""
    a, secs = _sections(spark, sf)
    rows = materialize(P.section_rows({k: v for k, v in secs.items() if k != "Problems"}, a.per.start, a.per.start, a.per.end), "publication")
    want = [a.per.start, a.per.end + 1]
    got = R.document_fields(olap.fetch_data(rows, want, viewer="u1@example.org").select("period", "user", "section", "entry"))
    none = F.lit(None)
    missing = olap.missing_periods(rows, want).select(
        "period", *[none.cast(t).alias(c) for c, t in got.dtypes if c != "period"])
    return got.unionByName(missing)


def f03(spark, sf):
    d = _read(spark, sf, "documents")
    contents, refs = olap.dedupe_sections(d, ["doc_id"], "text")
    n = refs.groupBy("content_id").agg(F.count(F.lit(1)).alias("n_refs"), F.min("doc_id").alias("first_doc"))
    return n.join(contents.select("content_id", F.length("text").cast("bigint").alias("n_chars")), "content_id")


def f04(spark, sf):
    a, secs = _sections(spark, sf)
    return olap.flatten(a.per.start, secs)


def e10(spark, sf):
    sr = R.latest_sys_ratio(analysis(spark, sf), ordered=False)
    x = R.with_percentages(sr, *R.PERCENTAGES["sys_ratio"])
    return x.select("user", "jobid", "stepid", "tot_in_batch", *[c for c in x.columns if c.endswith("_pct")])


def e10_gpu(spark, sf):
    x = R.with_percentages(R.latest_gpu_usage(analysis(spark, sf)), *R.PERCENTAGES["gpu_usage"])
    return x.select("user", "jobid", "stepid", "gpuid", "measurement_cnt", *[c for c in x.columns if c.endswith("_pct")])


def e20(spark, sf):
    return R.document_fields(R.export_user_documents(analysis(spark, sf), spark))


def f06(spark, sf):
    types = olap.promote_types(f04(spark, sf))
    return spark.createDataFrame(sorted(types.items()), "column_name string, type string")


def f07(spark, sf):
    flat = f04(spark, sf)
    x = olap.with_expressions(flat)
    return x.select("Period", "User", "Source", "Job", "Step", "Node", *[e[0] for e in olap.EXPRESSIONS])


def f08(spark, sf):
    """Means are sums of doubles in any order: compared to six decimals, away from their halves (0.5001, as in the oracle)."""
    out = olap.rollup_report(f04(spark, sf))
    return out.select(*[((F.floor(F.col(f"`{c}`") * 1000000 + 0.5001)) / 1000000).alias(c) if t == "double" else F.col(f"`{c}`")
                        for c, t in out.dtypes])


# ---- D: parts of the chain with results of their own ---------------------------------------------
def d02(spark, sf):
    return analysis(spark, sf).user_stream.select("recordid", "watcherid", "jobid", "stepid", "user", "name", "target_node",
                                                  "latest_recordid")


def d05(spark, sf):
    return analysis(spark, sf).active_groups


def d06(spark, sf):
    """The sampling interval in force at every measurement, by the binned range join."""
    a = analysis(spark, sf)
    freq = a.mon.scrape_freq_log.select("start", "scrape_interval", F.lead("start").over(Window.orderBy("start")).alias("endval"))
    x = binned_range_join(a.mon.measurements.select("recordid"), "recordid", freq, "start", "endval", 256, a.per.end)
    return x.select("recordid", "scrape_interval")


def d07(spark, sf):
    return analysis(spark, sf).timeseries.select("recordid", "watcherid", "jobid", "stepid", "ncpu")


def d09(spark, sf):
    return analysis(spark, sf).ratio_classes.select("recordid", "jobid", "stepid", "cat")


def d11(spark, sf):
    """GPU rows that are not repeated stale readings."""
    return analysis(spark, sf).gpu_flagged.select("batch", "pid", "gpuid", "jobid", "stepid", "age", "util")


def d14(spark, sf):
    return analysis(spark, sf).gpucpu_usage.where(F.col("ngpu_in_use").isNotNull()).select(
        "user", "jobid", "stepid", "node", "ngpu_in_use", "cnt_gpu", "ngpu", "node_tot")


def d15(spark, sf):
    return analysis(spark, sf).gpucpu_usage.where(F.col("ngpu_in_use").isNull()).select(
        "user", "jobid", "stepid", "node", "ncpu_in_use", "cnt_cpu", "ncpu", "node_tot")


def a18(spark, sf):
    """Two periods are published, the second one twice as it grows, and all are read back."""
    a, secs = _sections(spark, sf)
    secs = {k: v for k, v in secs.items() if k != "Problems"}
    path = scratch_path(spark, "publication")
    P.write_period(P.section_rows(secs, a.per.start, a.per.start, a.per.end), path)
    P.write_period(P.section_rows({"MemUsage": secs["MemUsage"].limit(0)}, a.per.end, a.per.end, a.per.end), path)
    P.write_period(P.section_rows({"MemUsage": secs["MemUsage"]}, a.per.end, a.per.end, a.per.end + 1), path)
    P.write_period(P.section_rows({"MemUsage": secs["MemUsage"]}, a.per.end, a.per.end, a.per.end + 2), path)
    return R.document_fields(P.read_periods(spark, path).select("period", "started", "updated", "user", "section", "entry"))


# ---- S --------------------------------------------------------------------------------------------
def s02(spark, sf):
    mon = fixtures.load(spark, sf)
    gated = S.replay_to_table(mon.measurements, "recordid", 4,
                              lambda path: S.quality_gate_stream(S.read_measurement_stream(spark, path), mon.watcher), "quality-gate")
    return gated.select("recordid", "watcherid", "jobid", "stepid")


def s03(spark, sf):
    mon = fixtures.load(spark, sf)
    src = scratch_path(spark, "stream-src")
    mon.measurements.write.parquet(src)
    st = S.read_measurement_stream(spark, src)
    return S.run_to_table(S.dedupe_stream(st, ["watcherid", "jobid", "stepid"]), "dedupe").select(
        "watcherid", "jobid", "stepid")


def _r(fn):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return round_doubles(fn(spark, sf))
    run.__doc__ = fn.__doc__
    return run


REGISTRY_OPS = {
    "a18_published_periods": _r(a18), "d02_user_measurements": _r(d02), "d05_active_groups": _r(d05), "d06_interval_join": _r(d06),
    "d07_cpu_join": _r(d07), "d09_ratio_class": _r(d09), "d11_fresh_gpu_rows": _r(d11), "d14_gpus_in_use": _r(d14), "d15_cpus_in_use": _r(d15),
    "a01_normalize_jobs": _r(a01), "a02_accounting_measurements": _r(a02), "a03_scrape_measurements": _r(a03),
    "a04_scrape_gpu_measurements": _r(a04), "a05_application_usage": _r(a05), "a06_cpu_available": _r(a06),
    "a07_quality_gate": _r(a07), "a08_interval_change_log": _r(a08), "a09_watcher_registry": _r(a09),
    "a10_validate": _r(a10), "a11_analysis_range": _r(a11), "a12_fetch_range": _r(a12),
    "a13_filter_states": _r(a13), "a15_backfill_watcher": _r(a15), "a16_upgrade_schema": _r(a16), "a14_latest_global_record": _r(a14),
    "a14_replace_global": _r(a14_replace),
    "b01_tres_decode": _r(b01), "b02_explode_hostlist": _r(b02), "b03_cpuset_count": _r(b03),
    "b04_clock_reasons": _r(b04), "b05_step_name": _r(b05), "b06_parse_entity": _r(b06),
    "b07_slurm_duration": _r(b07), "b08_split_ticks": _r(b08), "b09_parse_proc_stat": _r(b09),
    "g01_machine_name": _r(g01), "g02_user_of_address": _r(g02),
    "c01_process_tree_rollup": _r(c01), "c03_step_applications": _r(c03), "c04_attribute_gpu_by_pid": _r(c04),
    "c05_attribute_gpu_by_job": _r(c05), "c06_latest_gpu_job": _r(c06), "c07_pivot_gpu_metrics": _r(c07),
    "c08_gpu_process_rows": _r(c08), "c09_node_load": _r(c09), "c10_node_partition": _r(c10),
    "c11_ranked_nodes": _r(c11), "c12_job_accounting_summary": _r(c12),
    "e10_with_percentages": _r(e10), "e10_gpu_percentages": _r(e10_gpu), "e20_user_documents": _r(e20), "f06_promote_types": _r(f06),
    "f01_list_periods": _r(f01), "f01_list_periods_viewer": _r(f01_viewer),
    "f02_fetch_data": _r(f02), "f03_shared_sections": _r(f03),
    "f04_flatten": _r(f04), "f07_expressions": _r(f07), "f08_rollup_report": _r(f08),
    "s02_quality_gate_stream": _r(s02), "s03_dedupe_stream": _r(s03),
}
