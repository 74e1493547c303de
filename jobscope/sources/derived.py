"""Raw records derived from the driver's tables, for the ingest and snapshot
operators (their sources in production are the accounting system, scrape
envelopes and host snapshots).  Every builder reads whole tables, so the work
grows with them.  The matching DuckDB text lives in jobscope.oracle.ops_sql.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

L = "bigint"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> F.Column:
    return c.cast("string")


def _pad2(c) -> F.Column:
    return F.lpad(_s(c), 2, "0")


def jobs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounting records: one per order, steps from its line items (<= 13)."""
    o, li = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    order_keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                  "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    w = Window.partitionBy("l_orderkey").orderBy(*order_keys)
    s = li.withColumn("step_id", (F.row_number().over(w) - 1).cast(L))
    start = F.col("l_orderkey") * 100 + F.col("l_linenumber") + 1700000000
    step = F.struct(
        F.col("step_id"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("stepname"),
        F.concat(F.lit("srun -n "), _s(F.floor("l_quantity"))).alias("submit_line"),
        start.cast(L).alias("start"), (start + F.floor("l_quantity") * 60).cast(L).alias("end"),
        F.concat(F.lit("node["), _pad2(F.col("l_suppkey") % 40), F.lit("-"),
                 _pad2(F.col("l_suppkey") % 40 + F.col("l_linenumber") % 3), F.lit("]")).alias("nodes"),
        (F.col("l_linenumber") % 3 + 1).cast(L).alias("nnodes"),
        (F.floor("l_quantity") * 10).cast(L).alias("user_cpu_sec"),
        (F.floor("l_extendedprice") % 1000000).cast(L).alias("user_cpu_usec"),
        F.floor(F.col("l_discount") * 100).cast(L).alias("sys_cpu_sec"),
        F.floor(F.col("l_tax") * 1000000).cast(L).alias("sys_cpu_usec"),
        F.concat(F.lit("2="), _s(F.floor(F.col("l_extendedprice") * 1000)), F.lit(",6="),
                 _s(F.col("l_partkey"))).alias("tres_usage_in_max"),
        F.concat(F.lit("1="), _s(F.col("l_linenumber")), F.lit(",6="),
                 _s(F.col("l_partkey") * 10)).alias("tres_usage_in_tot"),
        F.concat(F.lit("6="), _s(F.col("l_suppkey") * 10)).alias("tres_usage_out_tot"))
    steps = s.groupBy(F.col("l_orderkey").alias("jobid")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    k = F.col("o_orderkey")
    jstart = k * 100 + 1700000000
    jobs = o.select(
        k.alias("jobid"), F.concat(F.lit("u"), _s(F.col("o_custkey") % 7)).alias("user"),
        F.col("o_orderpriority").alias("jobname"), F.concat(F.lit("sbatch "), F.col("o_orderstatus")).alias("submit_line"),
        (k % 50 * 5 + 10).cast(L).alias("timelimit"), jstart.cast(L).alias("start"),
        F.when(F.col("o_orderstatus") == "O", F.lit(0).cast(L)).otherwise(jstart + 3600 + k % 600).cast(L).alias("end"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running")
         .otherwise("pending").alias("state"),
        F.concat(F.lit("node["), _pad2(F.col("o_custkey") % 40), F.lit("-"),
                 _pad2(F.col("o_custkey") % 40 + k % 3), F.lit("],login"), _s(k % 2)).alias("nodes"),
        (k % 3 + 2).cast(L).alias("nnodes"),
        F.concat(F.lit("1="), _s(k % 12 + 1), F.lit(",2="), _s((k % 8 + 1) * 1024), F.lit(",4="),
                 _s(F.when(k % 13 == 0, F.lit(0)).otherwise(k % 3 + 2)), F.lit(",1001="), _s(k % 3))
         .alias("tres_alloc_str"),
        (k % 4 != 0).alias("track_steps"),
        F.struct((F.floor("o_totalprice") % 100000).cast(L).alias("user_cpu_sec"),
                 (k % 1000000).cast(L).alias("user_cpu_usec"),
                 (F.col("o_custkey") % 1000).cast(L).alias("sys_cpu_sec"),
                 (k * 7 % 1000000).cast(L).alias("sys_cpu_usec"),
                 F.concat(F.lit("2="), _s(F.floor(F.col("o_totalprice") * 100))).alias("tres_usage_in_max"),
                 F.concat(F.lit("6="), _s(F.col("o_custkey"))).alias("tres_usage_in_tot"),
                 F.concat(F.lit("6="), _s(k)).alias("tres_usage_out_tot")).alias("stats"))
    return jobs.join(steps, "jobid", "left")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrape envelopes: one per event, carrying one sample, its GPU rows
    (event_id % 3 of them), an application and a CPU count."""
    e = _read(spark, sf_dir, "events")
    eid, uid, v = F.col("event_id"), F.col("user_id"), F.col("value")
    gpu = F.transform(F.expr("slice(sequence(0, 2), 1, int(event_id % 3))"),
                      lambda i: F.struct(i.cast(L).alias("gpuid"), (i + 100).cast(L).alias("pid"),
                                         (eid % 5).cast(L).alias("age"), F.floor(v * 10).cast(L).alias("power_usage"),
                                         (eid % 40 + 30).cast(L).alias("temperature"),
                                         (uid % 7 * 100 + 900).cast(L).alias("sm_clock"),
                                         (eid % 101).cast(L).alias("util"),
                                         F.lit("-").alias("clock_limit_reason"), F.lit("nvml").alias("source")))
    result = F.struct(
        (eid % 25 + 1).cast(L).alias("watcherid"), (uid + 1).cast(L).alias("jobid"),
        (eid % 3 - 1).cast(L).alias("stepid"),
        F.floor(v * 100).cast(L).alias("utime"), F.floor(v * 30).cast(L).alias("stime"),
        F.when(F.col("event_type") == "view", F.lit(0)).otherwise(F.floor(v * 1000)).cast(L).alias("rchar"),
        F.floor(v * 500).cast(L).alias("wchar"), (F.floor(v * 1000) * 4096).cast(L).alias("res"),
        (eid % 1000).cast(L).alias("minflt"), gpu.alias("gpu"))
    return e.select(
        F.concat(F.lit("node-"), _s(uid % 5)).alias("worker"), eid.cast(L).alias("seq"),
        F.array(result).alias("scrape_results"),
        F.array(F.struct((uid + 1).cast(L).alias("jobid"), (eid % 3 - 1).cast(L).alias("stepid"),
                         F.col("event_type").alias("application"))).alias("usages"),
        F.array(F.struct((eid % 25 + 1).cast(L).alias("watcherid"), (uid + 1).cast(L).alias("jobid"),
                         (eid % 3 - 1).cast(L).alias("stepid"), (eid % 16 + 1).cast(L).alias("ncpu")))
        .alias("cpu_available"))


def proc_snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One host snapshot: every event is a process, ppid = event_id div 3 (a
    heap-shaped tree); 'signup' processes are step roots; 'error' ones vanished."""
    e = _read(spark, sf_dir, "events")
    eid, v = F.col("event_id"), F.col("value")
    procs = e.select(
        F.lit("node-0").alias("host"), F.lit(0).cast(L).alias("ts"), eid.cast(L).alias("pid"),
        F.floor(eid / 3).cast(L).alias("ppid"), F.col("event_type").alias("comm"),
        F.floor(v * 10).cast(L).alias("utime"), F.floor(v * 3).cast(L).alias("stime"),
        (eid % 7).cast(L).alias("cutime"), (eid % 5).cast(L).alias("cstime"),
        (eid % 100).cast(L).alias("minflt"), (eid % 11).cast(L).alias("cminflt"),
        (F.floor(v * 1000) * 4096).cast(L).alias("rss"), (eid * 10).cast(L).alias("rchar"),
        (eid % 1000).cast(L).alias("wchar"), (F.col("event_type") != "error").alias("alive"))
    roots = e.where(F.col("event_type") == "signup").select(
        F.lit("node-0").alias("host"), F.lit(0).cast(L).alias("ts"), eid.cast(L).alias("pid"),
        F.col("user_id").cast(L).alias("jobid"), (eid % 3).cast(L).alias("stepid"))
    return procs, roots


def gpu_pid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.where(F.col("event_type") == "purchase").select(
        F.lit("node-0").alias("host"), F.lit(0).cast(L).alias("ts"), F.col("event_id").cast(L).alias("pid"),
        (F.col("event_id") % 4).cast(L).alias("gpuid"), (F.col("event_id") % 101).cast(L).alias("util"))


# fixed values: the metric each event type reports in the GPU REST fixture
EVENT_METRIC = [("click", "power_usage"), ("purchase", "sm_clock"), ("signup", "utilization"),
                ("error", "temperature"), ("view", "memory_used")]


def gpu_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("node-"), _s(F.col("user_id") % 5)).alias("host"),
                    (F.col("event_id") % 4).cast(L).alias("gpuid"), F.col("user_id").cast(L).alias("jobid"),
                    F.col("event_id").cast(L).alias("time"))


def gpu_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    m = F.create_map(*[x for a, b in EVENT_METRIC for x in (F.lit(a), F.lit(b))])
    return e.select(F.concat(F.lit("node-"), _s(F.col("user_id") % 5)).alias("host"),
                    F.concat(F.lit("gpu_"), F.element_at(m, F.col("event_type")), F.lit(":gpu"),
                             _s(F.col("event_id") % 12)).alias("measurable"),
                    F.col("value").alias("raw"), (F.col("event_id") % 7).cast("double").alias("age"))


def gpu_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(F.concat(F.lit("node-"), _s(F.col("user_id") % 5)).alias("host"), eid.cast(L).alias("ts"),
                    (eid % 4).cast(L).alias("gpuid"), (eid % 101).cast(L).alias("util"),
                    F.expr("transform(slice(sequence(0, 2), 1, int(event_id % 3)), i -> event_id * 10 + i)")
                     .alias("processes"),
                    F.array((eid % 8).cast(L), F.when(F.col("event_type") == "error", F.lit(0x1000))
                            .otherwise(F.lit(0)).cast(L)).alias("throttle_bits"))


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(F.concat(F.lit("p"), _s(k)).alias("name"),
                    F.concat(F.lit("node["), _pad2(k % 40), F.lit("-"), _pad2(k % 40 + k % 4), F.lit("]")).alias("nodes"),
                    (k % 5 * 2).cast(L).alias("max_nodes"),
                    F.when(k % 6 == 0, F.lit(None)).otherwise(k % 7 * 60).cast(L).alias("max_time"))


def interval_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return e.select((F.col("event_id") + 1).cast(L).alias("start"),
                    (F.col("user_id") % 3 * 10 + 10).cast(L).alias("scrape_interval"),
                    F.col("event_id").cast(L).alias("seq"))


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    return e.select(
        (eid + 1).cast(L).alias("id"), (uid + 1000).cast(L).alias("pid"),
        F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.concat(F.lit("node-"), _s(uid % 5)))
         .alias("target_node"),
        F.when(F.col("event_type") == "click", uid).otherwise(F.lit(0)).cast(L).alias("jobid"),
        F.when(F.col("event_type") == "click", eid % 2).cast(L).alias("stepid"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("privileged"),
        (eid * 60).cast(L).alias("lastfetch"))


def constraint_rows(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw rows of every constrained table, one per event, in which each rule is broken by some rows and each
    nullable column is NULL in others."""
    e = _read(spark, sf_dir, "events")

    def table(**columns: str) -> DataFrame:
        return e.select(*[F.expr(x).alias(c) for c, x in columns.items()])

    def gap(n: int, x: str) -> str:
        return f"CASE WHEN event_id % {n} = 0 THEN NULL ELSE {x} END"

    return {
        "watcher": table(pid=gap(41, "event_id % 37 - 1"), jobid=gap(43, "user_id % 11 - 1"), privileged=gap(47, "event_id % 3"),
                         lastfetch=gap(53, "event_id * 60"), prev_lastfetch=gap(59, "event_id * 60 + event_id % 5 - 3")),
        "jobinfo": table(jobid=gap(41, "event_id % 29"), stepid="CASE WHEN event_id % 2 = 0 THEN event_id % 7 END",
                         user="CASE WHEN event_id % 4 < 2 THEN 'u' END", ngpu="CASE WHEN event_id % 6 < 3 THEN 1 END",
                         started_at=gap(43, "event_id % 23"), ended_at=gap(47, "event_id % 31"), nnodes=gap(53, "event_id % 3"),
                         ncpu=gap(59, "event_id % 5 - 1")),
        "measurements": table(watcherid=gap(41, "1"), jobid=gap(43, "user_id"), user_sec=gap(47, "event_id % 2"), user_usec=gap(53, "0"),
                              sys_sec=gap(59, "0"), sys_usec=gap(61, "event_id % 3")),
        "gpu_measurements": table(watcherid=gap(41, "1"), batch=gap(43, "event_id % 13"), jobid=gap(47, "user_id"), pid=gap(53, "1"),
                                  gpuid=gap(59, "event_id % 4"), source=gap(61, "'nvml'"), sm_clock=gap(5, "event_id % 3"),
                                  util=gap(7, "event_id % 4 - 1")),
        "application_usage": table(jobid=gap(41, "user_id"), stepid=gap(43, "0"), application=gap(47, "event_type")),
        "analyze_user_info": table(user=gap(41, "event_type"), skip=gap(43, "event_id % 3")),
        "scrape_freq_log": table(start=gap(41, "event_id % 17"), scrape_interval=gap(43, "event_id % 19 * 10")),
        "job_step_cpu_available": table(watcherid=gap(41, "1"), jobid=gap(43, "user_id"), stepid=gap(47, "0"), ncpu=gap(53, "4")),
    }


def old_jobinfo(current: DataFrame, version: int) -> DataFrame:
    """The rows of ``current`` as layout ``version`` (2 to 5) held them."""
    held = ["jobid", "stepid", "user", "name", "submit_line", "mem", "ngpu"]
    held += ["ncpu", "timelimit", "ended_at"] if version >= 3 else []
    held += ["started_at"] if version >= 4 else []
    node = F.concat(F.lit("node-"), (F.col("jobid") % 5).cast("string")).alias("node")
    return current.select(*held, F.col("nnodes") if version >= 5 else node)


def new_global_rows(measurements: DataFrame) -> DataFrame:
    """One accounting row for each second job and step, and for as many jobs that were never measured."""
    step = measurements.where(F.col("jobid") % 2 == 0).groupBy("jobid", "stepid").agg(
        F.max("user_sec").alias("user_sec"), F.max("sys_sec").alias("sys_sec"), F.max("res_size").alias("res_size"))
    rows = step.unionByName(step.withColumn("jobid", F.col("jobid") + 1000000))
    null = F.lit(None).cast(L)
    return rows.select(
        F.lit(8).cast(L).alias("watcherid"), "jobid", "stepid", null.alias("dev_in"), null.alias("dev_out"), "user_sec",
        F.lit(1).cast(L).alias("user_usec"), "sys_sec", F.lit(2).cast(L).alias("sys_usec"),
        (F.col("user_sec") * 1000000 + 1 + F.col("sys_sec") * 1000000 + 2).alias("tot_time"), "res_size",
        null.alias("minor_pagefault"), null.alias("gpu_measurement_batch"))
