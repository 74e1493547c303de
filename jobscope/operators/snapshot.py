"""Snapshot analytics (C1-C12): process trees, GPU attribution, node load.

Process trees are resolved with pointer doubling (one self-join per round,
log2(depth) rounds) instead of recursion, and every round is checkpointed into
``spark.checkpoint.dir`` so lineage stays short and lost executors only cost
one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobscope.functions.decode import clock_reasons, hostlist_array, tres_map, tres_sum
from jobscope.session import ensure_checkpoint_dir

K = ["host", "ts"]
# fixed values: helper processes that are not applications of a step
HELPER_COMMANDS = ["slurmstepd", "slurm_script", "srun"]


# ---- C1 / C2: nearest step root of every process -----------------------------------------
def nearest_root(procs: DataFrame, roots: DataFrame) -> DataFrame:
    """(host, ts, pid) -> root pid of the step it runs under (NULL if none).

    A root maps to itself; another process follows its parent.  A parent that
    is missing or vanished (``alive`` false) cuts the chain: a vanished child
    is dropped from its parent's child list, so its own subtree is not reached.
    """
    ensure_checkpoint_dir(procs.sparkSession)
    r = roots.select(*K, "pid").distinct().withColumn("__root", F.lit(True))
    p = procs.select(*K, "pid", "ppid", F.coalesce(F.col("alive"), F.lit(True)).alias("alive")) \
             .join(r, K + ["pid"], "left").withColumn("__root", F.coalesce(F.col("__root"), F.lit(False)))
    parents = p.select(*K, F.col("pid").alias("ppid"), F.col("alive").alias("__palive"))
    s = p.join(parents, K + ["ppid"], "left")
    s = s.select(*K, "pid", "__root", F.when(F.col("__root"), F.col("pid"))
                 .when((F.col("ppid") != F.col("pid")) & F.coalesce(F.col("__palive"), F.lit(False)), F.col("ppid"))
                 .alias("ptr")).checkpoint(eager=True)
    return _double(s)


def _double(s: DataFrame) -> DataFrame:
    """ptr := ptr(ptr) until nothing changes (log2 of the tree depth rounds).

    A path of n processes ends after log2(n) rounds; one that goes on is a cycle
    of parents (a pid used again within the snapshot), and is an error."""
    cur, rounds = s, max(s.count(), 1).bit_length() + 2
    while True:
        rounds -= 1
        if rounds < 0:
            raise ValueError("the parents of some processes form a cycle: their steps cannot be told")
        t = cur.select(*K, F.col("pid").alias("ptr"), F.col("ptr").alias("__next"))
        nxt = cur.join(t, K + ["ptr"], "left") \
                 .select(*K, "pid", "__root", F.col("ptr").alias("__old"), F.col("__next").alias("ptr"))
        nxt = nxt.checkpoint(eager=True)
        changed = nxt.where(~F.col("__old").eqNullSafe(F.col("ptr"))).limit(1).count()
        cur = nxt.drop("__old")
        if changed == 0:
            break
    roots = cur.where(F.col("__root")).select(*K, F.col("pid").alias("ptr"))
    return cur.join(roots.withColumn("__is", F.lit(True)), K + ["ptr"], "left") \
              .select(*K, "pid", F.when(F.col("__is"), F.col("ptr")).alias("root"))


def process_tree_rollup(procs: DataFrame, roots: DataFrame, gpu_rows: DataFrame | None = None) -> DataFrame:
    """Per step root Σ(own + reaped) user/sys ticks and faults, Σ rchar /
    wchar, max RSS, Σ GPU rows.  A vanished process gives only its I/O and RSS."""
    nr = nearest_root(procs, roots)
    p = procs.join(nr, K + ["pid"]).where(F.col("root").isNotNull())
    alive = F.coalesce(F.col("alive"), F.lit(True))
    t = lambda a, b: F.when(alive, F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))).otherwise(0)
    agg = p.groupBy(*K, "root").agg(
        F.sum(t("utime", "cutime")).cast("bigint").alias("utime"),
        F.sum(t("stime", "cstime")).cast("bigint").alias("stime"),
        F.sum(t("minflt", "cminflt")).cast("bigint").alias("minor_pagefault"),
        F.sum("rchar").cast("bigint").alias("rchar"), F.sum("wchar").cast("bigint").alias("wchar"),
        F.max("rss").cast("bigint").alias("res"), F.count(F.lit(1)).alias("nproc"))
    if gpu_rows is not None:
        g = gpu_rows.join(nr, K + ["pid"]).where(F.col("root").isNotNull()) \
                    .groupBy(*K, "root").agg(F.count(F.lit(1)).alias("gpu_measurement_cnt"))
        agg = agg.join(g, K + ["root"], "left").withColumn(
            "gpu_measurement_cnt", F.coalesce(F.col("gpu_measurement_cnt"), F.lit(0)))
    rs = roots.select(*K, F.col("pid").alias("root"), "jobid", "stepid")
    return agg.join(rs, K + ["root"])


# ---- C3 ------------------------------------------------------------------------------------
def step_applications(procs: DataFrame, roots: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Distinct command names per step (helpers excluded), merged over snapshots."""
    ex = list(HELPER_COMMANDS) + list(exclude or [])
    nr = nearest_root(procs, roots)
    p = procs.where(F.coalesce(F.col("alive"), F.lit(True))).join(nr, K + ["pid"]).where(F.col("root").isNotNull())
    rs = roots.select(*K, F.col("pid").alias("root"), "jobid", "stepid")
    return p.join(rs, K + ["root"]).where(~F.col("comm").isin(ex)) \
            .select("jobid", "stepid", F.col("comm").alias("application")).distinct()


# ---- C4 / C5 / C6 / C7 / C8 ----------------------------------------------------------------
def attribute_gpu_by_pid(gpu_rows: DataFrame, procs: DataFrame, roots: DataFrame) -> DataFrame:
    """A GPU row takes the step of the process tree its pid runs in."""
    nr = nearest_root(procs, roots)
    rs = roots.select(*K, F.col("pid").alias("root"), "jobid", "stepid")
    return gpu_rows.join(nr, K + ["pid"]).join(rs, K + ["root"]).drop("root")


def attribute_gpu_by_job(gpu_rows: DataFrame, steps: DataFrame) -> DataFrame:
    """A GPU row (with a job id) takes the first step of that job seen on the
    host; with several steps there the step is unknown (NULL)."""
    s = steps.groupBy(*K, "jobid").agg(F.countDistinct("stepid").alias("__n"),
                                       F.min_by("stepid", "seen").alias("__first"))
    x = gpu_rows.join(s, K + ["jobid"], "left")
    return x.withColumn("stepid", F.when(F.col("__n") == 1, F.col("__first"))
                        .when(F.col("__n") > 1, F.lit(None))).drop("__n", "__first")


def latest_gpu_job(entities: DataFrame) -> DataFrame:
    """Latest job per (host, gpu) by update time."""
    return entities.groupBy("host", "gpuid").agg(F.max_by("jobid", "time").alias("jobid"),
                                                  F.max("time").alias("time"))


# fixed values: REST metric names and their scaling into the GPU row units
GPU_METRICS = [("power_usage", "power_usage", 100.0), ("sm_clock", "sm_clock", 1e-6),
               ("utilization", "util", 100.0), ("temperature", "temperature", 1.0)]


def pivot_gpu_metrics(metrics: DataFrame) -> DataFrame:
    """metrics(host, measurable 'gpu_<metric>:gpu<N>', raw, age) -> one row per GPU."""
    m = metrics.select(
        "host", F.regexp_extract("measurable", r"^gpu_([^:]*):", 1).alias("metric"),
        F.regexp_extract("measurable", r":gpu([0-9]+)$", 1).cast("bigint").alias("gpuid"), "raw", "age")
    wide = m.groupBy("host", "gpuid").pivot("metric", [n for n, _, _ in GPU_METRICS]).agg(F.max("raw"))
    ages = m.groupBy("host", "gpuid").agg(F.max("age").cast("bigint").alias("age"))
    cols = [F.floor(F.col(f"`{n}`") * f).cast("bigint").alias(out) for n, out, f in GPU_METRICS]
    return wide.join(ages, ["host", "gpuid"]).select("host", "gpuid", "age", *cols)


def gpu_process_rows(devices: DataFrame) -> DataFrame:
    """One GPU row per (device, running pid); devices without processes are
    dropped; the throttle bits are OR-ed into the reason text."""
    mask = F.aggregate(F.coalesce(F.col("throttle_bits"), F.array().cast("array<bigint>")),
                       F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    d = devices.where(F.size("processes") > 0).withColumn("__mask", mask) \
               .withColumn("pid", F.explode("processes"))
    return d.drop("processes", "throttle_bits").withColumn("clock_limit_reason", clock_reasons(F.col("__mask"))) \
            .drop("__mask")


# ---- C9 / C10 / C11 ----------------------------------------------------------------------------
def node_load(jobs: DataFrame) -> DataFrame:
    """Running steps per node (the job row counts when it has no steps), with
    the check of the expected node count per entry."""
    running = jobs.where(F.lower(F.col("state")) == "running")
    steps = running.select("jobid", F.explode_outer("steps").alias("s"), F.col("nodes").alias("__jn"),
                           F.col("nnodes").alias("__jnn"))
    entries = steps.select("jobid", F.coalesce(F.col("s.nodes"), F.col("__jn")).alias("nodes"),
                           F.coalesce(F.col("s.nnodes"), F.col("__jnn")).alias("nnodes"))
    e = entries.withColumn("__nodes", hostlist_array("nodes"))
    e = e.withColumn("node_count_ok", F.size("__nodes") == F.col("nnodes"))
    per_node = e.select("jobid", "node_count_ok", F.explode("__nodes").alias("node"))
    return per_node.groupBy("node").agg(F.count(F.lit(1)).alias("cnt"),
                                        F.min(F.col("node_count_ok")).alias("node_count_ok"))


def node_partition(partitions: DataFrame) -> DataFrame:
    """A node takes the first partition listing it: max_nodes 0 (unlimited)
    first, then larger max_nodes, then shorter max_time, infinite (NULL) last."""
    p = partitions.withColumn("node", F.explode(hostlist_array("nodes")))
    rank = F.struct(F.when(F.col("max_nodes") == 0, 0).otherwise(1).alias("a"),
                    (-F.col("max_nodes")).alias("b"),
                    F.when(F.col("max_time").isNull(), 1).otherwise(0).alias("c"),
                    F.col("max_time").alias("d"), F.col("name").alias("e"))
    return p.groupBy("node").agg(F.min_by("name", rank).alias("partition"))


def ranked_nodes(load: DataFrame, partition_of: DataFrame) -> DataFrame:
    """Busy-node ranking inside each partition (descending step count)."""
    x = load.join(partition_of, "node")
    # one partition's nodes (bounded by the cluster's node count) per window task
    w = Window.partitionBy("partition").orderBy(F.col("cnt").desc(), "node")
    return x.withColumn("rank", F.rank().over(w).cast("bigint"))


# ---- C12 -----------------------------------------------------------------------------------------
def job_accounting_summary(jobs_raw: DataFrame) -> DataFrame:
    """Per job: steps, Σ TRES in/out (maps), Σ user/sys/total CPU time and the
    sys/user ratio in percent (user + 1 µs in the denominator)."""
    s = jobs_raw.select("jobid", F.explode_outer("steps").alias("s"))
    us = F.col("s.user_cpu_sec") * 1000000 + F.col("s.user_cpu_usec")
    ss = F.col("s.sys_cpu_sec") * 1000000 + F.col("s.sys_cpu_usec")
    x = s.select("jobid", us.alias("u"), ss.alias("y"), F.col("s").isNotNull().alias("has"),
                 tres_map(F.col("s.tres_usage_in_tot")).alias("tin"),
                 tres_map(F.col("s.tres_usage_out_tot")).alias("tout"))
    base = x.groupBy("jobid").agg(
        F.count_if("has").alias("nsteps"), F.coalesce(F.sum("u"), F.lit(0)).cast("bigint").alias("user_usec"),
        F.coalesce(F.sum("y"), F.lit(0)).cast("bigint").alias("sys_usec"))
    base = base.withColumn("tot_usec", F.col("user_usec") + F.col("sys_usec")) \
               .withColumn("sys_user_pct", F.col("sys_usec") / (F.col("user_usec") + 1.0) * 100)
    tin = tres_sum(x.where(F.col("has")), ["jobid"], "tin", "tres_in")
    tout = tres_sum(x.where(F.col("has")), ["jobid"], "tout", "tres_out")
    return base.join(tin, "jobid", "left").join(tout, "jobid", "left")
