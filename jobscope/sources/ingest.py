"""Ingest normalisation (A1-A16): raw accounting / scrape records -> the
monitoring tables, with the reference's insert rules expressed as DataFrame
operations (latest-wins, insert-ignore, the measurement quality gate, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.functions.decode import split_ticks, tres_get, tres_map
from jobscope.operators.core import null_safe_join
from jobscope.plans.joins import broadcast_if_small
from jobscope.plans.scan import keep_rows, key_sizes, ordered_scan
from jobscope.session import scan_chunk

L = "bigint"

# fixed values: TRES ids of the accounting system (cpu, mem, node, fs/disk, gres/gpu)
TRES_IDS = {"cpu": 1, "mem": 2, "node": 4, "disk": 6, "gpu": 1001}

# fixed values: watcher sources and their accuracy (higher = more accurate)
SOURCE_ACCURACY = {"parent": 3, "privileged": 2, "sacct": 1, "raw_readings": 0}


# ---- A1 ------------------------------------------------------------------------------
def normalize_jobs(jobs_raw: DataFrame, tres: dict[str, int] = TRES_IDS,
                   seq: Column | None = None) -> DataFrame:
    """Accounting snapshot -> jobinfo rows (a log: later snapshots win, A1).

    Job row: mem = mem TRES * 1024^2, ncpu/ngpu/nnodes from TRES; a job with
    nnodes = 0 is skipped with its steps.  Step rows only when the job tracks
    steps: user, limits and counts NULL, peak_res_size = usage-max mem TRES.
    ``ingest_seq`` (a struct) orders snapshots, then the job row and its steps by
    position, however many steps a job has."""
    seq = seq if seq is not None else F.lit(0).cast(L)
    j = jobs_raw.withColumn("__alloc", tres_map(F.col("tres_alloc_str"))).withColumn("__seq", seq.cast(L))
    j = j.where(tres_get(F.col("__alloc"), tres["node"]) != 0)
    jobs = j.select(
        F.col("jobid").cast(L).alias("jobid"), F.lit(None).cast(L).alias("stepid"),
        F.col("user"), F.col("jobname").alias("name"), "submit_line",
        F.col("timelimit").cast(L).alias("timelimit"), F.col("start").cast(L).alias("started_at"),
        F.col("end").cast(L).alias("ended_at"),
        (tres_get(F.col("__alloc"), tres["mem"]) * 1024 * 1024).alias("mem"),
        F.lit(None).cast(L).alias("peak_res_size"),
        tres_get(F.col("__alloc"), tres["node"]).alias("nnodes"),
        tres_get(F.col("__alloc"), tres["cpu"]).alias("ncpu"),
        tres_get(F.col("__alloc"), tres["gpu"]).alias("ngpu"),
        F.struct(F.col("__seq").alias("seq"), F.lit(-1).cast(L).alias("pos")).alias("ingest_seq"))
    st = j.where(F.col("track_steps")).select("jobid", "__seq", F.posexplode("steps").alias("__pos", "s"))
    steps = st.select(
        F.col("jobid").cast(L).alias("jobid"), F.col("s.step_id").cast(L).alias("stepid"),
        F.lit(None).cast("string").alias("user"), F.col("s.stepname").alias("name"),
        F.col("s.submit_line").alias("submit_line"), F.lit(None).cast(L).alias("timelimit"),
        F.col("s.start").cast(L).alias("started_at"), F.col("s.end").cast(L).alias("ended_at"),
        F.lit(None).cast(L).alias("mem"),
        tres_get(tres_map(F.col("s.tres_usage_in_max")), tres["mem"]).alias("peak_res_size"),
        F.lit(None).cast(L).alias("nnodes"), F.lit(None).cast(L).alias("ncpu"), F.lit(None).cast(L).alias("ngpu"),
        F.struct(F.col("__seq").alias("seq"), F.col("__pos").cast(L).alias("pos")).alias("ingest_seq"))
    return jobs.unionByName(steps)


def latest_jobinfo(log: DataFrame) -> DataFrame:
    """Insert-or-replace: the row with the largest ingest_seq per (jobid, stepid).

    A group-by with ``max_by`` (partial aggregation) instead of a window, so a
    key with many snapshots does not land in one task."""
    cols = [c for c in log.columns if c not in ("jobid", "stepid", "ingest_seq")]
    g = log.groupBy("jobid", "stepid").agg(F.max_by(F.struct(*cols), F.col("ingest_seq")).alias("__r"))
    return g.select("jobid", "stepid", *[F.col(f"__r.{c}").alias(c) for c in cols])


# ---- A2 ------------------------------------------------------------------------------
def accounting_measurements(jobs_raw: DataFrame, watcher_id: Column,
                            tres: dict[str, int] = TRES_IDS) -> DataFrame:
    """One 'global' measurement per accounted step: disk in/out, max RSS, times.

    A job that tracks no steps and has none gives one pseudo-step 0 from the
    job's own stats; if steps are not tracked, step stats := job stats."""
    j = jobs_raw.withColumn("__n", F.coalesce(F.size("steps"), F.lit(0)))
    s = j.where((F.col("__n") > 0) | ~F.col("track_steps")).select(
        "jobid", "track_steps", "stats", "__n", F.explode_outer(F.when(F.col("__n") > 0, F.col("steps"))).alias("s"))
    own = lambda f: F.when(F.col("__n") > 0, F.col(f"s.{f}")).otherwise(F.col(f"stats.{f}"))
    pick = lambda f: F.when(F.col("track_steps"), F.col(f"s.{f}")).otherwise(F.col(f"stats.{f}"))
    u = s.select(
        "jobid", F.when(F.col("__n") > 0, F.col("s.step_id")).otherwise(0).cast(L).alias("stepid"),
        own("user_cpu_sec").alias("user_sec"), own("user_cpu_usec").alias("user_usec"),
        own("sys_cpu_sec").alias("sys_sec"), own("sys_cpu_usec").alias("sys_usec"),
        pick("tres_usage_in_tot").alias("tin"), pick("tres_usage_out_tot").alias("tout"),
        pick("tres_usage_in_max").alias("tmax"))
    return u.select(
        F.lit(None).cast(L).alias("recordid"), watcher_id.cast(L).alias("watcherid"),
        F.col("jobid").cast(L).alias("jobid"), "stepid",
        tres_get(tres_map(F.col("tin")), tres["disk"]).alias("dev_in"),
        tres_get(tres_map(F.col("tout")), tres["disk"]).alias("dev_out"),
        F.col("user_sec").cast(L).alias("user_sec"), F.col("user_usec").cast(L).alias("user_usec"),
        F.col("sys_sec").cast(L).alias("sys_sec"), F.col("sys_usec").cast(L).alias("sys_usec"),
        tres_get(tres_map(F.col("tmax")), tres["mem"]).alias("res_size"),
        F.lit(None).cast(L).alias("minor_pagefault"), F.lit(None).cast(L).alias("gpu_measurement_batch"))


# ---- A3 - A6: scrape envelopes ----------------------------------------------------------
def _results(envelopes: DataFrame) -> DataFrame:
    """One row per scrape result."""
    return envelopes.select("worker", "seq", F.posexplode("scrape_results").alias("__pos", "r"))


def _with_ids(rows: DataFrame, first_recordid: int, chunk: int | None) -> DataFrame:
    """Rows of scrape results with their record ids: ids are dense and follow (envelope seq, position).  The rows are
    read twice rather than kept."""
    chunk = chunk or scan_chunk(rows.sparkSession)
    seen = ordered_scan(rows, [], ["seq", "__pos"], [("__place", "sum_incl", F.lit(1))], chunk, persist=False)
    return seen.where(F.col("seq").isNotNull()).withColumn("recordid", (F.col("__place") + (first_recordid - 1)).cast(L)).drop("__place")


def numbered_results(envelopes: DataFrame, first_recordid: int = 1, chunk: int | None = None) -> DataFrame:
    """The scrape results with their record ids; stored, they serve as ``results`` of the functions below."""
    return _with_ids(_results(envelopes), first_recordid, chunk)


def scrape_measurements(envelopes: DataFrame, hz: int = 100, first_recordid: int = 1,
                        chunk: int | None = None, results: DataFrame | None = None) -> DataFrame:
    """Flatten scrape results; ticks -> (sec, µs); rchar = 0 -> dev_in/out NULL;
    no GPU rows -> batch NULL, else batch = the sample's record id."""
    r = results if results is not None else _results(envelopes)
    us, uu = split_ticks(F.col("r.utime"), hz)
    ss, su = split_ticks(F.col("r.stime"), hz)
    has_io = F.col("r.rchar") != 0
    flat = [F.col("r.watcherid").cast(L).alias("watcherid"), F.col("r.jobid").cast(L).alias("jobid"),
            F.col("r.stepid").cast(L).alias("stepid"),
            F.when(has_io, F.col("r.rchar")).cast(L).alias("dev_in"),
            F.when(has_io, F.col("r.wchar")).cast(L).alias("dev_out"),
            us.alias("user_sec"), uu.alias("user_usec"), ss.alias("sys_sec"), su.alias("sys_usec"),
            F.col("r.res").cast(L).alias("res_size"), F.col("r.minflt").cast(L).alias("minor_pagefault")]
    has_gpu = (F.coalesce(F.size("r.gpu"), F.lit(0)) > 0).alias("__gpu")
    # numbered when they are flat: nested rows would be exchanged whole
    m = r.select("recordid", *flat, has_gpu) if results is not None \
        else _with_ids(r.select("seq", "__pos", *flat, has_gpu), first_recordid, chunk)
    return m.select("recordid", *[c for c in m.columns if c not in ("recordid", "seq", "__pos", "__gpu")],
                    F.when(F.col("__gpu"), F.col("recordid")).alias("gpu_measurement_batch"))


def scrape_gpu_measurements(envelopes: DataFrame, normalize_nvml_power: bool = True, first_recordid: int = 1,
                            chunk: int | None = None, results: DataFrame | None = None) -> DataFrame:
    """GPU rows of each sample; batch = the sample's record id; step 0 -> NULL.

    Power is stored as W x 100; NVML reports mW, so NVML rows are divided by 10
    (``normalize_nvml_power=False`` keeps the raw value, as the reference does)."""
    r = results if results is not None else numbered_results(envelopes, first_recordid, chunk)
    r = r.where(F.coalesce(F.size("r.gpu"), F.lit(0)) > 0)
    g = r.select("recordid", "r.watcherid", "r.jobid", "r.stepid", F.explode("r.gpu").alias("g"))
    return g.select(
        F.col("watcherid").cast(L).alias("watcherid"), F.col("recordid").alias("batch"),
        F.col("g.pid").cast(L).alias("pid"), F.col("jobid").cast(L).alias("jobid"),
        F.when(F.col("stepid") != 0, F.col("stepid")).cast(L).alias("stepid"),
        F.col("g.gpuid").cast(L).alias("gpuid"), F.col("g.age").cast(L).alias("age"),
        F.when(F.lit(normalize_nvml_power) & (F.col("g.source") == "nvml"),
               F.call_function("div", F.col("g.power_usage").cast(L), F.lit(10).cast(L)))
         .otherwise(F.col("g.power_usage")).cast(L).alias("power_usage"),
        F.col("g.temperature").cast(L).alias("temperature"),
        F.col("g.sm_clock").cast(L).alias("sm_clock"), F.col("g.util").cast(L).alias("util"),
        F.col("g.clock_limit_reason").alias("clock_limit_reason"), F.col("g.source").alias("source"))


def application_usage_of(envelopes: DataFrame) -> DataFrame:
    """(jobid, stepid, application) set: insert-ignore = distinct."""
    u = envelopes.select(F.explode("usages").alias("u"))
    return u.select(F.col("u.jobid").cast(L).alias("jobid"), F.col("u.stepid").cast(L).alias("stepid"),
                    F.col("u.application").alias("application")).distinct()


def cpu_available(envelopes: DataFrame) -> DataFrame:
    """CPUs available per (watcher, job, step): the first report wins."""
    c = envelopes.select("seq", F.posexplode("cpu_available").alias("__pos", "c"))
    c = c.select(F.col("c.watcherid").cast(L).alias("watcherid"), F.col("c.jobid").cast(L).alias("jobid"),
                 F.col("c.stepid").cast(L).alias("stepid"), F.col("c.ncpu").cast(L).alias("ncpu"),
                 F.struct("seq", "__pos").alias("__o"))
    return c.groupBy("watcherid", "jobid", "stepid").agg(F.min_by("ncpu", "__o").alias("ncpu"))


# ---- A7: quality gate ----------------------------------------------------------------------
def quality_gate(measurements: DataFrame, watcher: DataFrame, chunk: int | None = None, order: str = "recordid",
                 unseen: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Closed form of the insert trigger, over rows in record-id order.

    Drop tot_time = 0; drop a row when an earlier row of the same (job, step)
    came from a more accurate watcher; drop a row equal (accuracy, node,
    tot_time) to an earlier one.  Null-safe on stepid and node.  Using all
    earlier rows equals using the accepted ones (a dropped row never raises
    the maximum, and a dropped duplicate stays dropped).  The running maximum and
    the first of equal rows go through skew-safe scans, on one exchange where no step is hot.

    ``order`` names the column of that order.  Rows marked ``unseen`` are judged by what came before them, but no row is
    judged by them.  With the ``sizes`` of steps the rows are not kept to be counted."""
    w = watcher_registry_columns(watcher).select(F.col("id").alias("watcherid"), "accuracy", "target_node")
    m = measurements.withColumn("__tot", F.col("user_sec") * 1000000 + F.col("user_usec")
                                + F.col("sys_sec") * 1000000 + F.col("sys_usec"))
    m = m.where(F.col("__tot") != 0).join(broadcast_if_small(w), "watcherid")
    chunk = chunk or scan_chunk(measurements.sparkSession)
    if sizes is None:
        m = keep_rows(m)
        sizes = key_sizes(m, ["jobid", "stepid"])
    seen = ~F.col(unseen) if unseen else F.lit(True)
    m = ordered_scan(m, ["jobid", "stepid"], [order], [("__max_prior", "max_excl", F.when(seen, F.col("accuracy")))], chunk, sizes=sizes)
    dkey = ["jobid", "stepid", "accuracy", "target_node", "__tot"]
    m = ordered_scan(m, dkey, [order], [("__equal_before", "max_excl", F.when(seen, F.lit(1)))], chunk, sizes=sizes)
    refused = F.coalesce(F.col("__max_prior") > F.col("accuracy"), F.lit(False))
    return m.where(F.col("__equal_before").isNull() & ~refused).select(*measurements.columns)


# ---- A8: sampling-interval change log -----------------------------------------------------
def interval_change_log(settings: DataFrame, literal: bool = False, chunk: int | None = None) -> DataFrame:
    """settings(start, scrape_interval, seq) in arrival order -> change log.

    Default: log when the interval differs from the latest logged one (starts
    are max(recordid) at the time, so they never go back).  ``literal=True``:
    an interval used at any time before is never logged again (reference
    quirk) - the first use of each interval.  The global order is walked with
    the bucketed scan (no single-partition window), the literal form is an
    aggregate."""
    if literal:
        first = settings.groupBy("scrape_interval").agg(F.min(F.struct("start", "seq")).alias("f"))
        return first.select(F.col("f.start").alias("start"), "scrape_interval")
    chunk = chunk or scan_chunk(settings.sparkSession)
    s = ordered_scan(settings, [], ["start", "seq"], [("__prev", "lag", "scrape_interval")], chunk)
    return s.where(~F.col("__prev").eqNullSafe(F.col("scrape_interval"))).select("start", "scrape_interval")


# ---- A9: watcher registry --------------------------------------------------------------------
def watcher_registry_columns(watcher: DataFrame) -> DataFrame:
    """Derived columns: source, accuracy, jobstep_str."""
    src = (F.when(F.col("jobid") > 0, F.lit("parent")).when(F.col("privileged") == 1, F.lit("privileged"))
           .when(F.col("target_node").isNull(), F.lit("sacct")).otherwise(F.lit("raw_readings")))
    acc = F.create_map(*[x for k, v in SOURCE_ACCURACY.items() for x in (F.lit(k), F.lit(v))])
    w = watcher.withColumn("source", src).withColumn("accuracy", F.element_at(acc, F.col("source")))
    return w.withColumn("jobstep_str", F.concat(F.coalesce(F.col("jobid").cast("string"), F.lit("")), F.lit("."),
                                                F.coalesce(F.col("stepid").cast("string"), F.lit("n"))))


def watcher_registry(registrations: DataFrame, first_lookback: int = 28 * 86400) -> DataFrame:
    """Upsert on (jobstep_str, node, accuracy), in order of arrival (``id``).

    The first id stays.  Every renewal moves ``lastfetch`` to ``prev_lastfetch``
    and sets its own; a first registration starts ``first_lookback`` seconds
    before its fetch."""
    w = watcher_registry_columns(registrations)
    keys = ["jobstep_str", "target_node", "accuracy"]
    g = w.groupBy(*keys).agg(
        F.min("id").alias("id"), F.min_by("pid", "id").alias("pid"), F.min_by("jobid", "id").alias("jobid"),
        F.min_by("stepid", "id").alias("stepid"), F.min_by("privileged", "id").alias("privileged"),
        F.min_by("source", "id").alias("source"), F.max("id").alias("__last"),
        F.max_by("lastfetch", "id").alias("lastfetch"))
    # the registration before the last one: a second bounded aggregate, not a collected list
    prev = null_safe_join(w.select(*keys, F.col("id").alias("__id"), F.col("lastfetch").alias("__lf")),
                          g.select(*keys, "__last"), keys, "inner") \
        .where(F.col("__id") < F.col("__last")).groupBy(*keys).agg(F.max_by("__lf", "__id").alias("__before"))
    out = null_safe_join(g, prev, keys, "left")
    return out.withColumn("prev_lastfetch", F.coalesce("__before", F.col("lastfetch") - first_lookback)) \
        .drop("__before", "__last")


# ---- A10: constraint validation -----------------------------------------------------------------
def _required(*columns: str) -> list[tuple[str, str, tuple[str, ...]]]:
    return [(f"{c}_not_null", f"`{c}` IS NOT NULL", (c,)) for c in columns]


# fixed values: (rule, condition, columns it reads) of each stored table
RULES: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {
    "watcher": [*_required("pid", "jobid", "privileged", "lastfetch", "prev_lastfetch"),
                ("pid_not_negative", "pid >= 0", ("pid",)), ("jobid_not_negative", "jobid >= 0", ("jobid",)),
                ("privileged_flag", "privileged IN (0, 1)", ("privileged",)),
                ("fetches_in_order", "prev_lastfetch <= lastfetch", ("prev_lastfetch", "lastfetch"))],
    "jobinfo": [*_required("jobid"), ("jobid_positive", "jobid > 0", ("jobid",)),
                ("user_xor_step", "(user IS NULL) <> (stepid IS NULL)", ("user", "stepid")),
                ("ngpu_xor_step", "(ngpu IS NULL) <> (stepid IS NULL)", ("ngpu", "stepid")),
                ("started_positive", "started_at > 0", ("started_at",)),
                ("ended_after_start", "ended_at = 0 OR ended_at >= started_at", ("ended_at", "started_at")),
                ("nnodes_positive", "nnodes > 0", ("nnodes",)), ("ncpu_positive", "ncpu > 0", ("ncpu",))],
    "measurements": [*_required("watcherid", "jobid", "user_sec", "user_usec", "sys_sec", "sys_usec"),
                     ("tot_time_positive", "user_sec * 1000000 + user_usec + sys_sec * 1000000 + sys_usec > 0",
                      ("user_sec", "user_usec", "sys_sec", "sys_usec"))],
    "gpu_measurements": [*_required("watcherid", "batch", "jobid", "pid", "gpuid", "source"),
                         ("batch_positive", "batch > 0", ("batch",)), ("sm_clock_positive", "sm_clock > 0", ("sm_clock",)),
                         ("util_not_negative", "util >= 0", ("util",))],
    "application_usage": _required("jobid", "stepid", "application"),
    "analyze_user_info": [*_required("user", "skip"), ("skip_flag", "skip IN (0, 1)", ("skip",))],
    "scrape_freq_log": [*_required("start", "scrape_interval"), ("start_positive", "start > 0", ("start",)),
                        ("interval_positive", "scrape_interval > 0", ("scrape_interval",))],
    "job_step_cpu_available": _required("watcherid", "jobid", "stepid", "ncpu"),
}


def validate(table: str, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the list of failed rules).

    A condition that is NULL holds, as a stored CHECK does; what must not be
    NULL is a rule of its own.  Rules on columns that ``df`` lacks are not
    applied."""
    rules = [(name, expr) for name, expr, columns in RULES.get(table, []) if set(columns) <= set(df.columns)]
    if not rules:
        return df, df.limit(0).withColumn("failed_rules", F.array().cast("array<string>"))
    checks = [F.when(~F.coalesce(F.expr(expr), F.lit(True)), F.lit(name)) for name, expr in rules]
    x = df.withColumn("failed_rules", F.array_compact(F.array(*checks)))
    return x.where(F.size("failed_rules") == 0).drop("failed_rules"), x.where(F.size("failed_rules") > 0)


# ---- A11 / A12 / A13 ----------------------------------------------------------------------------
def analysis_range(measurements: DataFrame, state: DataFrame, now: Column, period_seconds: int) -> DataFrame:
    """(offset_start, offset_end, commit): start = last committed offset, end =
    max(recordid); commit only when the period has expired (else the period is
    re-analysed as it grows).  ``state``: one row (analysis_offset, period_started)."""
    mx = measurements.select(F.max("recordid")).scalar()
    return state.select(
        F.col("analysis_offset").alias("offset_start"), F.coalesce(mx, F.col("analysis_offset")).alias("offset_end"),
        (now - F.col("period_started") >= period_seconds).alias("commit"))


def fetch_range(registry: DataFrame, now: Column, first_lookback: int = 28 * 86400) -> DataFrame:
    """(prev lastfetch, now]; a first fetch goes back 28 days."""
    return registry.select("id", F.coalesce(F.col("lastfetch"), now - first_lookback).alias("fetch_start"),
                           now.alias("fetch_end"))


# fixed values: job states
JOB_STATES = ["pending", "running", "suspended", "completed", "cancelled", "failed", "timeout", "node_fail",
              "preempted", "boot_fail", "deadline", "out_of_memory"]


def filter_states(jobs: DataFrame, mode: str = "import") -> DataFrame:
    """import: every state but pending; load: running only."""
    st = F.lower(F.col("state"))
    return jobs.where(st != "pending") if mode == "import" else jobs.where(st == "running")


# ---- A14 / A15 / A16 -------------------------------------------------------------------------------
def latest_global_record(measurements: DataFrame, watcher: DataFrame, beside: str | None = None,
                         sizes: DataFrame | None = None) -> DataFrame:
    """Per (job, step): the latest record id from a global (accounting) watcher, else NULL.

    With ``beside``, a column that orders the rows of a step (``sizes``: of the steps), it is given beside every row of
    the step instead; rows that have no record id yet don't count."""
    g = watcher_registry_columns(watcher).where(F.col("source") == "sacct").select(F.col("id").alias("watcherid"))
    m = measurements.join(broadcast_if_small(g.withColumn("__g", F.lit(True))), "watcherid", "left")
    if beside:
        latest = ("latest_global_recordid", "max_all", F.when(F.col("__g"), F.col("recordid")))
        return ordered_scan(m, ["jobid", "stepid"], [beside], [latest], scan_chunk(m.sparkSession), sizes=sizes).drop("__g")
    return m.groupBy("jobid", "stepid").agg(
        F.nullif(F.max(F.when(F.col("__g"), F.col("recordid")).otherwise(F.lit(-1))), F.lit(-1))
        .alias("latest_global_recordid"))


def replace_global(measurements: DataFrame, new_rows: DataFrame, watcher: DataFrame) -> DataFrame:
    """Back-fill: a new global row of a (job, step) takes the place and the record
    id of its latest global row; without one it gets the next free id, in order
    of (jobid, stepid).  ``new_rows`` has one row per (job, step) and no ids."""
    keys = ["jobid", "stepid"]
    latest = latest_global_record(measurements, watcher)
    placed = null_safe_join(new_rows.drop("recordid"), latest, keys, "left")
    kept = placed.where(F.col("latest_global_recordid").isNotNull()).withColumnRenamed("latest_global_recordid", "recordid")
    fresh = placed.where(F.col("latest_global_recordid").isNull()).drop("latest_global_recordid")
    free = measurements.select(F.coalesce(F.max("recordid"), F.lit(0)))
    # dense ids by job: a running sum over the jobs' counts, then the place within the job
    chunk = scan_chunk(measurements.sparkSession)
    sized = fresh.groupBy("jobid").agg(F.count(F.lit(1)).alias("__n"))
    before = ordered_scan(sized, [], ["jobid"], [("__before", "sum_excl", "__n")], chunk) \
        .select("jobid", F.coalesce("__before", F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("jobid").orderBy("stepid"))  # steps of one job
    fresh = fresh.join(before, "jobid").withColumn("recordid", (free.scalar() + F.col("__before") + within).cast(L)).drop("__before")
    order = measurements.columns
    return measurements.join(kept.select("recordid"), "recordid", "left_anti").select(*order) \
        .unionByName(kept.select(*order)).unionByName(fresh.select(*order))


def backfill_watcher(measurements: DataFrame, watcher: DataFrame) -> DataFrame:
    """Rows with watcherid 0 get the (one) global watcher id."""
    gid = watcher_registry_columns(watcher).where(F.col("source") == "sacct").select(F.min("id")).scalar()
    return measurements.withColumn("watcherid", F.when(F.col("watcherid") == 0, gid).otherwise(F.col("watcherid")))


SCHEMA_VERSION = 6

# fixed values: (version reached, table, columns dropped, columns added) of each step, in order
MIGRATIONS: list[tuple[int, str, list[str], list[str]]] = [
    (3, "jobinfo", [], ["ncpu", "timelimit", "ended_at"]),
    (3, "measurements", [], ["elapsed"]),
    (4, "jobinfo", ["ended_at"], ["started_at", "ended_at"]),
    (5, "measurements", ["elapsed"], []),
    (5, "jobinfo", ["node"], ["nnodes"]),
    (6, "jobinfo", [], ["peak_res_size"]),
]


def upgrade_schema(df: DataFrame, table: str, from_version: int) -> DataFrame:
    """``df`` in an older layout, brought to the current one step by step; added
    columns are NULL until they are imported anew."""
    if not 0 <= from_version <= SCHEMA_VERSION:
        raise ValueError(f"schema version {from_version} has no way to {SCHEMA_VERSION}")
    out = df
    for version, of, dropped, added in MIGRATIONS:
        if of == table and from_version < version:
            out = out.drop(*dropped)
            out = out.withColumns({c: F.lit(None).cast(L) for c in added})
    return out


def upgrade_interval_log(log: DataFrame, from_version: int, scrape_interval: int) -> DataFrame:
    """Layouts before version 5 had no interval log: it starts with the present interval at record 1."""
    if from_version >= 5:
        return log
    seed = log.sparkSession.createDataFrame([(1, scrape_interval)], "start long, scrape_interval long")
    return interval_change_log(log.select(F.col("start").cast(L), F.col("scrape_interval").cast(L))
                               .unionByName(seed).withColumn("seq", F.col("start")))
