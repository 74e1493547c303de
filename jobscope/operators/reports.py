"""Reports (E1-E20): problem tags, latest / history reports, problem listing,
summaries and the per-user export sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions.text import idiv, pct2, rtrim_chars
from jobscope.operators.core import Analysis
from jobscope.plans.joins import broadcast_if_small

# ---- E11: problem dictionary --------------------------------------------
# fixed values: tag, display name, analysis, solution class, severity
PROBLEMS = [
    ("jupyter", "Jupyter Detected", "Resource Usage", "other", "medium"),
    ("low_compute_power", "Low Compute Power", "Resource Usage", "code_change_or_allocation_param", "serious"),
    ("low_concurrency", "Low Concurrency", "Resource Usage", "code_change_or_allocation_param", "serious"),
    ("oversubscribe", "Memory Oversubscribe", "Resource Usage", "code_change_or_allocation_param", "medium"),
    ("gpu_underusage", "GPU Underusage", "Resource Usage", "code_change_or_allocation_param", "serious"),
    ("cpu_underusage", "CPU Underusage", "Resource Usage", "code_change_or_allocation_param", "serious"),
    ("mem_underusage", "Memory Underusage", "Resource Usage", "code_change_or_allocation_param", "medium"),
    ("timelimit_underusage", "Time Limit Underusage", "Resource Usage", "code_change_or_allocation_param", "info"),
    ("sys_ratio", "System Time Ratio", "System time ratio", "need_profiling", "info"),
    ("completely_no_util", "Completely No Util", "GPU Usage", "code_change_or_allocation_param", "serious"),
    ("try_split", "Try Splitting", "GPU Usage", "suggest_consultation", "info"),
    ("investigate_usage", "Investigate GPU Usage", "GPU Usage", "suggest_consultation", "medium"),
]
PROBLEM_SCHEMA = "tag string, problem string, analysis string, solution_type string, severity string"


def problem_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROBLEMS, PROBLEM_SCHEMA)


# ---- E1 -------------------------------------------------------------------
def gpu_problem_tag(df: DataFrame) -> Column:
    cnt, zero = F.col("measurement_cnt"), F.col("zero_util_cnt")
    rest = rtrim_chars(F.concat(
        F.when(F.col("longest_continuous_zero_util") >= cnt * 0.25, F.lit("try_split | ")).otherwise(F.lit("")),
        F.when(F.col("low_util_cnt") + zero >= cnt * 0.9, F.lit("investigate_usage")).otherwise(F.lit(""))),
        "| ")
    return F.when(zero == cnt, F.lit("completely_no_util")).otherwise(rest)


# ---- E2 / E3 --------------------------------------------------------------
def latest_gpu_usage(a: Analysis, ordered: bool = True) -> DataFrame:
    gu = a.gpu_usage.where(F.col("is_new_in_period"))
    out = gu.withColumn("problem_tag", gpu_problem_tag(gu))
    return out.orderBy("user", F.length("problem_tag").desc(), "name", "jobid", "stepid", "target_node",
                       "gpuid_raw") if ordered else out


def _rep(agg_jobid="jobid", agg_stepid="stepid") -> Column:
    return F.max(F.struct(F.col(agg_jobid).alias("j"), F.col(agg_stepid).alias("s")))


def gpu_usage_history(a: Analysis, ordered: bool = True) -> DataFrame:
    gu = a.gpu_usage
    n = F.col("measurement_cnt")

    def w(c: str, scale: float = 1.0) -> Column:
        # count-weighted mean: avg * n is the (integer) sum of the readings, recovered
        # exactly with round(), so the result does not depend on summation order
        tot = F.sum(F.round(F.col(c) * n * scale).cast("bigint"))
        return F.try_divide(tot.cast("double"), F.sum(n).cast("double")) / scale
    g = gu.groupBy("user", "name", "submit_line").agg(
        _rep().alias("rep"),
        F.sum(n).alias("measurement_cnt"), w("avg_util").alias("avg_util"),
        F.sum("zero_util_cnt").alias("zero_util_cnt"), F.sum("low_util_cnt").alias("low_util_cnt"),
        F.max("longest_continuous_zero_util").alias("longest_continuous_zero_util"),
        w("avg_clock").alias("avg_clock"), w("avg_power_usage", 100.0).alias("avg_power_usage"))
    g = g.select("user", F.col("rep.j").alias("jobid"), F.col("rep.s").alias("stepid"), "name", "submit_line",
                 "measurement_cnt", "avg_util", "zero_util_cnt", "low_util_cnt", "longest_continuous_zero_util",
                 "avg_clock", "avg_power_usage")
    out = g.withColumn("problem_tag", gpu_problem_tag(g))
    return out.orderBy("user", F.length("problem_tag").desc(), "name", "submit_line") if ordered else out


# ---- E4 / E5 / E6 -----------------------------------------------------------
def latest_sys_ratio(a: Analysis, ordered: bool = True) -> DataFrame:
    out = a.sys_ratio.where(F.col("is_new_in_period"))
    return out.orderBy("user", "name", "jobid", "stepid", "measurement_batch") if ordered else out


def problem_sys_ratio(a: Analysis, ordered: bool = True) -> DataFrame:
    sr = a.sys_ratio
    out = sr.where(F.col("is_new_in_period") & (F.col("major_ratio_unified_tot") >= F.col("tot_in_batch"))) \
            .withColumn("problem_tag", F.lit("sys_ratio"))
    return out.orderBy("user", "name", "jobid", "stepid", "measurement_batch") if ordered else out


def sys_ratio_history(a: Analysis, ordered: bool = True) -> DataFrame:
    sr = a.sys_ratio
    g = sr.groupBy("user", "name", "submit_line").agg(
        _rep().alias("rep"), F.max("is_new_in_period").alias("any_new"),
        *[F.sum(c).alias(c) for c in ("tot_in_batch", "sys_ratio_1_10", "sys_ratio_1_3", "sys_ratio_2_3",
                                      "sys_ratio_gt_1", "major_ratio_unified_tot")])
    g = g.where(F.col("any_new")).select(
        "user", F.col("rep.j").alias("jobid"), F.col("rep.s").alias("stepid"), "name", "submit_line",
        "tot_in_batch", "sys_ratio_1_10", "sys_ratio_1_3", "sys_ratio_2_3", "sys_ratio_gt_1",
        "major_ratio_unified_tot",
        F.when(F.col("major_ratio_unified_tot") >= F.col("tot_in_batch"), F.lit("sys_ratio"))
         .otherwise(F.lit("")).alias("problem_tag"))
    if not ordered:
        return g
    return g.orderBy("user", F.col("problem_tag").desc(),
                     F.try_divide(F.col("major_ratio_unified_tot"), F.col("tot_in_batch").cast("double")),
                     "name", "submit_line")


# ---- E7 ---------------------------------------------------------------------
def resource_usage_report(a: Analysis, literal_mem_divisor: bool = False, ordered: bool = True) -> DataFrame:
    ru = a.resource_usage
    job = ru.groupBy("user", "jobid").agg(
        F.max("peak_res_size").alias("job_peak"), F.max("mem_limit").alias("job_mem"),
        F.max(F.when(F.col("is_res_size_from_slurm"), F.col("peak_res_size"))).alias("job_peak_slurm"),
        F.max("ngpu").alias("job_ngpu"))
    x = ru.join(job, ["user", "jobid"])
    is_job = F.col("stepid").isNull()
    agg_peak = F.when(is_job, F.col("job_peak")).otherwise(F.col("peak_res_size"))
    agg_mem = F.when(is_job, F.col("job_mem")).otherwise(F.col("mem_limit"))
    peak_slurm = F.when(is_job, F.col("job_peak_slurm")).otherwise(
        F.col("is_res_size_from_slurm").cast("bigint") * F.col("peak_res_size"))
    low_cp = is_job & (F.col("ncpu") <= 8) & F.col("job_ngpu").eqNullSafe(F.lit(0))
    x = x.select("*", agg_peak.alias("agg_peak"), agg_mem.alias("agg_mem"), peak_slurm.alias("peak_slurm"),
                 low_cp.alias("low_compute_power"))
    same = F.col("agg_peak").eqNullSafe(F.col("peak_slurm"))
    lhs = F.col("peak_res_size") if literal_mem_divisor else F.col("agg_peak")
    div = F.when(lhs.eqNullSafe(F.col("peak_slurm")) | F.col("stepid").isNotNull(), F.lit(1)) \
           .otherwise(F.col("nnode"))
    div = F.when(div != 0, div)
    mb = lambda c: F.coalesce(idiv(idiv(c, F.lit(1024)), F.lit(1024)), F.lit(0))
    mem_text = F.concat(
        F.coalesce(pct2(F.col("agg_peak"), F.col("agg_mem") * div), F.lit("0.00")), F.lit("% ("),
        mb(F.col("agg_peak")).cast("string"), F.lit(" / "),
        F.coalesce(idiv(idiv(idiv(F.col("agg_mem"), F.lit(1024)), F.lit(1024)), div), F.lit(0)).cast("string"),
        F.lit(" MB)\nsource: "), F.when(same, F.lit("SLURM")).otherwise(F.lit("samples")))
    name = F.concat(F.col("name"), F.lit("\n"), F.when(F.col("nnode").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("("), F.col("nnode").cast("string"), F.lit(" node"),
                 F.when(F.col("nnode") > 1, F.lit("s")).otherwise(F.lit("")), F.lit(")"))))
    tag = rtrim_chars(F.concat(
        F.when(F.instr(F.col("problem"), "cpu_underusage").eqNullSafe(F.lit(0))
               & F.coalesce(F.col("low_compute_power"), F.lit(False)), F.lit("low_compute_power | "))
         .otherwise(F.lit("")),
        F.col("problem"),
        F.when(F.col("agg_peak") < F.col("agg_mem") * 0.75, F.lit("| mem_underusage")).otherwise(F.lit(""))),
        "| ")
    out = x.select(
        "user", "jobid", F.when(is_job, F.col("jobid")).alias("agg_jobid"), "stepid", name.alias("name"),
        mem_text.alias("mem_usage"), "timespan", "cpu_usage", "ngpu", "gpu_usage", tag.alias("problem_tag"))
    return out.orderBy("user", "jobid", F.col("stepid").asc_nulls_first()) if ordered else out


# ---- E8 / E9 ------------------------------------------------------------------
def split_tags(col: Column) -> Column:
    """Tag tokens of a problem text: parts between '|', letters/digits/_ only."""
    parts = F.transform(F.split(col, r"\|"), lambda x: F.regexp_replace(x, "[^A-Za-z0-9_]", ""))
    return F.filter(parts, lambda x: x != "")


def _tagged_reports(a: Analysis) -> list[tuple[str, str, DataFrame]]:
    return [
        ("GPU Usage", "latest", latest_gpu_usage(a, ordered=False)),
        ("System time ratio", "latest_problem", problem_sys_ratio(a, ordered=False)),
        ("Resource Usage", "latest", resource_usage_report(a, ordered=False)),
    ]


def _tags_of(reports: list[tuple[str, str, DataFrame]]) -> DataFrame:
    parts = [df.select("user", "jobid", "stepid", F.lit(an).alias("analysis"), F.lit(rep).alias("report"),
                       F.explode(split_tags(F.col("problem_tag"))).alias("tag"))
             for an, rep, df in reports]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def problem_listing(a: Analysis, spark: SparkSession) -> DataFrame:
    """(user, jobid, stepid, problem) of latest reports; problem = display name."""
    if getattr(a, "_problem_listing", None) is not None:
        return a._problem_listing
    a._problem_listing = a._keep(_problem_listing(a, spark), "problem_listing")
    return a._problem_listing


def _problem_listing(a: Analysis, spark: SparkSession) -> DataFrame:
    tags = _tags_of(_tagged_reports(a))
    d = broadcast_if_small(problem_dictionary(spark).select("tag", "problem"))
    return tags.join(d, "tag").select("user", "jobid", "stepid", "problem") \
               .dropDuplicates(["user", "jobid", "stepid", "problem"])


def unknown_problems(a: Analysis, spark: SparkSession) -> DataFrame:
    tags = _tags_of(_tagged_reports(a))
    d = broadcast_if_small(problem_dictionary(spark).select("tag"))
    return tags.join(d, "tag", "left_anti").select("user", "jobid", "stepid", "analysis", "report", "tag")


def all_reports(a: Analysis, ordered: bool = False) -> list[tuple[str, str, DataFrame]]:
    """The report registry in run order (analysis, report, frame)."""
    return [
        ("Resource Usage", "latest", resource_usage_report(a, ordered=ordered)),
        ("GPU Usage", "latest", latest_gpu_usage(a, ordered=ordered)),
        ("GPU Usage", "history", gpu_usage_history(a, ordered=ordered)),
        ("System time ratio", "latest_problem", problem_sys_ratio(a, ordered=ordered)),
        ("System time ratio", "latest", latest_sys_ratio(a, ordered=ordered)),
        ("System time ratio", "history", sys_ratio_history(a, ordered=ordered)),
    ]


def problem_summary(a: Analysis, spark: SparkSession) -> DataFrame:
    """Per user and report, the number of records and of entries per problem."""
    reps = all_reports(a)
    counts = None
    for an, rep, df in reps:
        c = df.groupBy("user").agg(F.count(F.lit(1)).alias("records")) \
              .select("user", F.lit(an).alias("analysis"), F.lit(rep).alias("report"), "records")
        counts = c if counts is None else counts.unionByName(c)
    tagged = [(an, rep, df) for an, rep, df in reps if "problem_tag" in df.columns]
    tags = _tags_of(tagged)
    d = broadcast_if_small(problem_dictionary(spark))
    per = tags.join(d.select("tag", "problem", "solution_type", "severity"), "tag") \
              .groupBy("user", "analysis", "report", "problem", "solution_type", "severity") \
              .agg(F.count(F.lit(1)).alias("entries"))
    return per.join(counts, ["user", "analysis", "report"])


# ---- E10 --------------------------------------------------------------------
# fixed values: of each report, the column of totals and the counts shown as shares of it
PERCENTAGES = {
    "sys_ratio": ("tot_in_batch", ["sys_ratio_1_10", "sys_ratio_1_3", "sys_ratio_2_3", "sys_ratio_gt_1"]),
    "gpu_usage": ("measurement_cnt", ["zero_util_cnt", "low_util_cnt", "longest_continuous_zero_util"]),
}


def with_percentages(df: DataFrame, total: str, flagged: list[str], suffix: str = "_pct") -> DataFrame:
    """flagged metric / row total * 100, NULL when the total is 0 or NULL."""
    return df.select("*", *[(F.try_divide(F.col(c).cast("double"), F.col(total).cast("double")) * 100)
                            .alias(c + suffix) for c in flagged])


# ---- E13 - E19: export sections ------------------------------------------------
def new_steps(a: Analysis) -> DataFrame:
    if getattr(a, "_new_steps", None) is None:
        steps = a.timeseries.groupBy("user", "jobid", "stepid").agg(
            F.max("is_new_in_period").alias("is_new"), F.max("nnodes").alias("nnodes"),
            F.max("job_length").alias("job_length"), F.max("timelimit").alias("timelimit"))
        a._new_steps = a._keep(steps.where(F.col("is_new")), "new_steps")
    return a._new_steps


def export_jobinfo(a: Analysis) -> DataFrame:
    ns = new_steps(a)
    jobs = a.mon.jobinfo.where(F.col("stepid").isNull()).select("jobid", F.col("name").alias("Name"))
    return ns.join(jobs, "jobid", "left").select(
        "user", F.col("jobid").alias("Job"), "Name", F.col("nnodes").alias("NodeCnt"),
        F.col("job_length").alias("JobLength"), F.col("timelimit").alias("TimeLimit"))


def export_mem(a: Analysis) -> DataFrame:
    return a.resource_usage.select("user", F.col("jobid").alias("Job"), F.col("stepid").alias("Step"),
                                   F.col("peak_res_size").alias("PeakRssSize"), F.col("mem_limit").alias("MemLimit"))


def export_apps(a: Analysis) -> DataFrame:
    ns = new_steps(a).select("user", "jobid", "stepid")
    return a.mon.application_usage.join(ns, ["jobid", "stepid"]).select(
        "user", F.col("jobid").alias("Job"), F.col("stepid").alias("Step"), F.col("application").alias("App"))


def export_problems(a: Analysis, spark: SparkSession) -> DataFrame:
    pl = problem_listing(a, spark)
    # at most one entry per dictionary problem per (job, step)
    return pl.groupBy("user", "jobid", "stepid").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("problem"), F.lit(1))))).alias("Problems")) \
        .select("user", F.col("jobid").alias("Job"), F.col("stepid").alias("Step"), "Problems")


def export_resources(a: Analysis) -> DataFrame:
    u = a.gpucpu_usage.where(~F.col("ngpu").eqNullSafe(F.lit(0))
                             & F.coalesce(F.col("ncpu_in_use"), F.col("ngpu_in_use")).isNotNull())
    return u.select(
        "user", F.col("jobid").alias("Job"), F.col("stepid").alias("Step"), F.col("node").alias("Node"),
        F.try_divide(F.coalesce(F.col("cnt_cpu"), F.col("cnt_gpu")).cast("double"),
                     F.col("node_tot").cast("double")).alias("GPUCPUEntryRatio"),
        F.col("node_tot").alias("TotGPUCPUSamples"),
        F.when(F.col("ncpu").isNull(), F.lit("GPU")).otherwise(F.lit("CPU")).alias("GPUCPUEntryType"),
        F.col("ncpu").alias("AllocCPU"), F.col("ngpu").alias("AllocGPU"),
        F.col("ncpu_in_use").alias("CPUInUse"), F.col("ngpu_in_use").alias("GPUInUse"))


def export_gpu(a: Analysis) -> DataFrame:
    g = a.gpu_usage.where(F.col("is_new_in_period"))
    return g.select(
        "user", F.col("jobid").alias("Job"), F.col("stepid").alias("Step"), F.col("target_node").alias("Node"),
        F.col("gpuid_raw").alias("GPUID"), F.col("avg_util").alias("AvgGPUUtil"),
        F.col("measurement_cnt").alias("TotGPUSamples"), F.col("zero_util_cnt").alias("CntZeroGPUUtil"),
        F.col("low_util_cnt").alias("CntLowGPUUtil"), F.col("longest_continuous_zero_util").alias("LongestNoGPUUtil"),
        F.col("avg_clock").alias("AvgGPUClockMHz"), F.col("avg_power_usage").alias("AvgGPUPowerUsageWatt"),
        F.col("avg_temperature").alias("AvgGPUTempC"))


def export_sys_ratio(a: Analysis) -> DataFrame:
    s = a.sys_ratio.where(F.col("is_new_in_period"))
    return s.select(
        "user", F.col("jobid").alias("Job"), F.col("stepid").alias("Step"),
        F.col("tot_in_batch").alias("TotSysTimeRatioSamples"), F.col("sys_ratio_1_10").alias("10%~33%"),
        F.col("sys_ratio_1_3").alias("33%~66%"), F.col("sys_ratio_2_3").alias("66%~100%"),
        F.col("sys_ratio_gt_1").alias(">100%"))


SECTIONS: dict[str, Callable] = {
    "JobInfo": lambda a, s: export_jobinfo(a),
    "Problems": lambda a, s: export_problems(a, s),
    "MemUsage": lambda a, s: export_mem(a),
    "Resources": lambda a, s: export_resources(a),
    "GPU": lambda a, s: export_gpu(a),
    "AppUsage": lambda a, s: export_apps(a),
    "SysTimeRatio": lambda a, s: export_sys_ratio(a),
}


# ---- E20 --------------------------------------------------------------------
def export_user_documents(a: Analysis, spark: SparkSession) -> DataFrame:
    """Per-user documents of the seven sections: ``user, section, entry``, one JSON
    entry a row however many a user has (:func:`jobscope.sources.publish.write_documents`
    lays them out as a folder a user and section).  A user without entries has one
    row with an empty document and no section."""
    entries = None
    for name, fn in SECTIONS.items():
        sec = fn(a, spark)
        fields = [c for c in sec.columns if c != "user"]
        if name == "Problems":
            entry = F.to_json(F.map_concat(F.create_map(F.lit("Job"), F.col("Job"), F.lit("Step"), F.col("Step")),
                                           F.transform_values(F.col("Problems"), lambda k, v: v.cast("bigint"))))
        else:
            entry = F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields]), {"ignoreNullFields": "false"})
        e = sec.select("user", F.lit(name).alias("section"), entry.alias("entry"))
        entries = e if entries is None else entries.unionByName(e)
    empty = a.active_users.join(entries.select("user").distinct(), "user", "left_anti") \
        .select("user", F.lit(None).cast("string").alias("section"), F.lit("{}").alias("entry"))
    return entries.unionByName(empty)


def document_fields(documents: DataFrame) -> DataFrame:
    """Entries as fields: ``..., job, step, field, value``; numbers as whole millionths, NULL fields left out."""
    rest = [c for c in documents.columns if c != "entry"]
    m = documents.select(*rest, F.from_json("entry", "map<string,string>").alias("m"))
    whole = lambda k: F.try_element_at("m", F.lit(k)).cast("bigint")
    x = m.select(*rest, whole("Job").alias("job"), whole("Step").alias("step"),
                 F.explode_outer(F.map_filter("m", lambda k, v: ~k.isin("Job", "Step") & v.isNotNull())).alias("field", "v"))
    number = F.col("v").try_cast("double")
    return x.select(*rest, "job", "step", "field", F.coalesce(
        F.floor(number * 1000000 + 0.5).cast("string"), F.col("v")).alias("value"))
