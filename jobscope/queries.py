"""Registered queries: one per operator of the inventory, each reading the
driver's tables through :mod:`jobscope.fixtures` (or the tables directly)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope import fixtures
from jobscope.operators import reports as R
from jobscope.operators.core import Analysis, half_period
from jobscope.session import scan_chunk

Query = Callable[[SparkSession, str], DataFrame]


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every DOUBLE column to ``places`` decimals as round(x * 10^p) / 10^p
    (half away from zero on the scaled value), the same arithmetic SQL engines
    use for round(x, p) on doubles, so results are bit-identical."""
    m = float(10 ** places)
    return df.select(*[(F.round(F.col(f.name) * m) / m).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


_ANALYSES: dict[tuple, Analysis] = {}


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """The period's analysis (shared by all reports of a session, like one
    analysis run: the time series is built and materialized once)."""
    key = (*fixtures.curated_key(spark, sf_dir), scan_chunk(spark))
    if key not in _ANALYSES:
        mon = fixtures.load(spark, sf_dir)
        _ANALYSES[key] = Analysis(mon, half_period(mon.measurements), scan_chunk(spark))
    return _ANALYSES[key]


def _q(fn: Callable[[Analysis, SparkSession], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(fn(analysis(spark, sf_dir), spark))
    run.__doc__ = fn.__doc__
    return run


TS_COLS = ["recordid", "user", "jobid", "stepid", "watcherid", "target_node", "measurement_batch",
           "latest_recordid", "is_new_in_period", "ncpu", "scrape_interval", "delta_user_time", "delta_sys_time",
           "delta_res_size", "delta_res_size_from_start", "delta_res_size_from_midline", "delta_minor_pagefault"]

REGISTRY: dict[str, Query] = {
    "d01_active_users": _q(lambda a, s: a.active_users),
    "d03_recombined_jobinfo": _q(lambda a, s: a.recombined_jobinfo),
    "d04_session_batches": _q(lambda a, s: a.grouped_measurements.select(
        "recordid", "user", "jobid", "stepid", "watcherid", "latest_recordid", "measurement_batch")),
    "d08_timeseries": _q(lambda a, s: a.timeseries.select(*TS_COLS)),
    "d10_sys_ratio": _q(lambda a, s: a.sys_ratio),
    "d12_gpu_idle_segments": _q(lambda a, s: a.gpu_flagged.select(
        "batch", "pid", "jobid", "stepid", "gpuid", "util", "age", "measurement_batch", "segment_breaker",
        "zero_segment_length")),
    "d13_gpu_usage": _q(lambda a, s: a.gpu_usage),
    "d16_gpucpu_usage": _q(lambda a, s: a.gpucpu_usage),
    "d17_node_flags": _q(lambda a, s: a.node_usage.select(
        "user", "jobid", "stepid", "node", "sel_ncpu", "sel_ngpu", "node_tot_cpu", "node_tot_gpu",
        "gpu_flagged", "low_concurrency", "cpu_flagged")),
    "d18_node_usage_text": _q(lambda a, s: a.node_usage.select(
        "user", "jobid", "stepid", "node", "cpu_usage", "gpu_usage")),
    "d18_step_usage_text": _q(lambda a, s: a.step_usage),
    "d19_jupyter_steps": _q(lambda a, s: a.jupyter_steps),
    "d20_step_resource_usage": _q(lambda a, s: a.step_resource_usage),
    "d21_job_cpu_time": _q(lambda a, s: a.job_cpu_time),
    "d22_job_resource_usage": _q(lambda a, s: a.job_resource_usage),
    "e02_latest_gpu_usage": _q(lambda a, s: R.latest_gpu_usage(a)),
    "e03_gpu_usage_history": _q(lambda a, s: R.gpu_usage_history(a)),
    "e04_latest_sys_ratio": _q(lambda a, s: R.latest_sys_ratio(a)),
    "e05_problem_sys_ratio": _q(lambda a, s: R.problem_sys_ratio(a)),
    "e06_sys_ratio_history": _q(lambda a, s: R.sys_ratio_history(a)),
    "e07_resource_usage_report": _q(lambda a, s: R.resource_usage_report(a)),
    "e08_problem_listing": _q(lambda a, s: R.problem_listing(a, s)),
    "e09_problem_summary": _q(lambda a, s: R.problem_summary(a, s)),
    "e13_export_jobinfo": _q(lambda a, s: R.export_jobinfo(a)),
    "e14_export_mem": _q(lambda a, s: R.export_mem(a)),
    "e15_export_apps": _q(lambda a, s: R.export_apps(a)),
    "e16_export_problems": _q(lambda a, s: R.export_problems(a, s).select(
        "user", "Job", "Step", F.array_join(F.array_sort(F.map_keys("Problems")), ", ").alias("Problems"))),
    "e17_export_resources": _q(lambda a, s: R.export_resources(a)),
    "e18_export_gpu": _q(lambda a, s: R.export_gpu(a)),
    "e19_export_sys_ratio": _q(lambda a, s: R.export_sys_ratio(a)),
}
