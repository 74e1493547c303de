"""DuckDB oracle text per registered query (doubles rounded to 6 places)."""

from __future__ import annotations

from jobscope.operators.reports import PROBLEMS
from jobscope.oracle.analysis_sql import with_ctes


def _dict_values() -> str:
    rows = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in p) + ")" for p in PROBLEMS)
    return f"(VALUES {rows}) AS d(tag, problem, analysis, solution_type, severity)"


# A GPU row's tags, in order, those that hold joined.
GPU_TAG = """CASE WHEN zero_util_cnt < measurement_cnt THEN array_to_string(list_transform(list_filter([
    ('try_split', 4 * longest_continuous_zero_util >= measurement_cnt),
    ('investigate_usage', 10 * (zero_util_cnt + low_util_cnt) >= 9 * measurement_cnt)], lambda x: coalesce(x[2], false)), lambda x: x[1]), ' | ')
  ELSE 'completely_no_util' END"""

REPORT_CTES = f"""
e02 AS (SELECT *, {GPU_TAG} AS problem_tag FROM gpu_usage WHERE is_new_in_period),
e03 AS (
  SELECT *, {GPU_TAG} AS problem_tag FROM (
    SELECT "user", max({{'j': jobid, 's': stepid}}).j AS jobid, max({{'j': jobid, 's': stepid}}).s AS stepid,
           name, submit_line, sum(measurement_cnt)::BIGINT AS measurement_cnt,
           CAST(sum(CAST(round(avg_util * measurement_cnt) AS BIGINT)) AS DOUBLE) / sum(measurement_cnt) AS avg_util,
           sum(zero_util_cnt)::BIGINT AS zero_util_cnt, sum(low_util_cnt)::BIGINT AS low_util_cnt,
           max(longest_continuous_zero_util) AS longest_continuous_zero_util,
           CAST(sum(CAST(round(avg_clock * measurement_cnt) AS BIGINT)) AS DOUBLE) / sum(measurement_cnt) AS avg_clock,
           CAST(sum(CAST(round(avg_power_usage * measurement_cnt * 100.0) AS BIGINT)) AS DOUBLE)
             / sum(measurement_cnt) / 100.0 AS avg_power_usage
    FROM gpu_usage GROUP BY "user", name, submit_line)),
e04 AS (SELECT * FROM sys_ratio WHERE is_new_in_period),
e05 AS (SELECT *, 'sys_ratio' AS problem_tag FROM sys_ratio
        WHERE is_new_in_period AND major_ratio_unified_tot >= tot_in_batch),
e06 AS (
  SELECT *, CASE WHEN major_ratio_unified_tot >= tot_in_batch THEN 'sys_ratio' ELSE '' END AS problem_tag FROM (
    SELECT "user", max({{'j': jobid, 's': stepid}}).j AS jobid, max({{'j': jobid, 's': stepid}}).s AS stepid,
           name, submit_line, sum(tot_in_batch)::BIGINT AS tot_in_batch,
           sum(sys_ratio_1_10)::BIGINT AS sys_ratio_1_10, sum(sys_ratio_1_3)::BIGINT AS sys_ratio_1_3,
           sum(sys_ratio_2_3)::BIGINT AS sys_ratio_2_3, sum(sys_ratio_gt_1) AS sys_ratio_gt_1,
           sum(major_ratio_unified_tot) AS major_ratio_unified_tot
    FROM sys_ratio GROUP BY "user", name, submit_line HAVING bool_or(is_new_in_period))),
e07_base AS (
  SELECT *, CASE WHEN agg_peak IS NOT DISTINCT FROM peak_slurm OR stepid IS NOT NULL THEN 1 ELSE nnode END AS dv
  FROM (SELECT *, CASE WHEN stepid IS NULL THEN jobid END AS agg_jobid,
               CASE WHEN stepid IS NULL THEN max(peak_res_size) OVER w ELSE peak_res_size END AS agg_peak,
               CASE WHEN stepid IS NULL THEN max(mem_limit) OVER w ELSE mem_limit END AS agg_mem,
               CASE WHEN stepid IS NULL THEN max(peak_res_size) FILTER (WHERE is_res_size_from_slurm) OVER w
                    ELSE CAST(is_res_size_from_slurm AS BIGINT) * peak_res_size END AS peak_slurm,
               stepid IS NULL AND ncpu <= 8 AND max(ngpu) OVER w IS NOT DISTINCT FROM 0 AS low_compute_power
        FROM resource_usage WINDOW w AS (PARTITION BY "user", jobid))),
e07 AS (
  SELECT "user", jobid, agg_jobid, stepid,
         name || chr(10) || CASE WHEN nnode IS NULL THEN '' ELSE '(' || nnode || ' node'
                                 || CASE WHEN nnode > 1 THEN 's' ELSE '' END || ')' END AS name,
         printf('%.2f', coalesce(100.0::DOUBLE * agg_peak / nullif(agg_mem * dv, 0), 0)) || '% ('
           || coalesce(agg_peak // 1024 // 1024, 0) || ' / ' || coalesce(agg_mem // 1024 // 1024 // nullif(dv, 0), 0)
           || ' MB)' || chr(10) || 'source: '
           || CASE WHEN agg_peak IS NOT DISTINCT FROM peak_slurm THEN 'SLURM' ELSE 'samples' END AS mem_usage,
         timespan, cpu_usage, ngpu, gpu_usage,
         rtrim(CASE WHEN instr(problem, 'cpu_underusage') IS NOT DISTINCT FROM 0 AND low_compute_power
                    THEN 'low_compute_power | ' ELSE '' END || problem
               || CASE WHEN agg_peak < 0.75 * agg_mem THEN '| mem_underusage' ELSE '' END, '| ') AS problem_tag
  FROM e07_base),
tag_rows AS (
  SELECT "user", jobid, stepid, analysis, report,
         regexp_replace(unnest(string_split(problem_tag, '|')), '[^A-Za-z0-9_]', '', 'g') AS tag
  FROM (SELECT "user", jobid, stepid, 'GPU Usage' AS analysis, 'latest' AS report, problem_tag FROM e02
        UNION ALL SELECT "user", jobid, stepid, 'System time ratio', 'latest_problem', problem_tag FROM e05
        UNION ALL SELECT "user", jobid, stepid, 'Resource Usage', 'latest', problem_tag FROM e07)),
e08 AS (SELECT DISTINCT t."user", t.jobid, t.stepid, d.problem FROM tag_rows t JOIN {_dict_values()} ON d.tag = t.tag),
all_tag_rows AS (
  SELECT "user", analysis, report,
         regexp_replace(unnest(string_split(problem_tag, '|')), '[^A-Za-z0-9_]', '', 'g') AS tag
  FROM (SELECT "user", 'GPU Usage' AS analysis, 'latest' AS report, problem_tag FROM e02
        UNION ALL SELECT "user", 'GPU Usage', 'history', problem_tag FROM e03
        UNION ALL SELECT "user", 'System time ratio', 'latest_problem', problem_tag FROM e05
        UNION ALL SELECT "user", 'System time ratio', 'history', problem_tag FROM e06
        UNION ALL SELECT "user", 'Resource Usage', 'latest', problem_tag FROM e07)),
report_counts AS (
  SELECT "user", 'Resource Usage' AS analysis, 'latest' AS report, count(*) AS records FROM e07 GROUP BY 1
  UNION ALL SELECT "user", 'GPU Usage', 'latest', count(*) FROM e02 GROUP BY 1
  UNION ALL SELECT "user", 'GPU Usage', 'history', count(*) FROM e03 GROUP BY 1
  UNION ALL SELECT "user", 'System time ratio', 'latest_problem', count(*) FROM e05 GROUP BY 1
  UNION ALL SELECT "user", 'System time ratio', 'latest', count(*) FROM e04 GROUP BY 1
  UNION ALL SELECT "user", 'System time ratio', 'history', count(*) FROM e06 GROUP BY 1),
new_steps AS (
  SELECT "user", jobid, stepid, max(nnodes) AS nnodes, max(job_length) AS job_length, max(timelimit) AS timelimit
  FROM ts GROUP BY "user", jobid, stepid HAVING bool_or(is_new_in_period))
"""


def _r(select: str) -> str:
    return with_ctes(select, REPORT_CTES)


ORACLES: dict[str, str] = {
    "d01_active_users": _r('SELECT "user" FROM active_users'),
    "d03_recombined_jobinfo": _r("SELECT * FROM rj"),
    "d04_session_batches": _r("""SELECT s.recordid, s."user", s.jobid, s.stepid, s.watcherid, s.latest_recordid,
        CAST(b.measurement_batch AS BIGINT) AS measurement_batch
        FROM stream s JOIN batch_ranges b ON s.recordid = b.recordid"""),
    "d08_timeseries": _r("""SELECT recordid, "user", jobid, stepid, watcherid, target_node, measurement_batch,
        latest_recordid, is_new_in_period, ncpu, scrape_interval, delta_user_time, delta_sys_time, delta_res_size,
        delta_res_size_from_start, delta_res_size_from_midline, delta_minor_pagefault FROM ts"""),
    "d10_sys_ratio": _r("""SELECT "user", jobid, stepid, name, submit_line, is_new_in_period, measurement_batch,
        tot_in_batch, sys_ratio_1_10, sys_ratio_1_3, sys_ratio_2_3, round(sys_ratio_gt_1, 6) AS sys_ratio_gt_1,
        round(major_ratio_unified_tot, 6) AS major_ratio_unified_tot FROM sys_ratio"""),
    "d12_gpu_idle_segments": _r("""SELECT batch, pid, jobid, stepid, gpuid, util, age, measurement_batch,
        CAST(CASE WHEN util <> 0 OR lead(util) OVER (PARTITION BY jobid, stepid, gpuid ORDER BY place) IS NULL
             THEN -(count(*) FILTER (WHERE util = 0) OVER (PARTITION BY jobid, stepid, gpuid ORDER BY place
                                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
             ELSE 0 END AS BIGINT) AS segment_breaker, CAST(zero_segment_length AS BIGINT) AS zero_segment_length
        FROM gf3"""),
    "d13_gpu_usage": _r("""SELECT "user", jobid, stepid, is_new_in_period, name, target_node, gpuid_raw, gpuid,
        submit_line, measurement_cnt, round(avg_util, 6) AS avg_util, zero_util_cnt, low_util_cnt,
        longest_continuous_zero_util, round(avg_clock, 6) AS avg_clock, round(avg_power_usage, 6) AS avg_power_usage,
        round(avg_temperature, 6) AS avg_temperature FROM gpu_usage"""),
    "d16_gpucpu_usage": _r("SELECT * FROM gpucpu_usage"),
    "d17_node_flags": _r("""SELECT "user", jobid, stepid, node, sel_ncpu, sel_ngpu, node_tot_cpu, node_tot_gpu,
        gpu_flagged, low_concurrency, cpu_flagged FROM node_usage"""),
    "d18_node_usage_text": _r('SELECT "user", jobid, stepid, node, cpu_usage, gpu_usage FROM node_usage'),
    "d18_step_usage_text": _r("""SELECT "user", jobid, stepid, nnode, gpu_flagged, cpu_flagged, low_concurrency,
        gpu_usage, cpu_usage FROM step_usage"""),
    "d19_jupyter_steps": _r("SELECT * FROM jupyter"),
    "d20_step_resource_usage": _r("SELECT * FROM step_resource"),
    "d21_job_cpu_time": _r("SELECT jobid, CAST(tot_time AS BIGINT) AS tot_time FROM job_tot"),
    "d22_job_resource_usage": _r("SELECT * FROM job_resource"),
    "e02_latest_gpu_usage": _r("""SELECT "user", jobid, stepid, is_new_in_period, name, target_node, gpuid_raw, gpuid,
        submit_line, measurement_cnt, round(avg_util, 6) AS avg_util, zero_util_cnt, low_util_cnt,
        longest_continuous_zero_util, round(avg_clock, 6) AS avg_clock, round(avg_power_usage, 6) AS avg_power_usage,
        round(avg_temperature, 6) AS avg_temperature, problem_tag FROM e02"""),
    "e03_gpu_usage_history": _r("""SELECT "user", jobid, stepid, name, submit_line, measurement_cnt,
        round(avg_util, 6) AS avg_util, zero_util_cnt, low_util_cnt, longest_continuous_zero_util,
        round(avg_clock, 6) AS avg_clock, round(avg_power_usage, 6) AS avg_power_usage, problem_tag FROM e03"""),
    "e04_latest_sys_ratio": _r("""SELECT "user", jobid, stepid, name, submit_line, is_new_in_period, measurement_batch,
        tot_in_batch, sys_ratio_1_10, sys_ratio_1_3, sys_ratio_2_3, round(sys_ratio_gt_1, 6) AS sys_ratio_gt_1,
        round(major_ratio_unified_tot, 6) AS major_ratio_unified_tot FROM e04"""),
    "e05_problem_sys_ratio": _r("""SELECT "user", jobid, stepid, name, submit_line, is_new_in_period, measurement_batch,
        tot_in_batch, sys_ratio_1_10, sys_ratio_1_3, sys_ratio_2_3, round(sys_ratio_gt_1, 6) AS sys_ratio_gt_1,
        round(major_ratio_unified_tot, 6) AS major_ratio_unified_tot, problem_tag FROM e05"""),
    "e06_sys_ratio_history": _r("""SELECT "user", jobid, stepid, name, submit_line, tot_in_batch, sys_ratio_1_10,
        sys_ratio_1_3, sys_ratio_2_3, round(sys_ratio_gt_1, 6) AS sys_ratio_gt_1,
        round(major_ratio_unified_tot, 6) AS major_ratio_unified_tot, problem_tag FROM e06"""),
    "e07_resource_usage_report": _r("""SELECT "user", jobid, agg_jobid, stepid, name, mem_usage, timespan, cpu_usage,
        ngpu, gpu_usage, problem_tag FROM e07"""),
    "e08_problem_listing": _r("SELECT * FROM e08"),
    "e09_problem_summary": _r(f"""SELECT a."user", a.analysis, a.report, a.problem, a.solution_type, a.severity,
        a.entries, c.records
        FROM (SELECT t."user", t.analysis, t.report, d.problem, d.solution_type, d.severity, count(*) AS entries
              FROM all_tag_rows t JOIN {_dict_values()} ON d.tag = t.tag GROUP BY ALL) a
        JOIN report_counts c ON c."user" = a."user" AND c.analysis = a.analysis AND c.report = a.report"""),
    "e13_export_jobinfo": _r("""SELECT n."user", n.jobid AS "Job", j.name AS "Name", n.nnodes AS "NodeCnt",
        n.job_length AS "JobLength", n.timelimit AS "TimeLimit"
        FROM new_steps n LEFT JOIN jobinfo j ON j.jobid = n.jobid AND j.stepid IS NULL"""),
    "e14_export_mem": _r("""SELECT "user", jobid AS "Job", stepid AS "Step", peak_res_size AS "PeakRssSize",
        mem_limit AS "MemLimit" FROM resource_usage"""),
    "e15_export_apps": _r("""SELECT n."user", a.jobid AS "Job", a.stepid AS "Step", a.application AS "App"
        FROM application_usage a JOIN new_steps n ON n.jobid = a.jobid AND n.stepid = a.stepid"""),
    "e16_export_problems": _r("""SELECT "user", jobid AS "Job", stepid AS "Step",
        string_agg(problem, ', ' ORDER BY problem) AS "Problems" FROM e08 GROUP BY ALL"""),
    "e17_export_resources": _r("""SELECT "user", jobid AS "Job", stepid AS "Step", node AS "Node",
        round(CAST(coalesce(cnt_cpu, cnt_gpu) AS DOUBLE) / node_tot, 6) AS "GPUCPUEntryRatio",
        node_tot AS "TotGPUCPUSamples", CASE WHEN ncpu IS NULL THEN 'GPU' ELSE 'CPU' END AS "GPUCPUEntryType",
        ncpu AS "AllocCPU", ngpu AS "AllocGPU", ncpu_in_use AS "CPUInUse", ngpu_in_use AS "GPUInUse"
        FROM gpucpu_usage WHERE ngpu IS DISTINCT FROM 0 AND coalesce(ncpu_in_use, ngpu_in_use) IS NOT NULL"""),
    "e18_export_gpu": _r("""SELECT "user", jobid AS "Job", stepid AS "Step", target_node AS "Node", gpuid_raw AS "GPUID",
        round(avg_util, 6) AS "AvgGPUUtil", measurement_cnt AS "TotGPUSamples", zero_util_cnt AS "CntZeroGPUUtil",
        low_util_cnt AS "CntLowGPUUtil", longest_continuous_zero_util AS "LongestNoGPUUtil",
        round(avg_clock, 6) AS "AvgGPUClockMHz", round(avg_power_usage, 6) AS "AvgGPUPowerUsageWatt",
        round(avg_temperature, 6) AS "AvgGPUTempC" FROM gpu_usage WHERE is_new_in_period"""),
    "e19_export_sys_ratio": _r("""SELECT "user", jobid AS "Job", stepid AS "Step", tot_in_batch AS "TotSysTimeRatioSamples",
        sys_ratio_1_10 AS "10%~33%", sys_ratio_1_3 AS "33%~66%", sys_ratio_2_3 AS "66%~100%",
        round(sys_ratio_gt_1, 6) AS ">100%" FROM sys_ratio WHERE is_new_in_period"""),
}
