"""DuckDB oracles for the ingest, decoder, snapshot, publication and stream
queries, written directly over the driver's tables."""

from __future__ import annotations

from jobscope.oracle.analysis_sql import slurm_sql, with_ctes
from jobscope.oracle.fixtures_sql import FIXTURE_CTES
from jobscope.oracle.queries_sql import REPORT_CTES

LI = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
            l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS step_id
          FROM lineitem)"""

GATE = """wa AS (SELECT id, CASE WHEN jobid > 0 THEN 3 WHEN privileged = 1 THEN 2 WHEN target_node IS NULL THEN 1
                            ELSE 0 END AS accuracy, target_node FROM watcher),
gm AS (SELECT * FROM (SELECT m.*, wa.accuracy, wa.target_node,
                             user_sec * 1000000 + user_usec + sys_sec * 1000000 + sys_usec AS tt
                      FROM measurements m JOIN wa ON m.watcherid = wa.id) WHERE tt <> 0),
gx AS (SELECT *, max(accuracy) OVER (PARTITION BY jobid, stepid ORDER BY recordid
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mp,
              row_number() OVER (PARTITION BY jobid, stepid, accuracy, target_node, tt ORDER BY recordid) AS rn
       FROM gm),
gate AS (SELECT recordid, watcherid, jobid, stepid FROM gx WHERE coalesce(mp <= accuracy, true) AND rn = 1)"""

PROCS = """p AS (SELECT event_id AS pid, event_id // 3 AS ppid, event_type AS comm,
                  CAST(floor(value * 10) AS BIGINT) AS utime, CAST(floor(value * 3) AS BIGINT) AS stime,
                  event_id % 7 AS cutime, event_id % 5 AS cstime, event_id % 100 AS minflt, event_id % 11 AS cminflt,
                  CAST(floor(value * 1000) AS BIGINT) * 4096 AS rss, event_id * 10 AS rchar, event_id % 1000 AS wchar,
                  event_type <> 'error' AS alive, event_type = 'signup' AS is_root, user_id AS jobid,
                  event_id % 3 AS stepid FROM events),
walk(pid, root) AS (
  SELECT pid, pid FROM p WHERE is_root
  UNION ALL
  SELECT c.pid, w.root FROM walk w JOIN p par ON par.pid = w.pid
  JOIN p c ON c.ppid = w.pid AND c.pid <> c.ppid
  WHERE par.alive AND NOT c.is_root)"""

NODE_LOAD = """running AS (SELECT * FROM orders WHERE o_orderstatus = 'O'),
step_nodes AS (
  SELECT 'node' || lpad(CAST(i AS VARCHAR), 2, '0') AS node
  FROM running JOIN lineitem ON l_orderkey = o_orderkey,
       LATERAL generate_series(l_suppkey % 40, l_suppkey % 40 + l_linenumber % 3) t(i)
  UNION ALL
  SELECT 'node' || lpad(CAST(i AS VARCHAR), 2, '0')
  FROM running, LATERAL generate_series(o_custkey % 40, o_custkey % 40 + o_orderkey % 3) t(i)
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
  UNION ALL
  SELECT 'login' || CAST(o_orderkey % 2 AS VARCHAR) FROM running
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)),
load AS (SELECT node, count(*) AS cnt, true AS node_count_ok FROM step_nodes GROUP BY node),
parts AS (SELECT 'p' || CAST(s_suppkey AS VARCHAR) AS name, 'node' || lpad(CAST(i AS VARCHAR), 2, '0') AS node,
                 s_suppkey % 5 * 2 AS max_nodes, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_suppkey % 7 * 60 END AS max_time
          FROM supplier, LATERAL generate_series(s_suppkey % 40, s_suppkey % 40 + s_suppkey % 4) t(i)),
node_part AS (
  SELECT node, name AS partition FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY CASE WHEN max_nodes = 0 THEN 0 ELSE 1 END,
                                 -max_nodes, max_time IS NULL, max_time, name) AS rn FROM parts) WHERE rn = 1)"""

CLOCK = """CASE WHEN m = 0 THEN '-' ELSE concat_ws(',',
  CASE WHEN m & 1 <> 0 THEN 'app' END, CASE WHEN m & 2 <> 0 THEN 'idle' END,
  CASE WHEN m & 4 <> 0 THEN 'external_power_limit' END, CASE WHEN m & 8 <> 0 THEN 'hardware' END,
  CASE WHEN m & 16 <> 0 THEN 'software' END, CASE WHEN m & 32 <> 0 THEN 'sync' END,
  CASE WHEN m & 64 <> 0 THEN 'temp' END, CASE WHEN m & 4096 <> 0 THEN 'other' END) END"""


def _flat_sql() -> str:
    from jobscope.operators.olap import PROBLEM_NAMES
    probs = ", ".join(f'CASE WHEN list_contains(probs, \'{p}\') THEN 100 END AS "{p}"' for p in PROBLEM_NAMES)
    fill = ",\n".join(
        f'CAST(CASE WHEN "Source" = \'Problems\' AND "{p}" IS NULL AND bool_or("{p}" IS NOT NULL) FILTER '
        f'(WHERE "Source" = \'Problems\') OVER (PARTITION BY "Period", job_level) THEN 0 ELSE "{p}" END AS BIGINT) AS "{p}"'
        for p in PROBLEM_NAMES)
    return f"""
names AS (SELECT "user", jobid AS "Job", max(name) AS nm FROM (
            SELECT n."user", n.jobid, j.name FROM new_steps n LEFT JOIN jobinfo j ON j.jobid = n.jobid AND j.stepid IS NULL)
          GROUP BY ALL),
sec AS (
  SELECT 'JobInfo' AS "Source", n."user", n.jobid AS "Job", NULL::BIGINT AS "Step", j.name AS "Name",
         n.nnodes AS "NodeCnt", n.job_length AS "JobLength", n.timelimit AS "TimeLimit"
  FROM new_steps n LEFT JOIN jobinfo j ON j.jobid = n.jobid AND j.stepid IS NULL
  UNION ALL BY NAME
  SELECT 'MemUsage' AS "Source", "user", jobid AS "Job", stepid AS "Step", peak_res_size AS "PeakRssSize",
         mem_limit AS "MemLimit" FROM resource_usage
  UNION ALL BY NAME
  SELECT 'AppUsage' AS "Source", n."user", a.jobid AS "Job", a.stepid AS "Step", a.application AS "App"
  FROM application_usage a JOIN new_steps n ON n.jobid = a.jobid AND n.stepid = a.stepid
  UNION ALL BY NAME
  SELECT 'Problems' AS "Source", "user", jobid AS "Job", stepid AS "Step", list(problem) AS probs FROM e08 GROUP BY ALL
  UNION ALL BY NAME
  SELECT 'Resources' AS "Source", "user", jobid AS "Job", stepid AS "Step", node AS "Node",
         CAST(coalesce(cnt_cpu, cnt_gpu) AS DOUBLE) / node_tot AS "GPUCPUEntryRatio", node_tot AS "TotGPUCPUSamples",
         CASE WHEN ncpu IS NULL THEN 'GPU' ELSE 'CPU' END AS "GPUCPUEntryType", ncpu AS "AllocCPU", ngpu AS "AllocGPU",
         ncpu_in_use AS "CPUInUse", ngpu_in_use AS "GPUInUse"
  FROM gpucpu_usage WHERE ngpu IS DISTINCT FROM 0 AND coalesce(ncpu_in_use, ngpu_in_use) IS NOT NULL
  UNION ALL BY NAME
  SELECT 'GPU' AS "Source", "user", jobid AS "Job", stepid AS "Step", target_node AS "Node", gpuid_raw AS "GPUID",
         avg_util AS "AvgGPUUtil", measurement_cnt AS "TotGPUSamples", zero_util_cnt AS "CntZeroGPUUtil",
         low_util_cnt AS "CntLowGPUUtil", longest_continuous_zero_util AS "LongestNoGPUUtil",
         avg_clock AS "AvgGPUClockMHz", avg_power_usage AS "AvgGPUPowerUsageWatt", avg_temperature AS "AvgGPUTempC"
  FROM gpu_usage WHERE is_new_in_period
  UNION ALL BY NAME
  SELECT 'SysTimeRatio' AS "Source", "user", jobid AS "Job", stepid AS "Step", tot_in_batch AS "TotSysTimeRatioSamples",
         sys_ratio_1_10 AS "10%~33%", sys_ratio_1_3 AS "33%~66%", sys_ratio_2_3 AS "66%~100%", sys_ratio_gt_1 AS ">100%"
  FROM sys_ratio WHERE is_new_in_period),
flat0 AS (
  SELECT (SELECT s FROM rng) AS "Period", CAST(s."Job" AS VARCHAR) AS "Job",
         CASE WHEN s."Step" IS NULL THEN 'null' WHEN s."Step" = -3 THEN 'pending' WHEN s."Step" = -4 THEN 'extern'
              WHEN s."Step" = -5 THEN 'batch' WHEN s."Step" = -6 THEN 'interactive' ELSE CAST(s."Step" AS VARCHAR) END AS "Step",
         s."user" AS "User", CASE WHEN s."Source" = 'JobInfo' THEN s."Name" ELSE nm.nm END AS "Name", s."Source",
         s."Node", s."App", s."GPUCPUEntryType", s."NodeCnt", CASE WHEN s."JobLength" >= 0 THEN s."JobLength" END AS "JobLength",
         s."TimeLimit", s."PeakRssSize", s."MemLimit", s."GPUCPUEntryRatio", s."TotGPUCPUSamples", s."AllocCPU",
         s."AllocGPU", s."CPUInUse", s."GPUInUse", s."GPUID", s."AvgGPUUtil", s."TotGPUSamples", s."CntZeroGPUUtil",
         s."CntLowGPUUtil", s."LongestNoGPUUtil", s."AvgGPUClockMHz", s."AvgGPUPowerUsageWatt", s."AvgGPUTempC",
         s."TotSysTimeRatioSamples", s."10%~33%", s."33%~66%", s."66%~100%", s.">100%", {probs},
         s."Step" IS NULL AS job_level
  FROM sec s LEFT JOIN names nm ON nm."user" = s."user" AND nm."Job" = s."Job"),
flat AS (SELECT * EXCLUDE (job_level, {", ".join(f'"{p}"' for p in PROBLEM_NAMES)}), {fill} FROM flat0)
"""


# fixed values: computed columns, averages and levels of the exploration view
EXPRESSION_SQL = [
    ("JobLengthHour", '"JobLength" / 3600.0'), ("TimeLimitHour", '"TimeLimit" / 60.0'), ("MemLimitMB", '"MemLimit" / 1048576.0'),
    ("PeakRssSizeMB", '"PeakRssSize" / 1048576.0'), ("PeakMemUsage%", '100.0 * "PeakRssSize" / nullif("MemLimit", 0)'),
    ("CPUUsage%", '100.0 * "CPUInUse" / nullif("AllocCPU", 0)'), ("GPUUsage%", '100.0 * "GPUInUse" / nullif("AllocGPU", 0)'),
    ("ZeroGPUUtil%", '100.0 * "CntZeroGPUUtil" / nullif("TotGPUSamples", 0)'),
    ("LowGPUUtil%", '100.0 * "CntLowGPUUtil" / nullif("TotGPUSamples", 0)'),
    ("LongestNoGPUUtil%", '100.0 * "LongestNoGPUUtil" / nullif("TotGPUSamples", 0)'),
    ("10~33%", '100.0 * "10%~33%" / nullif("TotSysTimeRatioSamples", 0)'),
    ("33~66%", '100.0 * "33%~66%" / nullif("TotSysTimeRatioSamples", 0)'),
    ("66~100%", '100.0 * "66%~100%" / nullif("TotSysTimeRatioSamples", 0)'),
    ("Ratios >100%", '100.0 * ">100%" / nullif("TotSysTimeRatioSamples", 0)'),
]
AVERAGED = [
    "NodeCnt", "JobLengthHour", "TimeLimitHour", "Low Concurrency", "Low Compute Power", "Jupyter Detected", "Memory Oversubscribe",
    "Memory Underusage", "PeakMemUsage%", "MemLimitMB", "CPU Underusage", "AllocCPU", "Completely No Util", "GPU Underusage", "AllocGPU",
    "AvgGPUUtil", "ZeroGPUUtil%", "LowGPUUtil%", "LongestNoGPUUtil%", "Investigate GPU Usage", "Try Splitting", "AvgGPUClockMHz",
    "AvgGPUPowerUsageWatt", "AvgGPUTempC", "System Time Ratio", "10~33%", "33~66%", "66~100%", "Ratios >100%",
]
NUMBERS = [
    "Period", "NodeCnt", "JobLength", "TimeLimit", "PeakRssSize", "MemLimit", "GPUCPUEntryRatio", "TotGPUCPUSamples", "AllocCPU", "AllocGPU",
    "CPUInUse", "GPUInUse", "GPUID", "AvgGPUUtil", "TotGPUSamples", "CntZeroGPUUtil", "CntLowGPUUtil", "LongestNoGPUUtil", "AvgGPUClockMHz",
    "AvgGPUPowerUsageWatt", "AvgGPUTempC", "TotSysTimeRatioSamples", "10%~33%", "33%~66%", "66%~100%", ">100%",
]


def _expr_sql() -> str:
    return ", ".join(f'CAST({sql} AS DOUBLE) AS "{name}"' for name, sql in EXPRESSION_SQL)


def _rollup_sql() -> str:
    def near(x: str) -> str:
        return f"floor({x} * 1000000 + 0.5001) / 1000000"

    aggs = [f'{near(f"avg(CAST({chr(34)}{c}{chr(34)} AS DOUBLE))")} AS "{c}"' for c in AVERAGED]
    aggs += [near(f'(sum("{c}" * "GPUCPUEntryRatio") / nullif(sum("GPUCPUEntryRatio") FILTER (WHERE "{c}" IS NOT NULL), 0))') + f' AS "{c}"'
             for c in ("CPUUsage%", "GPUUsage%")]
    aggs.append('string_agg(DISTINCT "App", \', \' ORDER BY "App") AS "App"')
    levels = '"Period", "User", "Name", "Job", "Step", "Source", "Node"'
    return (f'SELECT {levels}, CAST(GROUPING({levels}) AS BIGINT) AS grouping_id, {", ".join(aggs)} '
            f'FROM (SELECT *, {_expr_sql()} FROM flat) GROUP BY ROLLUP ({levels})')


def _fields_sql(section: str, source: str, step: str, numbers: dict[str, str], texts: dict[str, str]) -> str:
    """Fields of a section's entries, numbers as whole millionths."""
    pairs = [f"{{'f': '{k}', 'v': CAST(CAST(floor(CAST({x} AS DOUBLE) * 1000000 + 0.5) AS BIGINT) AS VARCHAR)}}" for k, x in numbers.items()]
    pairs += [f"{{'f': '{k}', 'v': CAST({x} AS VARCHAR)}}" for k, x in texts.items()]
    return (f"SELECT \"user\", '{section}' AS section, jobid AS job, {step} AS step, unnest([{', '.join(pairs)}]) AS p FROM {source}")


SECTION_FIELDS = " UNION ALL ".join([
    _fields_sql("JobInfo", "(SELECT n.*, j.name AS job_name FROM new_steps n LEFT JOIN jobinfo j ON j.jobid = n.jobid AND j.stepid IS NULL)",
                "CAST(NULL AS BIGINT)", {"NodeCnt": "nnodes", "JobLength": "job_length", "TimeLimit": "timelimit"}, {"Name": "job_name"}),
    _fields_sql("MemUsage", "resource_usage", "stepid", {"PeakRssSize": "peak_res_size", "MemLimit": "mem_limit"}, {}),
    _fields_sql("Resources", "(SELECT * FROM gpucpu_usage WHERE ngpu IS DISTINCT FROM 0 AND coalesce(ncpu_in_use, ngpu_in_use) IS NOT NULL)", "stepid",
                {"GPUCPUEntryRatio": "CAST(coalesce(cnt_cpu, cnt_gpu) AS DOUBLE) / node_tot", "TotGPUCPUSamples": "node_tot", "AllocCPU": "ncpu",
                 "AllocGPU": "ngpu", "CPUInUse": "ncpu_in_use", "GPUInUse": "ngpu_in_use"},
                {"Node": "node", "GPUCPUEntryType": "CASE WHEN ncpu IS NULL THEN 'GPU' ELSE 'CPU' END"}),
    _fields_sql("GPU", "(SELECT * FROM gpu_usage WHERE is_new_in_period)", "stepid",
                {"GPUID": "gpuid_raw", "AvgGPUUtil": "avg_util", "TotGPUSamples": "measurement_cnt", "CntZeroGPUUtil": "zero_util_cnt",
                 "CntLowGPUUtil": "low_util_cnt", "LongestNoGPUUtil": "longest_continuous_zero_util", "AvgGPUClockMHz": "avg_clock",
                 "AvgGPUPowerUsageWatt": "avg_power_usage", "AvgGPUTempC": "avg_temperature"}, {"Node": "target_node"}),
    _fields_sql("AppUsage", "(SELECT n.\"user\", a.jobid, a.stepid, a.application FROM application_usage a JOIN new_steps n ON n.jobid = a.jobid "
                            "AND n.stepid = a.stepid)", "stepid", {}, {"App": "application"}),
    _fields_sql("SysTimeRatio", "(SELECT * FROM sys_ratio WHERE is_new_in_period)", "stepid",
                {"TotSysTimeRatioSamples": "tot_in_batch", "10%~33%": "sys_ratio_1_10", "33%~66%": "sys_ratio_1_3", "66%~100%": "sys_ratio_2_3",
                 ">100%": "sys_ratio_gt_1"}, {}),
])


def _plain(select: str, extra: str = "") -> str:
    head = "WITH RECURSIVE " if "walk(" in extra else "WITH "
    return head + extra.strip().rstrip(",") + "\n" + select


ORACLES_OPS: dict[str, str] = {
    "a01_normalize_jobs": _plain("""
      SELECT o_orderkey AS jobid, CAST(NULL AS BIGINT) AS stepid, 'u' || CAST(o_custkey % 7 AS VARCHAR) AS "user",
             o_orderpriority AS name, 'sbatch ' || o_orderstatus AS submit_line, o_orderkey % 50 * 5 + 10 AS timelimit,
             o_orderkey * 100 + 1700000000 AS started_at,
             CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_orderkey * 100 + 1700000000 + 3600 + o_orderkey % 600 END AS ended_at,
             (o_orderkey % 8 + 1) * 1024 * 1024 * 1024 AS mem, CAST(NULL AS BIGINT) AS peak_res_size,
             o_orderkey % 3 + 2 AS nnodes, o_orderkey % 12 + 1 AS ncpu, o_orderkey % 3 AS ngpu
      FROM orders WHERE o_orderkey % 13 <> 0
      UNION ALL
      SELECT l_orderkey, step_id, NULL, l_returnflag || l_linestatus,
             'srun -n ' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR), NULL,
             l_orderkey * 100 + l_linenumber + 1700000000,
             l_orderkey * 100 + l_linenumber + 1700000000 + CAST(floor(l_quantity) AS BIGINT) * 60, NULL,
             CAST(floor(l_extendedprice * 1000) AS BIGINT), NULL, NULL, NULL
      FROM li JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 13 <> 0 AND o_orderkey % 4 <> 0""", LI),
    "a02_accounting_measurements": _plain("""
      SELECT o_orderkey AS jobid, CAST(0 AS BIGINT) AS stepid, o_custkey AS dev_in, o_orderkey AS dev_out,
             CAST(floor(o_totalprice) AS BIGINT) % 100000 AS user_sec, o_orderkey % 1000000 AS user_usec,
             o_custkey % 1000 AS sys_sec, o_orderkey * 7 % 1000000 AS sys_usec,
             CAST(floor(o_totalprice * 100) AS BIGINT) AS res_size
      FROM orders WHERE o_orderkey % 4 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
      UNION ALL
      SELECT l_orderkey, step_id,
             CASE WHEN o_orderkey % 4 <> 0 THEN l_partkey * 10 ELSE o_custkey END,
             CASE WHEN o_orderkey % 4 <> 0 THEN l_suppkey * 10 ELSE o_orderkey END,
             CAST(floor(l_quantity) AS BIGINT) * 10, CAST(floor(l_extendedprice) AS BIGINT) % 1000000,
             CAST(floor(l_discount * 100) AS BIGINT), CAST(floor(l_tax * 1000000) AS BIGINT),
             CASE WHEN o_orderkey % 4 <> 0 THEN CAST(floor(l_extendedprice * 1000) AS BIGINT)
                  ELSE CAST(floor(o_totalprice * 100) AS BIGINT) END
      FROM li JOIN orders ON o_orderkey = l_orderkey""", LI),
    "a03_scrape_measurements": _plain("""
      SELECT recordid, event_id % 25 + 1 AS watcherid, user_id + 1 AS jobid, event_id % 3 - 1 AS stepid,
             CASE WHEN rc <> 0 THEN rc END AS dev_in, CASE WHEN rc <> 0 THEN CAST(floor(value * 500) AS BIGINT) END AS dev_out,
             ut // 100 AS user_sec, ut % 100 * 10000 AS user_usec, st // 100 AS sys_sec, st % 100 * 10000 AS sys_usec,
             CAST(floor(value * 1000) AS BIGINT) * 4096 AS res_size, event_id % 1000 AS minor_pagefault,
             CASE WHEN event_id % 3 > 0 THEN recordid END AS gpu_measurement_batch
      FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS recordid,
                   CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value * 1000) AS BIGINT) END AS rc,
                   CAST(floor(value * 100) AS BIGINT) AS ut, CAST(floor(value * 30) AS BIGINT) AS st FROM events)""", "x AS (SELECT 1)"),
    "a04_scrape_gpu_measurements": _plain("""
      SELECT event_id % 25 + 1 AS watcherid, recordid AS batch, i + 100 AS pid, user_id + 1 AS jobid,
             CASE WHEN event_id % 3 - 1 <> 0 THEN event_id % 3 - 1 END AS stepid, CAST(i AS BIGINT) AS gpuid,
             event_id % 5 AS age, CAST(floor(value * 10) AS BIGINT) // 10 AS power_usage, event_id % 40 + 30 AS temperature,
             user_id % 7 * 100 + 900 AS sm_clock, event_id % 101 AS util, '-' AS clock_limit_reason, 'nvml' AS source
      FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS recordid FROM events), LATERAL generate_series(0, 2) t(i)
      WHERE i < event_id % 3""", "x AS (SELECT 1)"),
    "a05_application_usage": _plain("""
      SELECT DISTINCT user_id + 1 AS jobid, event_id % 3 - 1 AS stepid, event_type AS application FROM events""",
                                    "x AS (SELECT 1)"),
    "a06_cpu_available": _plain("""
      SELECT event_id % 25 + 1 AS watcherid, user_id + 1 AS jobid, event_id % 3 - 1 AS stepid,
             arg_min(event_id % 16 + 1, event_id) AS ncpu FROM events GROUP BY ALL""", "x AS (SELECT 1)"),
    "a07_quality_gate": _plain("SELECT * FROM gate", FIXTURE_CTES.strip().rstrip(",") + ",\n" + GATE),
    "a08_interval_change_log": _plain("""
      SELECT start, scrape_interval FROM (
        SELECT *, lag(scrape_interval) OVER (ORDER BY start, seq) AS p FROM (
          SELECT event_id + 1 AS start, user_id % 3 * 10 + 10 AS scrape_interval, event_id AS seq
          FROM events WHERE event_type = 'signup'))
      WHERE p IS DISTINCT FROM scrape_interval""", "x AS (SELECT 1)"),
    "a09_watcher_registry": _plain("""
      SELECT jobstep_str, target_node, accuracy, id, pid, source, lastfetch, prev_lastfetch
      FROM (SELECT jobstep_str, target_node, accuracy, lastfetch,
                   first_value(id) OVER w AS id, first_value(pid) OVER w AS pid, first_value(source) OVER w AS source,
                   lag(lastfetch, 1, lastfetch - 2419200) OVER (PARTITION BY jobstep_str, target_node, accuracy ORDER BY id) AS prev_lastfetch,
                   row_number() OVER (PARTITION BY jobstep_str, target_node, accuracy ORDER BY id DESC) AS back
            FROM (SELECT *, CAST(jobid AS VARCHAR) || '.' || CASE WHEN stepid IS NULL THEN 'n' ELSE CAST(stepid AS VARCHAR) END AS jobstep_str,
                         CASE WHEN jobid > 0 THEN 3 WHEN privileged = 1 THEN 2 WHEN target_node IS NULL THEN 1 ELSE 0 END AS accuracy,
                         CASE WHEN jobid > 0 THEN 'parent' WHEN privileged = 1 THEN 'privileged'
                              WHEN target_node IS NULL THEN 'sacct' ELSE 'raw_readings' END AS source
                  FROM (SELECT event_id + 1 AS id, user_id + 1000 AS pid,
                               CASE WHEN event_type = 'view' THEN NULL ELSE 'node-' || CAST(user_id % 5 AS VARCHAR) END AS target_node,
                               CASE WHEN event_type = 'click' THEN user_id ELSE 0 END AS jobid,
                               CASE WHEN event_type = 'click' THEN event_id % 2 END AS stepid,
                               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS privileged, event_id * 60 AS lastfetch
                        FROM events))
            WINDOW w AS (PARTITION BY jobstep_str, target_node, accuracy ORDER BY id))
      WHERE back = 1""", "x AS (SELECT 1)"),
    "a10_validate": _plain("""
      SELECT table_name, rule, count(*) AS n_bad FROM (
        SELECT 'watcher' AS table_name, unnest([
                 CASE WHEN pid IS NULL THEN 'pid_not_null' END, CASE WHEN jobid IS NULL THEN 'jobid_not_null' END,
                 CASE WHEN privileged IS NULL THEN 'privileged_not_null' END, CASE WHEN lastfetch IS NULL THEN 'lastfetch_not_null' END,
                 CASE WHEN prev_lastfetch IS NULL THEN 'prev_lastfetch_not_null' END, CASE WHEN pid < 0 THEN 'pid_not_negative' END,
                 CASE WHEN jobid < 0 THEN 'jobid_not_negative' END, CASE WHEN privileged NOT IN (0, 1) THEN 'privileged_flag' END,
                 CASE WHEN prev_lastfetch > lastfetch THEN 'fetches_in_order' END]) AS rule
        FROM (SELECT CASE WHEN event_id % 41 <> 0 THEN event_id % 37 - 1 END AS pid, CASE WHEN event_id % 43 <> 0 THEN user_id % 11 - 1 END AS jobid,
                     CASE WHEN event_id % 47 <> 0 THEN event_id % 3 END AS privileged, CASE WHEN event_id % 53 <> 0 THEN event_id * 60 END AS lastfetch,
                     CASE WHEN event_id % 59 <> 0 THEN event_id * 60 + event_id % 5 - 3 END AS prev_lastfetch FROM events)
        UNION ALL
        SELECT 'jobinfo', unnest([
                 CASE WHEN jobid IS NULL THEN 'jobid_not_null' END, CASE WHEN jobid <= 0 THEN 'jobid_positive' END,
                 CASE WHEN event_id % 4 < 2 AND event_id % 2 = 0 OR event_id % 4 >= 2 AND event_id % 2 = 1 THEN 'user_xor_step' END,
                 CASE WHEN event_id % 6 < 3 AND event_id % 2 = 0 OR event_id % 6 >= 3 AND event_id % 2 = 1 THEN 'ngpu_xor_step' END,
                 CASE WHEN started_at <= 0 THEN 'started_positive' END,
                 CASE WHEN ended_at <> 0 AND ended_at < started_at THEN 'ended_after_start' END,
                 CASE WHEN nnodes <= 0 THEN 'nnodes_positive' END, CASE WHEN ncpu <= 0 THEN 'ncpu_positive' END])
        FROM (SELECT event_id, CASE WHEN event_id % 41 <> 0 THEN event_id % 29 END AS jobid, CASE WHEN event_id % 43 <> 0 THEN event_id % 23 END AS started_at,
                     CASE WHEN event_id % 47 <> 0 THEN event_id % 31 END AS ended_at, CASE WHEN event_id % 53 <> 0 THEN event_id % 3 END AS nnodes,
                     CASE WHEN event_id % 59 <> 0 THEN event_id % 5 - 1 END AS ncpu FROM events)
        UNION ALL
        SELECT 'measurements', unnest([
                 CASE WHEN event_id % 41 = 0 THEN 'watcherid_not_null' END, CASE WHEN event_id % 43 = 0 THEN 'jobid_not_null' END,
                 CASE WHEN event_id % 47 = 0 THEN 'user_sec_not_null' END, CASE WHEN event_id % 53 = 0 THEN 'user_usec_not_null' END,
                 CASE WHEN event_id % 59 = 0 THEN 'sys_sec_not_null' END, CASE WHEN event_id % 61 = 0 THEN 'sys_usec_not_null' END,
                 CASE WHEN event_id % 47 <> 0 AND event_id % 53 <> 0 AND event_id % 59 <> 0 AND event_id % 61 <> 0
                           AND event_id % 2 = 0 AND event_id % 3 = 0 THEN 'tot_time_positive' END])
        FROM events
        UNION ALL
        SELECT 'gpu_measurements', unnest([
                 CASE WHEN event_id % 41 = 0 THEN 'watcherid_not_null' END, CASE WHEN event_id % 43 = 0 THEN 'batch_not_null' END,
                 CASE WHEN event_id % 47 = 0 THEN 'jobid_not_null' END, CASE WHEN event_id % 53 = 0 THEN 'pid_not_null' END,
                 CASE WHEN event_id % 59 = 0 THEN 'gpuid_not_null' END, CASE WHEN event_id % 61 = 0 THEN 'source_not_null' END,
                 CASE WHEN event_id % 43 <> 0 AND event_id % 13 = 0 THEN 'batch_positive' END,
                 CASE WHEN event_id % 5 <> 0 AND event_id % 3 = 0 THEN 'sm_clock_positive' END,
                 CASE WHEN event_id % 7 <> 0 AND event_id % 4 = 0 THEN 'util_not_negative' END])
        FROM events
        UNION ALL
        SELECT 'application_usage', unnest([CASE WHEN event_id % 41 = 0 THEN 'jobid_not_null' END, CASE WHEN event_id % 43 = 0 THEN 'stepid_not_null' END,
                 CASE WHEN event_id % 47 = 0 THEN 'application_not_null' END]) FROM events
        UNION ALL
        SELECT 'analyze_user_info', unnest([CASE WHEN event_id % 41 = 0 THEN 'user_not_null' END, CASE WHEN event_id % 43 = 0 THEN 'skip_not_null' END,
                 CASE WHEN event_id % 43 <> 0 AND event_id % 3 = 2 THEN 'skip_flag' END]) FROM events
        UNION ALL
        SELECT 'scrape_freq_log', unnest([CASE WHEN event_id % 41 = 0 THEN 'start_not_null' END, CASE WHEN event_id % 43 = 0 THEN 'scrape_interval_not_null' END,
                 CASE WHEN event_id % 41 <> 0 AND event_id % 17 = 0 THEN 'start_positive' END,
                 CASE WHEN event_id % 43 <> 0 AND event_id % 19 = 0 THEN 'interval_positive' END]) FROM events
        UNION ALL
        SELECT 'job_step_cpu_available', unnest([CASE WHEN event_id % 41 = 0 THEN 'watcherid_not_null' END, CASE WHEN event_id % 43 = 0 THEN 'jobid_not_null' END,
                 CASE WHEN event_id % 47 = 0 THEN 'stepid_not_null' END, CASE WHEN event_id % 53 = 0 THEN 'ncpu_not_null' END]) FROM events)
      WHERE rule IS NOT NULL GROUP BY table_name, rule""", "x AS (SELECT 1)"),
    "a13_filter_states": _plain("""
      SELECT o_orderkey AS jobid, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'running' END AS state
      FROM orders WHERE o_orderstatus IN ('F', 'O')""", "x AS (SELECT 1)"),
    "a14_latest_global_record": _plain("""
      SELECT m.jobid, m.stepid, nullif(max(CASE WHEN w.target_node IS NULL AND w.jobid = 0 AND w.privileged = 0
                                               THEN m.recordid ELSE -1 END), -1) AS latest_global_recordid
      FROM measurements m LEFT JOIN watcher w ON w.id = m.watcherid GROUP BY m.jobid, m.stepid""", FIXTURE_CTES),
    "b01_tres_decode": _plain("""
      SELECT o_orderkey AS jobid, o_orderkey % 12 + 1 AS tres_1, (o_orderkey % 8 + 1) * 1024 AS tres_2,
             CAST(0 AS BIGINT) AS tres_3, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_orderkey % 3 + 2 END AS tres_4,
             o_orderkey % 3 AS tres_1001 FROM orders""", "x AS (SELECT 1)"),
    "b02_explode_hostlist": _plain("""
      SELECT o_orderkey AS jobid, 'node' || lpad(CAST(i AS VARCHAR), 2, '0') AS node
      FROM orders, LATERAL generate_series(o_custkey % 40, o_custkey % 40 + o_orderkey % 3) t(i)
      UNION ALL SELECT o_orderkey, 'login' || CAST(o_orderkey % 2 AS VARCHAR) FROM orders""", "x AS (SELECT 1)"),
    "b03_cpuset_count": _plain("SELECT event_id, user_id % 4 + 2 AS ncpu FROM events", "x AS (SELECT 1)"),
    "b04_clock_reasons": _plain(f"""
      SELECT event_id, m AS mask, {CLOCK} AS reasons, m AS mask_back
      FROM (SELECT event_id, (event_id % 128) | CASE WHEN event_type = 'error' THEN 4096 ELSE 0 END AS m FROM events)""",
                                "x AS (SELECT 1)"),
    "b05_step_name": _plain("""
      SELECT jobid, stepid, CASE WHEN stepid IS NULL THEN 'null' WHEN stepid = -3 THEN 'pending' WHEN stepid = -4 THEN 'extern'
                                 WHEN stepid = -5 THEN 'batch' WHEN stepid = -6 THEN 'interactive'
                                 ELSE CAST(stepid AS VARCHAR) END AS step FROM jobinfo""", FIXTURE_CTES),
    "b06_parse_entity": _plain("""
      SELECT event_id, 'node-' || CAST(user_id % 5 AS VARCHAR) AS entity_host, user_id AS entity_jobid,
             event_id % 4 AS gpuid FROM events WHERE event_type <> 'view'""", "x AS (SELECT 1)"),
    "b07_slurm_duration": _plain(f"SELECT o_orderkey, {slurm_sql('o_orderkey * 3671 + o_custkey')} AS duration FROM orders",
                                 "x AS (SELECT 1)"),
    "b08_split_ticks": _plain("""
      SELECT event_id, t // 100 AS sec, t % 100 * 10000 AS usec
      FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS t FROM events)""", "x AS (SELECT 1)"),
    "b09_parse_proc_stat": _plain("""
      SELECT event_id, event_id AS pid, event_type || ' ' || props AS comm, event_id // 3 AS ppid,
             event_id % 100 AS minflt, event_id % 11 AS cminflt, CAST(floor(value * 10) AS BIGINT) AS utime,
             CAST(floor(value * 3) AS BIGINT) AS stime, event_id % 7 AS cutime, event_id % 5 AS cstime,
             CAST(floor(value * 1000) AS BIGINT) AS rss_pages FROM events""", "x AS (SELECT 1)"),
    "g01_machine_name": _plain("""
      SELECT doc_id, regexp_replace(lower(concat_ws(' ', source, lang)), '[^a-z]', '_', 'g') AS machine_name
      FROM documents""", "x AS (SELECT 1)"),
    "g02_user_of_address": _plain("SELECT c_custkey, c_name AS \"user\" FROM customer", "x AS (SELECT 1)"),
    "c01_process_tree_rollup": _plain("""
      SELECT 'node-0' AS host, CAST(0 AS BIGINT) AS ts, w.root,
             CAST(sum(CASE WHEN p.alive THEN p.utime + p.cutime ELSE 0 END) AS BIGINT) AS utime,
             CAST(sum(CASE WHEN p.alive THEN p.stime + p.cstime ELSE 0 END) AS BIGINT) AS stime,
             CAST(sum(CASE WHEN p.alive THEN p.minflt + p.cminflt ELSE 0 END) AS BIGINT) AS minor_pagefault,
             CAST(sum(p.rchar) AS BIGINT) AS rchar, CAST(sum(p.wchar) AS BIGINT) AS wchar, max(p.rss) AS res,
             count(*) AS nproc, count(*) FILTER (WHERE p.comm = 'purchase') AS gpu_measurement_cnt,
             any_value(r.jobid) AS jobid, any_value(r.stepid) AS stepid
      FROM walk w JOIN p ON p.pid = w.pid JOIN p r ON r.pid = w.root GROUP BY w.root""", PROCS),
    "c03_step_applications": _plain("""
      SELECT DISTINCT r.jobid, r.stepid, p.comm AS application
      FROM walk w JOIN p ON p.pid = w.pid JOIN p r ON r.pid = w.root
      WHERE p.alive AND p.comm NOT IN ('slurmstepd', 'slurm_script', 'srun')""", PROCS),
    "c04_attribute_gpu_by_pid": _plain("""
      SELECT 'node-0' AS host, CAST(0 AS BIGINT) AS ts, p.pid, p.pid % 4 AS gpuid, p.pid % 101 AS util,
             r.jobid, r.stepid
      FROM walk w JOIN p ON p.pid = w.pid JOIN p r ON r.pid = w.root WHERE p.comm = 'purchase'""", PROCS),
    "c05_attribute_gpu_by_job": _plain("""
      SELECT g.host, g.ts, g.batch, g.pid, g.gpuid, g.jobid,
             CASE WHEN s.n = 1 THEN s.first END AS stepid
      FROM (SELECT w.target_node AS host, g.batch // 40 AS ts, g.batch, g.pid, g.gpuid, g.jobid
            FROM gpu_measurements g JOIN watcher w ON w.id = g.watcherid WHERE w.target_node IS NOT NULL) g
      LEFT JOIN (SELECT w.target_node AS host, m.recordid // 40 AS ts, m.jobid, count(DISTINCT m.stepid) AS n,
                        arg_min(m.stepid, m.recordid) AS first
                 FROM measurements m JOIN watcher w ON w.id = m.watcherid WHERE w.target_node IS NOT NULL
                 GROUP BY ALL) s ON s.host = g.host AND s.ts = g.ts AND s.jobid = g.jobid""", FIXTURE_CTES),
    "c06_latest_gpu_job": _plain("""
      SELECT 'node-' || CAST(user_id % 5 AS VARCHAR) AS host, event_id % 4 AS gpuid, arg_max(user_id, event_id) AS jobid,
             max(event_id) AS time FROM events GROUP BY ALL""", "x AS (SELECT 1)"),
    "c07_pivot_gpu_metrics": _plain("""
      SELECT host, gpuid, CAST(max(age) AS BIGINT) AS age,
             CAST(floor(max(raw) FILTER (WHERE metric = 'power_usage') * 100.0) AS BIGINT) AS power_usage,
             CAST(floor(max(raw) FILTER (WHERE metric = 'sm_clock') * 1e-06) AS BIGINT) AS sm_clock,
             CAST(floor(max(raw) FILTER (WHERE metric = 'utilization') * 100.0) AS BIGINT) AS util,
             CAST(floor(max(raw) FILTER (WHERE metric = 'temperature') * 1.0) AS BIGINT) AS temperature
      FROM (SELECT 'node-' || CAST(user_id % 5 AS VARCHAR) AS host, event_id % 12 AS gpuid, value AS raw,
                   CAST(event_id % 7 AS DOUBLE) AS age,
                   CASE event_type WHEN 'click' THEN 'power_usage' WHEN 'purchase' THEN 'sm_clock'
                        WHEN 'signup' THEN 'utilization' WHEN 'error' THEN 'temperature' ELSE 'memory_used' END AS metric
            FROM events) GROUP BY host, gpuid""", "x AS (SELECT 1)"),
    "c08_gpu_process_rows": _plain(f"""
      SELECT host, ts, gpuid, util, pid, {CLOCK} AS clock_limit_reason FROM (
        SELECT 'node-' || CAST(user_id % 5 AS VARCHAR) AS host, event_id AS ts, event_id % 4 AS gpuid,
               event_id % 101 AS util, event_id * 10 + i AS pid,
               (event_id % 8) | CASE WHEN event_type = 'error' THEN 4096 ELSE 0 END AS m
        FROM events, LATERAL generate_series(0, 2) t(i) WHERE i < event_id % 3)""", "x AS (SELECT 1)"),
    "c09_node_load": _plain("SELECT * FROM load", NODE_LOAD),
    "c10_node_partition": _plain("SELECT * FROM node_part", NODE_LOAD),
    "c11_ranked_nodes": _plain("""
      SELECT l.node, l.cnt, l.node_count_ok, n.partition,
             rank() OVER (PARTITION BY n.partition ORDER BY l.cnt DESC, l.node) AS rank
      FROM load l JOIN node_part n ON n.node = l.node""", NODE_LOAD),
    "c12_job_accounting_summary": _plain("""
      SELECT o_orderkey AS jobid, count(l_orderkey) AS nsteps,
             CAST(coalesce(sum(CAST(floor(l_quantity) AS BIGINT) * 10 * 1000000 + CAST(floor(l_extendedprice) AS BIGINT) % 1000000), 0) AS BIGINT) AS user_usec,
             CAST(coalesce(sum(CAST(floor(l_discount * 100) AS BIGINT) * 1000000 + CAST(floor(l_tax * 1000000) AS BIGINT)), 0) AS BIGINT) AS sys_usec,
             CAST(coalesce(sum(CAST(floor(l_quantity) AS BIGINT) * 10 * 1000000 + CAST(floor(l_extendedprice) AS BIGINT) % 1000000), 0)
                  + coalesce(sum(CAST(floor(l_discount * 100) AS BIGINT) * 1000000 + CAST(floor(l_tax * 1000000) AS BIGINT)), 0) AS BIGINT) AS tot_usec,
             round(coalesce(sum(CAST(floor(l_discount * 100) AS BIGINT) * 1000000 + CAST(floor(l_tax * 1000000) AS BIGINT)), 0)
                   / (coalesce(sum(CAST(floor(l_quantity) AS BIGINT) * 10 * 1000000 + CAST(floor(l_extendedprice) AS BIGINT) % 1000000), 0) + 1.0) * 100, 6) AS sys_user_pct,
             CAST(sum(l_partkey * 10) AS BIGINT) AS tres_in_6, CAST(sum(l_linenumber) AS BIGINT) AS tres_in_1,
             CAST(sum(l_suppkey * 10) AS BIGINT) AS tres_out_6
      FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""", "x AS (SELECT 1)"),
    "f01_list_periods": with_ctes("""SELECT s AS period, s AS started, e AS updated FROM rng
        WHERE EXISTS (SELECT 1 FROM new_steps)""", REPORT_CTES),
    "f03_shared_sections": _plain("""
      SELECT sha256(text) AS content_id, count(*) AS n_refs, min(doc_id) AS first_doc, length(any_value(text)) AS n_chars
      FROM documents GROUP BY sha256(text)""", "x AS (SELECT 1)"),
    "f04_flatten": with_ctes("SELECT * EXCLUDE (\"AvgGPUUtil\", \"GPUCPUEntryRatio\", \"AvgGPUClockMHz\", "
                             "\"AvgGPUPowerUsageWatt\", \"AvgGPUTempC\", \">100%\"), round(\"AvgGPUUtil\", 6) AS \"AvgGPUUtil\", "
                             "round(\"GPUCPUEntryRatio\", 6) AS \"GPUCPUEntryRatio\", round(\"AvgGPUClockMHz\", 6) AS \"AvgGPUClockMHz\", "
                             "round(\"AvgGPUPowerUsageWatt\", 6) AS \"AvgGPUPowerUsageWatt\", round(\"AvgGPUTempC\", 6) AS \"AvgGPUTempC\", "
                             "round(\">100%\", 6) AS \">100%\" FROM flat", REPORT_CTES + "," + _flat_sql()),
    "f07_expressions": with_ctes(None or "", REPORT_CTES + "," + _flat_sql()),
    "f08_rollup_report": with_ctes(_rollup_sql(), REPORT_CTES + "," + _flat_sql()),
    "s02_quality_gate_stream": _plain("SELECT * FROM gate", FIXTURE_CTES.strip().rstrip(",") + ",\n" + GATE),
    "s03_dedupe_stream": _plain("SELECT DISTINCT watcherid, jobid, stepid FROM measurements", FIXTURE_CTES),
}


def _f07() -> str:
    cols = ", ".join(f'round("{name}", 6) AS "{name}"' for name, _ in EXPRESSION_SQL)
    return with_ctes(f'SELECT "Period", "User", "Source", "Job", "Step", "Node", {cols} '
                     f'FROM (SELECT *, {_expr_sql()} FROM flat)', REPORT_CTES + "," + _flat_sql())


ORACLES_OPS["f07_expressions"] = _f07()


def _f06() -> str:
    from jobscope.operators.olap import PROBLEM_NAMES
    parts = []
    for c in [*NUMBERS, *PROBLEM_NAMES]:
        parts.append(f"SELECT '{c}' AS column_name, CASE WHEN bool_or(\"{c}\" IS NOT NULL AND "
                     f"(\"{c}\" <> floor(\"{c}\") OR \"{c}\" > 2147483647)) THEN 'float' ELSE 'integer' END AS type "
                     f"FROM flat")
    return with_ctes(" UNION ALL ".join(parts), REPORT_CTES + "," + _flat_sql())


ORACLES_OPS["f06_promote_types"] = _f06()
ORACLES_OPS["e20_user_documents"] = with_ctes("""
    SELECT "user", section, job, step, p.f AS field, p.v AS value FROM document_fields WHERE p.v IS NOT NULL
    UNION ALL SELECT "user", NULL, NULL, NULL, NULL, NULL FROM active_users WHERE "user" NOT IN (SELECT "user" FROM document_fields)""",
    REPORT_CTES + ",\ndocument_fields AS (" + SECTION_FIELDS + """
    UNION ALL SELECT DISTINCT "user", 'Problems', jobid, stepid, {'f': problem, 'v': '1000000'} FROM e08)""")
ORACLES_OPS["f01_list_periods_viewer"] = with_ctes("""
    SELECT s AS period, s AS started, e AS updated FROM rng WHERE EXISTS (SELECT 1 FROM document_fields WHERE "user" = 'u2')
    UNION ALL SELECT e + 1, e + 1, e + 5 FROM rng WHERE EXISTS (SELECT 1 FROM document_fields WHERE "user" = 'u2')""",
    REPORT_CTES + ",\ndocument_fields AS (" + SECTION_FIELDS + ")")
ORACLES_OPS["f02_fetch_data"] = with_ctes("""
    SELECT s AS period, "user", section, job, step, p.f AS field, p.v AS value FROM document_fields, rng WHERE "user" = 'u1' AND p.v IS NOT NULL
    UNION ALL SELECT e + 1, NULL, NULL, NULL, NULL, NULL, NULL FROM rng""", REPORT_CTES + ",\ndocument_fields AS (" + SECTION_FIELDS + ")")
ORACLES_OPS["e10_with_percentages"] = with_ctes("""
    SELECT "user", jobid, stepid, tot_in_batch,
           round(CAST(sys_ratio_1_10 AS DOUBLE) / nullif(CAST(tot_in_batch AS DOUBLE), 0) * 100, 6) AS sys_ratio_1_10_pct,
           round(CAST(sys_ratio_1_3 AS DOUBLE) / nullif(CAST(tot_in_batch AS DOUBLE), 0) * 100, 6) AS sys_ratio_1_3_pct,
           round(CAST(sys_ratio_2_3 AS DOUBLE) / nullif(CAST(tot_in_batch AS DOUBLE), 0) * 100, 6) AS sys_ratio_2_3_pct,
           round(CAST(sys_ratio_gt_1 AS DOUBLE) / nullif(CAST(tot_in_batch AS DOUBLE), 0) * 100, 6) AS sys_ratio_gt_1_pct
    FROM e04""", REPORT_CTES)

ORACLES_OPS["a11_analysis_range"] = _plain(
    "SELECT max(recordid) // 2 AS offset_start, max(recordid) AS offset_end, true AS \"commit\" FROM measurements",
    FIXTURE_CTES)
ORACLES_OPS["a12_fetch_range"] = _plain(
    """SELECT event_id + 1 AS id, CASE WHEN (event_id + 1) % 3 = 0 THEN 1000000000 - 2419200 ELSE event_id * 60 END AS fetch_start,
              CAST(1000000000 AS BIGINT) AS fetch_end FROM events""",
    "x AS (SELECT 1)")
ORACLES_OPS["a15_backfill_watcher"] = _plain("""
    SELECT recordid, jobid, stepid,
           CASE WHEN recordid % 7 = 0 THEN (SELECT id FROM watcher WHERE target_node IS NULL AND jobid = 0 AND privileged = 0
                                            ORDER BY id LIMIT 1)
                ELSE watcherid END AS watcherid
    FROM measurements""", FIXTURE_CTES)
ORACLES_OPS["a14_replace_global"] = _plain("""
    SELECT recordid, watcherid, jobid, stepid, user_sec, user_usec, sys_sec, tot_time, res_size FROM measurements m
    WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.recordid = m.recordid)
    UNION ALL
    SELECT coalesce(recordid, (SELECT max(recordid) FROM measurements) + row_number() OVER (PARTITION BY recordid IS NULL ORDER BY jobid, stepid)),
           8, jobid, stepid, user_sec, 1, sys_sec, user_sec * 1000000 + sys_sec * 1000000 + 3, res_size
    FROM placed""", FIXTURE_CTES.strip().rstrip(",") + """,
steps AS (SELECT jobid, stepid, max(user_sec) AS user_sec, max(sys_sec) AS sys_sec, max(res_size) AS res_size
          FROM measurements WHERE jobid % 2 = 0 GROUP BY jobid, stepid),
accounted AS (SELECT m.jobid, m.stepid, max(m.recordid) AS recordid FROM measurements m JOIN watcher w ON w.id = m.watcherid
              WHERE w.target_node IS NULL AND w.jobid = 0 AND w.privileged = 0 GROUP BY m.jobid, m.stepid),
placed AS (SELECT s.*, a.recordid FROM steps s LEFT JOIN accounted a ON a.jobid = s.jobid AND a.stepid IS NOT DISTINCT FROM s.stepid
           UNION ALL SELECT jobid + 1000000, stepid, user_sec, sys_sec, res_size, NULL FROM steps)""")
ORACLES_OPS["a16_upgrade_schema"] = _plain("""
    SELECT v AS from_version, jobid, stepid, mem, CASE WHEN v >= 3 THEN ncpu END AS ncpu, CASE WHEN v >= 3 THEN timelimit END AS timelimit,
           CASE WHEN v >= 4 THEN started_at END AS started_at, CASE WHEN v >= 4 THEN ended_at END AS ended_at,
           CASE WHEN v >= 5 THEN nnodes END AS nnodes, CAST(NULL AS BIGINT) AS peak_res_size
    FROM jobinfo, (VALUES (2), (3), (4), (5)) AS versions(v)""", FIXTURE_CTES)

ORACLES_OPS["d02_user_measurements"] = with_ctes(
    'SELECT recordid, watcherid, jobid, stepid, "user", name, target_node, latest_recordid FROM stream')
ORACLES_OPS["d05_active_groups"] = with_ctes("""
    SELECT "user", name, submit_line, max(recordid) AS latest_recordid FROM stream GROUP BY ALL
    HAVING max(recordid) > (SELECT s FROM rng) AND max(recordid) <= (SELECT e FROM rng)""")
ORACLES_OPS["d06_interval_join"] = _plain("""
    SELECT recordid, (SELECT scrape_interval FROM scrape_freq_log WHERE start <= recordid ORDER BY start DESC LIMIT 1) AS scrape_interval
    FROM measurements""", FIXTURE_CTES)
ORACLES_OPS["d07_cpu_join"] = with_ctes("""
    SELECT s.recordid, s.watcherid, s.jobid, s.stepid, 1 + s.jobid % 12 AS ncpu
    FROM stream s JOIN batch_ranges b ON b.recordid = s.recordid""")
ORACLES_OPS["d09_ratio_class"] = with_ctes("""
    SELECT recordid, jobid, stepid, round(CASE WHEN 10 * delta_sys_time <= delta_user_time THEN 0 WHEN 3 * delta_sys_time <= delta_user_time THEN 333
           WHEN 3 * delta_sys_time <= 2 * delta_user_time THEN 667 WHEN delta_sys_time <= delta_user_time THEN 1000
           ELSE CAST(delta_sys_time AS DOUBLE) / delta_user_time * 1000 END, 6) AS cat
    FROM ts WHERE delta_sys_time >= 1000000 AND delta_user_time > 0""")
ORACLES_OPS["d11_fresh_gpu_rows"] = with_ctes("SELECT batch, pid, gpuid, jobid, stepid, age, util FROM gf1")
ORACLES_OPS["d14_gpus_in_use"] = with_ctes(
    'SELECT "user", jobid, stepid, node, ngpu_in_use, cnt_gpu, ngpu, node_tot FROM gpu_rows')
ORACLES_OPS["d15_cpus_in_use"] = with_ctes(
    'SELECT "user", jobid, stepid, node, ncpu_in_use, cnt_cpu, ncpu, node_tot FROM cpu_rows')
ORACLES_OPS["a18_published_periods"] = with_ctes("""
    SELECT s AS period, s AS started, e AS updated, "user", section, job, step, p.f AS field, p.v AS value
    FROM document_fields, rng WHERE p.v IS NOT NULL
    UNION ALL SELECT e, e, e + 2, "user", section, job, step, p.f, p.v FROM document_fields, rng
              WHERE section = 'MemUsage' AND p.v IS NOT NULL""", REPORT_CTES + ",\ndocument_fields AS (" + SECTION_FIELDS + ")")
ORACLES_OPS["e10_gpu_percentages"] = with_ctes("""
    SELECT "user", jobid, stepid, gpuid, measurement_cnt, round(100.0 * zero_util_cnt / nullif(measurement_cnt, 0), 6) AS zero_util_cnt_pct,
           round(100.0 * low_util_cnt / nullif(measurement_cnt, 0), 6) AS low_util_cnt_pct,
           round(100.0 * longest_continuous_zero_util / nullif(measurement_cnt, 0), 6) AS longest_continuous_zero_util_pct
    FROM e02""", REPORT_CTES)
