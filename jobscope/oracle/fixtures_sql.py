"""DuckDB text of the monitoring views (FIXTURES.md), used as a WITH list.

Same rows as :mod:`jobscope.fixtures`; the number of measured jobs is
``count(orders) div 250`` and job rows cover all orders.
"""

FIXTURE_CTES = r"""
watcher AS (
  SELECT CAST(n_nationkey + 1 AS bigint) AS id, CAST(1000 + n_nationkey AS bigint) AS pid,
         CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE 'node-' || CAST(n_nationkey % 5 AS varchar) END AS target_node,
         CAST(0 AS bigint) AS jobid, CAST(NULL AS bigint) AS stepid,
         CASE WHEN n_regionkey = 4 THEN 1 ELSE 0 END AS privileged
  FROM nation),
jobinfo AS (
  SELECT o_orderkey AS jobid, CAST(NULL AS bigint) AS stepid, 'u' || CAST(o_custkey % 7 AS varchar) AS "user",
         o_orderpriority AS name, 'sbatch ' || o_orderstatus AS submit_line,
         CAST(10 + o_orderkey * 5 AS bigint) AS timelimit, CAST(1700000000 + o_orderkey * 100 AS bigint) AS started_at,
         CASE WHEN o_orderkey % 10 = 0 THEN CAST(0 AS bigint) ELSE CAST(1700000000 + o_orderkey * 400 AS bigint) END AS ended_at,
         CAST((o_orderkey % 8 + 1) * 1073741824 AS bigint) AS mem, CAST(NULL AS bigint) AS peak_res_size,
         CAST(1 + o_orderkey % 2 AS bigint) AS nnodes, CAST(1 + o_orderkey % 12 AS bigint) AS ncpu,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS bigint) ELSE CAST(1 + o_orderkey % 2 AS bigint) END AS ngpu
  FROM orders
  UNION ALL
  SELECT o_orderkey, CAST(s.stepid AS bigint), NULL,
         CASE WHEN s.stepid = -5 THEN 'batch' WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'step' END,
         'srun ' || o_orderstatus, NULL, CAST(1700000000 + o_orderkey * 100 + 5 AS bigint),
         CASE WHEN o_orderkey % 10 = 0 THEN CAST(0 AS bigint) ELSE CAST(1700000000 + o_orderkey * 350 AS bigint) END,
         NULL, CAST(floor(o_totalprice * 4000) AS bigint), NULL, NULL, NULL
  FROM orders CROSS JOIN (VALUES (0), (-5)) AS s(stepid)),
measurements AS (
  SELECT recordid, watcherid, jobid, stepid, CAST(NULL AS bigint) AS dev_in, CAST(NULL AS bigint) AS dev_out,
         CAST(floor(cu / 1000000) AS bigint) AS user_sec, cu % 1000000 AS user_usec,
         CAST(floor(cs / 1000000) AS bigint) AS sys_sec, cs % 1000000 AS sys_usec, cu + cs AS tot_time, res_size,
         pf AS minor_pagefault, CASE WHEN jobid % 3 <> 0 THEN recordid END AS gpu_measurement_batch
  FROM (SELECT recordid, watcherid, jobid, stepid, res_size,
               CAST(SUM(du) OVER w AS bigint) AS cu, CAST(SUM(ds) OVER w AS bigint) AS cs,
               CAST(COUNT(*) OVER w * 16 AS bigint) AS pf
        FROM (SELECT event_id + 1 AS recordid, CAST(1 + floor(event_id / 40) % 25 AS bigint) AS watcherid,
                     CAST(1 + (floor(event_id / 40) * 7 + event_id % 4) %
                          (SELECT floor(count(*) / 250) FROM orders) AS bigint) AS jobid,
                     CASE WHEN floor(event_id / 4) % 2 = 0 THEN CAST(0 AS bigint) ELSE CAST(-5 AS bigint) END AS stepid,
                     CAST(floor(value * 10000000) AS bigint) AS res_size,
                     CAST(floor(value * 1500000) AS bigint) AS du,
                     CAST(floor(value * 1500000 * CASE event_type WHEN 'error' THEN 1.5 WHEN 'purchase' THEN 0.9
                          WHEN 'signup' THEN 0.5 WHEN 'click' THEN 0.25 ELSE 0.05 END) AS bigint) AS ds
              FROM events) e
        WINDOW w AS (PARTITION BY jobid, stepid ORDER BY recordid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) c),
gpu_measurements AS (
  SELECT m.watcherid, m.gpu_measurement_batch AS batch, CAST(100 + g.gpuid AS bigint) AS pid, m.jobid, m.stepid,
         CAST(g.gpuid AS bigint) AS gpuid,
         CASE WHEN m.jobid % 2 = 0 THEN CAST(0 AS bigint) ELSE m.recordid % 7 END AS age,
         CAST(1000 + m.res_size % 20000 AS bigint) AS power_usage, CAST(30 + m.recordid % 3 AS bigint) AS temperature,
         CAST(1200 + m.jobid % 3 * 100 AS bigint) AS sm_clock,
         CASE WHEN m.recordid % 5 < 2 THEN CAST(0 AS bigint) WHEN m.recordid % 5 = 2 THEN CAST(7 AS bigint)
              ELSE m.res_size % 101 END AS util,
         '-' AS clock_limit_reason, 'bright' AS source
  FROM measurements m CROSS JOIN (VALUES (0), (1)) AS g(gpuid)
  WHERE m.gpu_measurement_batch IS NOT NULL AND g.gpuid < 1 + m.jobid % 2),
application_usage AS (
  SELECT DISTINCT jobid, stepid,
         CASE WHEN jobid % 5 = 0 AND stepid = 0 THEN 'jupyter-lab' ELSE 'python' END AS application
  FROM measurements WHERE jobid % 11 <> 0),
job_step_cpu_available AS (
  SELECT DISTINCT watcherid, jobid, stepid, CAST(1 + jobid % 12 AS bigint) AS ncpu FROM measurements),
scrape_freq_log AS (
  SELECT CAST(start AS bigint) AS start, CAST(iv AS bigint) AS scrape_interval
  FROM (VALUES (1, 20), (300, 30), (700, 10)) AS t(start, iv)),
analyze_user_info AS (
  SELECT u AS "user", CAST(skip AS bigint) AS skip FROM (VALUES ('root', 1), ('u3', 1)) AS t(u, skip))
"""
