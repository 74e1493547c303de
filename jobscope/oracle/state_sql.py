"""DuckDB text of the queries that keep state over rounds: what each would give from all records at once."""

from __future__ import annotations

from jobscope.oracle.analysis_sql import with_ctes
from jobscope.oracle.fixtures_sql import FIXTURE_CTES
from jobscope.oracle.ops_sql import LI, ORACLES_OPS

_NEWEST = "SELECT max(event_id) + 1 FROM events"


def _grown(select: str) -> str:
    """``select`` over the records up to each of three ends; the period starts at half of all records."""
    parts = []
    for i in (1, 2, 3):
        upto = f"(SELECT ({_NEWEST}) * {i} // 3)"
        ctes = with_ctes(select.replace("SELECT ", f"SELECT CAST({upto} AS BIGINT) AS upto, ", 1))
        ctes = ctes.replace("\nmeasurements AS (", "\nevery_measurement AS (", 1) \
            .replace("\ngpu_measurements AS (", f"\nmeasurements AS (SELECT * FROM every_measurement WHERE recordid <= {upto}),\ngpu_measurements AS (", 1) \
            .replace("rng AS (SELECT max(recordid) // 2 AS s,", f"rng AS (SELECT ({_NEWEST}) // 2 AS s,", 1)
        parts.append(f"SELECT * FROM ({ctes})")
    return "\nUNION ALL\n".join(parts)


_CALLS = f"""(VALUES (1, 1, 0, 1, false, true), (2, 2, 0, 2, false, true), (3, 2, 0, 2, false, false), (4, 3, 0, 3, true, true),
  (5, 4, 3, 4, false, true)) AS c(call, round, first_quarter, last_quarter, closes, ran)"""

_IMPORTS = """,
wa AS (SELECT id, CASE WHEN jobid > 0 THEN 3 WHEN privileged = 1 THEN 2 WHEN target_node IS NULL THEN 1 ELSE 0 END AS accuracy, target_node FROM watcher),
acc AS (SELECT 8 AS watcherid, jobid, stepid, user_sec, user_usec, sys_sec, sys_usec, res_size FROM (ACCOUNTED)),
scr AS (SELECT recordid AS seq, watcherid, jobid, stepid, user_sec, user_usec, sys_sec, sys_usec, res_size, gpu_measurement_batch FROM (SCRAPED)),
half AS (SELECT max(event_id) // 2 + 1 AS h FROM events),
first_arrivals AS (
  SELECT 1 AS kind, jobid AS o1, stepid AS o2, *, NULL AS batch FROM acc WHERE jobid % 3 <> 0
  UNION ALL SELECT 2, seq, 0, * EXCLUDE (seq) FROM (SELECT scr.* FROM scr, half WHERE seq <= h)),
first_judged AS (
  SELECT a.*, accuracy, target_node, user_sec * 1000000 + user_usec + sys_sec * 1000000 + sys_usec AS tt
  FROM first_arrivals a JOIN wa ON wa.id = a.watcherid),
first_gate AS (
  SELECT *, row_number() OVER (ORDER BY kind, o1, o2) AS recordid FROM (
    SELECT *, max(accuracy) OVER (PARTITION BY jobid, stepid ORDER BY kind, o1, o2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best,
           row_number() OVER (PARTITION BY jobid, stepid, accuracy, target_node, tt ORDER BY kind, o1, o2) AS nth
    FROM first_judged WHERE tt <> 0)
  WHERE coalesce(best <= accuracy, true) AND nth = 1),
renewed AS (
  SELECT a.* EXCLUDE (user_sec), user_sec + jobid % 2 AS user_sec,
         (SELECT max(f.recordid) FROM first_gate f WHERE f.jobid = a.jobid AND f.stepid = a.stepid AND f.accuracy = 1) AS recordid FROM acc a),
replacing AS (
  SELECT * FROM (SELECT *, user_sec * 1000000 + user_usec + sys_sec * 1000000 + sys_usec AS tt FROM renewed WHERE recordid IS NOT NULL) r
  WHERE tt <> 0 AND NOT EXISTS (SELECT 1 FROM first_gate f WHERE f.jobid = r.jobid AND f.stepid = r.stepid
                                AND (f.accuracy > 1 OR (f.accuracy = 1 AND f.target_node IS NULL AND f.tt = r.tt)))),
second_arrivals AS (
  SELECT 1 AS kind, jobid AS o1, stepid AS o2, watcherid, jobid, stepid, user_sec, user_usec, sys_sec, sys_usec, res_size, NULL AS batch
  FROM renewed WHERE recordid IS NULL
  UNION ALL SELECT 2, seq, 0, * EXCLUDE (seq) FROM (SELECT scr.* FROM scr, half WHERE seq > h)),
judged AS (
  SELECT 0 AS round, NULL AS kind, recordid AS o1, 0 AS o2, watcherid, jobid, stepid, user_sec, user_usec, sys_sec, sys_usec, res_size, batch, accuracy,
         target_node, tt FROM first_gate
  UNION ALL SELECT 1, a.*, accuracy, target_node, user_sec * 1000000 + user_usec + sys_sec * 1000000 + sys_usec
  FROM second_arrivals a JOIN wa ON wa.id = a.watcherid),
second_gate AS (
  SELECT *, (SELECT count(*) FROM first_gate) + row_number() OVER (ORDER BY kind, o1, o2) AS recordid FROM (
    SELECT *, max(accuracy) OVER (PARTITION BY jobid, stepid ORDER BY round, kind, o1, o2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best,
           row_number() OVER (PARTITION BY jobid, stepid, accuracy, target_node, tt ORDER BY round, kind, o1, o2) AS nth
    FROM judged WHERE tt <> 0)
  WHERE round = 1 AND coalesce(best <= accuracy, true) AND nth = 1),
stored AS (
  SELECT recordid, watcherid, jobid, stepid, user_sec, user_usec, sys_sec, sys_usec, res_size, batch FROM first_gate
  WHERE recordid NOT IN (SELECT recordid FROM replacing)
  UNION ALL SELECT recordid, watcherid, jobid, stepid, user_sec, user_usec, sys_sec, sys_usec, res_size, NULL FROM replacing
  UNION ALL SELECT recordid, watcherid, jobid, stepid, user_sec, user_usec, sys_sec, sys_usec, res_size, batch FROM second_gate)
SELECT * EXCLUDE (batch), CASE WHEN batch IS NOT NULL THEN recordid END AS gpu_measurement_batch FROM stored"""

# runs as islands: place among all of a key less place among those of the same value
_SESSIONS = """SELECT "user", row_number() OVER (PARTITION BY "user" ORDER BY first_record) AS session, watcherid, first_record, last_record, samples,
  last_record = max(last_record) OVER (PARTITION BY "user") AS open
FROM (SELECT "user", watcherid, min(recordid) AS first_record, max(recordid) AS last_record, count(*) AS samples
      FROM island GROUP BY "user", watcherid, island)"""
_IDLE_RUNS = """SELECT * EXCLUDE (idle, last_place, n) FROM (
  SELECT jobid, stepid, gpuid, row_number() OVER (PARTITION BY jobid, stepid, gpuid ORDER BY last_place) AS run, first_batch, last_batch, readings,
         last_place = n AS open, idle, last_place, n
  FROM (SELECT jobid, stepid, gpuid, idle, n, min(batch) AS first_batch, max(batch) AS last_batch, max(place) AS last_place, count(*) AS readings
        FROM (SELECT *, util = 0 AS idle, count(*) OVER (PARTITION BY jobid, stepid, gpuid) AS n,
                     place - row_number() OVER (PARTITION BY jobid, stepid, gpuid, util = 0 ORDER BY place) AS stretch FROM gf1)
        GROUP BY jobid, stepid, gpuid, idle, n, stretch))
WHERE idle"""

_ACCOUNTED = ORACLES_OPS["a02_accounting_measurements"]
_SCRAPED = ORACLES_OPS["a03_scrape_measurements"]

ORACLES_STATE = {
    "a02_import_rounds": "WITH " + FIXTURE_CTES.strip().rstrip(",") + _IMPORTS.replace("ACCOUNTED", _ACCOUNTED).replace("SCRAPED", _SCRAPED),
    "a18_period_feed": "WITH " + FIXTURE_CTES.strip().rstrip(",") + f"""
      SELECT poll, period, version, jobid, stepid, count(*) AS samples
      FROM measurements, (VALUES (1, 0, 1, 1), (2, 0, 2, 2), (2, 1, 1, 3), (3, 1, 3, 6), (3, 2, 1, 5)) AS p(poll, period, version, last)
      WHERE recordid > ({_NEWEST}) * period // 4 AND recordid <= ({_NEWEST}) * last // 6 GROUP BY ALL""",
    "s01_envelope_applications": ORACLES_OPS["a05_application_usage"], "s01_envelope_cpus": ORACLES_OPS["a06_cpu_available"],
    "s01_envelope_gpu": ORACLES_OPS["a04_scrape_gpu_measurements"], "s01_envelope_measurements": _SCRAPED,
    "s03_registry_upserts": ORACLES_OPS["a09_watcher_registry"],
    "s04_growing_gpu_usage": _grown("SELECT * REPLACE (round(avg_util, 6) AS avg_util, round(avg_clock, 6) AS avg_clock, "
                                    "round(avg_power_usage, 6) AS avg_power_usage, round(avg_temperature, 6) AS avg_temperature) FROM gpu_usage"),
    "s04_growing_sys_ratio": _grown("SELECT * REPLACE (round(sys_ratio_gt_1, 6) AS sys_ratio_gt_1, "
                                    "round(major_ratio_unified_tot, 6) AS major_ratio_unified_tot) FROM sys_ratio"),
    "s05_high_water_marks": f"""
      SELECT call, round, ({_NEWEST}) * first_quarter // 4 AS offset_start, ({_NEWEST}) * last_quarter // 4 AS offset_end, closes, ran FROM {_CALLS}""",
    "s05_published_rows": "WITH " + FIXTURE_CTES.strip().rstrip(",") + f""",
      periods AS (SELECT first_quarter, max(last_quarter) AS last_quarter FROM {_CALLS} GROUP BY first_quarter)
      SELECT ({_NEWEST}) * first_quarter // 4 AS period, jobid, stepid, count(*) AS samples, max(recordid) AS latest_recordid
      FROM measurements, periods
      WHERE recordid > ({_NEWEST}) * first_quarter // 4 AND recordid <= ({_NEWEST}) * last_quarter // 4 GROUP BY ALL""",
    "s06_gate_with_state": ORACLES_OPS["a07_quality_gate"],
    "s07_idle_runs": with_ctes(_IDLE_RUNS), "s07_watcher_sessions": with_ctes(_SESSIONS),
}
