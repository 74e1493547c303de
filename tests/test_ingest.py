import random

from pyspark.sql import functions as F

from jobscope.sources import ingest as A


def simulate_gate(rows, acc_of, node_of):
    kept, by_key = [], {}
    for rid, wid, job, step, tot in rows:
        if tot == 0:
            continue
        prior = by_key.get((job, step), [])
        a, n = acc_of[wid], node_of[wid]
        if any(pa > a or (pa == a and pt == tot and pn == n) for pa, pn, pt in prior):
            continue
        by_key.setdefault((job, step), []).append((a, n, tot))
        kept.append(rid)
    return sorted(kept)


def test_quality_gate_equals_row_by_row_trigger(spark):
    rnd = random.Random(11)
    watchers = [(1, None, 0, 0), (2, "n1", 0, 0), (3, "n2", 0, 1), (4, "n1", 0, 0), (5, None, 7, 0)]
    w = spark.createDataFrame(watchers, "id long, target_node string, jobid long, privileged int") \
             .withColumn("stepid", F.lit(None).cast("long"))
    wreg = {r.id: (r.accuracy, r.target_node) for r in A.watcher_registry_columns(w).collect()}
    rows = [(i + 1, rnd.choice([1, 2, 3, 4, 5]), rnd.choice([1, 2]), rnd.choice([0, None]), rnd.choice([0, 5, 6, 7]))
            for i in range(300)]
    m = spark.createDataFrame([(r, wid, j, s, t // 1000000, t % 1000000, 0, 0) for r, wid, j, s, t in rows],
                              "recordid long, watcherid long, jobid long, stepid long, user_sec long, "
                              "user_usec long, sys_sec long, sys_usec long")
    got = sorted(r.recordid for r in A.quality_gate(m, w, chunk=16).collect())
    want = simulate_gate(rows, {k: v[0] for k, v in wreg.items()}, {k: v[1] for k, v in wreg.items()})
    assert got == want


def test_latest_jobinfo_and_change_log(spark):
    log = spark.createDataFrame([(1, None, "a", (1, -1)), (1, None, "b", (2, -1)), (1, 0, "old", (1, 2_000_000)), (1, 0, "s", (2, 0))],
                                "jobid long, stepid long, name string, ingest_seq struct<seq:long,pos:long>")
    got = {(r.jobid, r.stepid): r.name for r in A.latest_jobinfo(log).collect()}
    assert got == {(1, None): "b", (1, 0): "s"}
    st = spark.createDataFrame([(1, 20, 0), (5, 20, 1), (9, 30, 2), (12, 30, 3), (15, 20, 4)],
                               "start long, scrape_interval long, seq long")
    assert [tuple(r) for r in A.interval_change_log(st).orderBy("start").collect()] == [(1, 20), (9, 30), (15, 20)]
    assert [tuple(r) for r in A.interval_change_log(st, literal=True).orderBy("start").collect()] == [(1, 20), (9, 30)]


def test_validate_and_upgrade(spark):
    j = spark.createDataFrame([(1, None, "u", 1, 10, 20), (1, 0, "u", None, 10, 5)],
                              "jobid long, stepid long, user string, ngpu long, started_at long, ended_at long")
    good, bad = A.validate("jobinfo", j)
    assert good.count() == 1
    assert sorted(bad.first().failed_rules) == ["ended_after_start", "user_xor_step"]
    unknown = spark.createDataFrame([(1, None, None), (None, 0, -1)], "batch long, sm_clock long, util long")
    good, bad = A.validate("gpu_measurements", unknown)  # NULL meets a condition, but not a NOT NULL
    assert [tuple(r) for r in good.collect()] == [(1, None, None)]
    assert sorted(bad.first().failed_rules) == ["batch_not_null", "sm_clock_positive", "util_not_negative"]


def test_upgrade_steps(spark):
    v2 = spark.createDataFrame([(1, None, "n1")], "jobid long, stepid long, node string")
    assert A.upgrade_schema(v2, "jobinfo", 2).columns == ["jobid", "stepid", "ncpu", "timelimit", "started_at", "ended_at", "nnodes",
                                                          "peak_res_size"]
    m4 = spark.createDataFrame([(1, 5)], "recordid long, elapsed long")
    assert A.upgrade_schema(m4, "measurements", 4).columns == ["recordid"] == A.upgrade_schema(m4.drop("elapsed"), "measurements", 2).columns
    assert A.upgrade_schema(m4, "measurements", 6).columns == m4.columns
    log = spark.createDataFrame([], "start long, scrape_interval long")
    assert [tuple(r) for r in A.upgrade_interval_log(log, 4, 20).collect()] == [(1, 20)]
    assert A.upgrade_interval_log(log, 5, 20).count() == 0


def test_record_ids_are_dense_however_long_an_envelope_is(spark):
    result = ("named_struct('watcherid', 1, 'jobid', id, 'stepid', 0, 'utime', id + 1, 'stime', 0, 'rchar', 0, 'wchar', 0, 'res', 0, 'minflt', 0, "
              "'gpu', array(named_struct('gpuid', 0, 'pid', 1, 'age', 0, 'power_usage', 1, 'temperature', 1, 'sm_clock', 1, 'util', 1, "
              "'clock_limit_reason', '-', 'source', 'x')))")
    e = spark.range(3).selectExpr("'n' AS worker", "id * 7 AS seq",
                                  f"transform(sequence(1, CASE id WHEN 0 THEN 70000 ELSE 2 END), id -> {result}) AS scrape_results")
    ids = sorted(r.recordid for r in A.scrape_measurements(e, chunk=5).select("recordid").collect())
    assert ids == list(range(1, 70005))
    assert sorted(r.batch for r in A.scrape_gpu_measurements(e, chunk=5).select("batch").collect()) == ids


def test_replaced_global_rows_keep_their_record_id(spark):
    columns = "recordid long, watcherid long, jobid long, stepid long, user_sec long"
    m = spark.createDataFrame([(1, 9, 5, 0, 1), (2, 9, 5, 0, 2), (3, 7, 6, None, 3)], columns)
    w = spark.createDataFrame([(9, None, 0, 0, None), (7, "n", 0, 0, None)], "id long, target_node string, jobid long, privileged int, stepid long")
    new = spark.createDataFrame([(9, 5, 0, 20), (9, 6, None, 30), (9, 8, 1, 40), (9, 8, None, 50)], "watcherid long, jobid long, stepid long, user_sec long")
    got = sorted(tuple(r) for r in A.replace_global(m, new, w).select("recordid", "jobid", "stepid", "user_sec").collect())
    assert got == [(1, 5, 0, 1), (2, 5, 0, 20), (3, 6, None, 3), (4, 6, None, 30), (5, 8, None, 50), (6, 8, 1, 40)]


def test_registry_upsert(spark):
    r = spark.createDataFrame([(3, 10, "n1", 5, 0, 0, 300), (1, 11, "n1", 5, 0, 0, 200), (2, 12, None, 0, None, 1, 50), (4, 11, "n1", 5, 0, 0, 300)],
                              "id long, pid long, target_node string, jobid long, stepid long, privileged int, "
                              "lastfetch long")
    got = {(x.jobstep_str, x.target_node): (x.id, x.source, x.lastfetch, x.prev_lastfetch)
           for x in A.watcher_registry(r).collect()}
    assert got[("5.0", "n1")] == (1, "parent", 300, 300)  # the fetch of the renewal before, equal or not
    assert got[("0.n", None)] == (2, "privileged", 50, 50 - 28 * 86400)
