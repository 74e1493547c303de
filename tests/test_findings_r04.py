"""Cases of the findings of round 4."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from jobscope import fixtures
from jobscope.plans.materialize import scratch_path
from jobscope.plans.scan import crowded_keys
from jobscope.session import SCAN_CHUNK_CONF
from jobscope.sources import derived as D
from jobscope.sources import ingest as A
from jobscope.state import imports
from jobscope.state.imports import MeasurementStore
from jobscope.state.rounds import RecordIds


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def arrivals(spark):
    """Three rounds of accounting rows and envelopes; the last two renew rows."""
    watcher, envelopes = fixtures.watcher(spark, SF_SMALL), D.envelopes(spark, SF_SMALL).localCheckpoint()
    accounted = A.accounting_measurements(D.jobs_raw(spark, SF_SMALL), F.lit(8)).localCheckpoint()
    more = lambda by: accounted.withColumn("user_sec", F.col("user_sec") + F.when(F.col("jobid") % 4 == 0, by).otherwise(0))
    return watcher, [(accounted.where("jobid % 3 != 0"), envelopes.where("seq < 400")), (more(5), envelopes.where("seq BETWEEN 400 AND 700")),
                     (more(9).where("jobid % 2 = 0"), envelopes.where("seq > 700"))]


def imported(spark, arrivals, name):
    watcher, rounds = arrivals
    store = MeasurementStore(spark, scratch_path(spark, name))
    for i, (accounting, envelopes) in enumerate(rounds):
        assert store.import_round(i + 1, accounting, envelopes, watcher)
    return store


@pytest.fixture(scope="module")
def store(spark, arrivals):
    return imported(spark, arrivals, "store")


def test_accounting_rows_of_a_round_are_exchanged_once(spark, arrivals, monkeypatch):
    plans, keep = {}, imports.materialize
    monkeypatch.setattr(imports, "materialize", lambda df, name, *a, **k: plans.setdefault(name, []).append(df) or keep(df, name, *a, **k))
    imported(spark, arrivals, "counted")
    assert {n: len(p) for n, p in plans.items()} == {"accepted": 3}  # one table a round, not dealt again
    for df in plans["accepted"]:
        exchanges = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines()
                     if "Exchange" in line and ("dev_in" in line or "jobid" in line or "partitioning(" in line)]
        exchanges = [line for line in exchanges if "BroadcastExchange" not in line]
        assert sum("rangepartitioning(jobid" in line for line in exchanges) == 1
        assert not any("hashpartitioning(jobid" in line or "hashpartitioning(recordid" in line for line in exchanges)


def test_replaced_rows_are_found_without_an_exchange_of_the_rows(spark, store, monkeypatch):
    got = store.read()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    every = spark.read.parquet(f"{store.path}/rows").collect()
    newest = {}
    for r in sorted(every, key=lambda r: r["round"]):
        newest[r.recordid] = str(tuple(r[c] for c in imports.COLUMNS))
    assert len(every) > len(newest) and sorted(newest) == list(range(1, len(newest) + 1))
    assert rows(got) == sorted(newest.values())
    monkeypatch.setattr(imports, "BROADCAST_LIMIT", 0)  # too many ids for bitmaps
    other = store.read()
    assert "bitmap" not in other._jdf.queryExecution().optimizedPlan().toString() and rows(other) == sorted(newest.values())


def test_bitmaps_find_the_same_rows_beyond_one_bitmap(spark, store):
    later = [(i, q) for q, ids in ((2, (1, 8, 32767, 32768, 32769)), (3, (7, 8, 65536, 65537, 70001))) for i in ids]
    replaced = spark.createDataFrame(later, "recordid long, round long")
    held = spark.range(1, 80000).select(F.col("id").alias("recordid"), (F.col("id") % 2 + 1).alias("round"))
    gone = {(i, i % 2 + 1) for i, q in later if q > i % 2 + 1}
    kept = store._not_replaced(held, replaced, {1: 0, 2: 5, 3: 5})
    assert gone and {tuple(r) for r in held.collect()} - {tuple(r) for r in kept.collect()} == gone


def test_hot_steps_are_split_and_give_the_same_ids(spark, arrivals, store, monkeypatch):
    stored, keep = [], imports.materialize
    monkeypatch.setattr(imports, "materialize", lambda df, name, *a, **k: stored.append(name) or keep(df, name, *a, **k))
    confs = {SCAN_CHUNK_CONF: "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # more than four rows of a step are hot
    before = {c: spark.conf.get(c, None) for c in confs}
    try:
        for c, value in confs.items():
            spark.conf.set(c, value)
        got = imported(spark, arrivals, "hot")
    finally:
        for c, value in before.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)
    assert len(stored) > 3  # dealt by ranges once more
    assert rows(got.read()) == rows(store.read())


def test_tasks_get_a_bounded_number_of_rows(spark, arrivals, store, monkeypatch):
    monkeypatch.setattr(imports, "TASK_ROWS", 300)
    few = imported(spark, arrivals, "few")
    assert rows(few.read()) == rows(store.read())
    assert few._by_ranges(spark.range(3000).selectExpr("id AS jobid", "id AS stepid"), 3000).rdd.getNumPartitions() == 10


def test_runs_are_numbered_where_they_are(spark):
    ids = RecordIds(spark, scratch_path(spark, "ids"))
    runs = spark.createDataFrame([(r, p) for r, n in ((3, 4), (1 << 32, 2), (0, 3)) for p in range(1, n + 1)], "run long, place long")
    seen = {(r.run, r.place): r.recordid for r in ids.number(1, runs, ["run"], place="place").collect()}
    assert [seen[k] for k in sorted(seen)] == list(range(1, 10))
    assert ids.number(2, runs.limit(0), ["run"], place="place").count() == 0
    assert sorted(r.recordid for r in ids.number(3, runs, ["run"], place="place").collect()) == list(range(10, 19))


def test_only_hot_keys_are_counted_by_key(spark):
    df = spark.createDataFrame([(k % 7, None if k % 7 == 3 else 0) for k in range(700)] + [(50 + k, 1) for k in range(300)] + [(9, 9)] * 40, "a long, b long")
    sizes, total = crowded_keys(df, ["a", "b"], 16 * 60)
    assert total == 1040 and {tuple(r) for r in sizes.collect()} == {(k, None if k == 3 else 0, 100) for k in range(7)}
    none, total = crowded_keys(df, ["a", "b"], 16 * 100)
    assert none.isEmpty() and none.columns == ["a", "b", "n"] and total == 1040


def test_accounting_records_are_read_once(spark):
    jobs = spark.createDataFrame(
        [(1, True, None), (2, False, None), (3, False, []), (4, None, None), (5, True, [(0, 7), (1, 8)]), (6, False, [(4, 9)])],
        "jobid long, track_steps boolean, steps array<struct<step_id long, user_cpu_sec long>>")
    texts = lambda *p: [F.lit(f"{i}={v}").alias(n) for n, (i, v) in zip(("tres_usage_in_max", "tres_usage_in_tot", "tres_usage_out_tot"), p)]
    zeros = [F.lit(0).cast("long").alias(c) for c in ("user_cpu_usec", "sys_cpu_sec", "sys_cpu_usec")]
    jobs = jobs.withColumn("stats", F.struct(F.lit(70).cast("long").alias("user_cpu_sec"), *zeros, *texts((2, 1), (6, 2), (6, 3)))) \
        .withColumn("steps", F.transform("steps", lambda s: F.struct(s.step_id.alias("step_id"), s.user_cpu_sec.alias("user_cpu_sec"), *zeros,
                                                                     *texts((2, 11), (6, 12), (6, 13)))))
    got = A.accounting_measurements(jobs, F.lit(8))
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.jobid, r.stepid, r.user_sec, r.dev_in, r.dev_out, r.res_size) for r in got.collect()} == {
        (2, 0, 70, 2, 3, 1), (3, 0, 70, 2, 3, 1), (5, 0, 7, 12, 13, 11), (5, 1, 8, 12, 13, 11), (6, 4, 9, 2, 3, 1)}
