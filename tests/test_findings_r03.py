"""Cases of the findings of round 3."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from jobscope import fixtures
from jobscope.operators import core, olap
from jobscope.operators.core import Analysis, half_period
from jobscope.plans.scan import key_sizes, ordered_scan
from jobscope.queries import analysis
from jobscope.sources import derived as D
from jobscope.sources import ingest as A


def test_d12_returns_the_breaker_of_each_segment(spark):
    rows = E.queries()["d12_gpu_idle_segments"](spark, SF_SMALL).collect()
    by_gpu = {}
    for r in sorted(rows, key=lambda r: (r.batch, r.pid)):
        by_gpu.setdefault((r.jobid, r.stepid, r.gpuid), []).append(r)
    assert by_gpu
    for readings in by_gpu.values():
        zeros = 0
        for i, r in enumerate(readings):
            assert r.segment_breaker == (-zeros if r.util != 0 or i == len(readings) - 1 else 0)
            zeros += r.util == 0


@pytest.mark.parametrize("hot_rows", [3, 500])
def test_scan_splits_hot_keys_only(spark, hot_rows):
    rows = [(k, i * 50 + k, i % 7) for k in range(40) for i in range(3 if k else hot_rows)]
    df = spark.createDataFrame(rows, "k long, pos long, v long")
    specs = [("lag", "lag", "v"), ("lead", "lead", "v"), ("si", "sum_incl", "v"), ("se", "sum_excl", "v"),
             ("mx", "max_excl", "v"), ("fi", "first", "v"), ("ma", "max_all", "v"), ("mi", "min_all", "v")]
    scan = ordered_scan(df, ["k"], ["pos"], specs, 160, sizes=key_sizes(df, ["k"]))
    plan = scan._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in plan) == (hot_rows > 10)  # few rows a key: windows alone
    w = Window.partitionBy("k").orderBy("pos")
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = df.select("*", F.lag("v").over(w), F.lead("v").over(w), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                     F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                     *[f("v").over(everything) for f in (F.first, F.max, F.min)])
    assert sorted(map(tuple, scan.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_step_texts_stay_out_of_the_scans(spark):
    a = analysis(spark, SF_SMALL)
    assert not {"name", "submit_line"} & set(a.batched_samples.columns)
    exchanges = [line for line in a.timeseries_plan._jdf.queryExecution().executedPlan().toString().splitlines()
                 if "Exchange hashpartitioning" in line and "submit_line" in line]
    assert all("measurement_batch" not in line for line in exchanges)


def test_rows_of_jobs_without_samples_go_before_the_exchanges(spark, monkeypatch):
    mon, plans = fixtures.load(spark, SF_SMALL), {}
    store = core.materialize
    monkeypatch.setattr(core, "materialize", lambda df, name, *by: plans.setdefault(name, df) and store(df, name, *by))
    a = Analysis(mon, half_period(mon.measurements), 1 << 22)
    got = a.active_steps
    plan = plans["steps"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi, (jobid") == 2  # job rows and step rows
    seen = a.node_samples.groupBy("jobid", "stepid").agg(F.max("recordid").alias("latest_recordid"))
    want = a.recombined_jobinfo.where(F.col("stepid").isNotNull()).join(seen, ["jobid", "stepid"])
    assert got.columns == want.columns and got.count()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_rollup_does_not_copy_each_leaf_per_level(spark):
    flat = spark.createDataFrame(
        [(0, "u1", "n", "1", "0", s, None, a, 2.0 * i) for i, (s, a) in enumerate([("AppUsage", "py"), ("GPU", None), ("AppUsage", "r")])],
        "Period long, User string, Name string, Job string, Step string, Source string, Node string, App string, AvgGPUUtil double")
    for e in olap.EXPRESSIONS:
        for c in e[1:3]:
            if c and c not in flat.columns:
                flat = flat.withColumn(c, F.lit(None).cast("double"))
    out = olap.rollup_report(flat)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.grouping_id: r for r in out.collect() if r.Source in (None, "GPU")}
    assert sorted(got) == [0, 1, 3, 7, 15, 31, 63, 127]
    assert (got[127].AvgGPUUtil, got[127].App, got[1].AvgGPUUtil, got[1].App) == (2.0, "py, r", 2.0, None)


def test_gate_sends_no_rows_through_an_aggregate(spark):
    mon = fixtures.load(spark, SF_SMALL)
    plan = A.quality_gate(mon.measurements, mon.watcher)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan


def test_both_envelope_tables_come_from_one_numbering(spark):
    envelopes = D.envelopes(spark, SF_SMALL)
    results = A.numbered_results(envelopes, 7).localCheckpoint()
    for build in (A.scrape_measurements, A.scrape_gpu_measurements):
        once = build(envelopes, results=results)
        assert "posexplode" not in once._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(repr, once.collect())) == sorted(map(repr, build(envelopes, first_recordid=7).collect()))
