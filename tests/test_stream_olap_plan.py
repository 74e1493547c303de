from pyspark.sql import functions as F

from conftest import SF_SMALL
from jobscope import fixtures
from jobscope.operators import olap
from jobscope.operators.core import half_period, Analysis
from jobscope.queries import analysis
from jobscope.sources import ingest as A
from jobscope.streaming import stream as S


def test_stream_gate_equals_batch(spark):
    mon = fixtures.load(spark, SF_SMALL)
    gated = S.replay_to_table(mon.measurements, "recordid", 3,
                              lambda path: S.quality_gate_stream(S.read_measurement_stream(spark, path), mon.watcher), "t-gate")
    got = sorted(r.recordid for r in gated.collect())
    want = sorted(r.recordid for r in A.quality_gate(mon.measurements, mon.watcher).collect())
    assert got == want and len(got) > 0


def test_rollup_grand_total_and_fill(spark):
    from jobscope.queries_ops import f04
    flat = f04(spark, SF_SMALL).cache()
    r = olap.rollup_report(flat)
    total = r.where(F.col("grouping_id") == 127).first()
    plain = olap.with_expressions(flat).agg(F.avg("AvgGPUUtil").alias("a"), F.avg("NodeCnt").alias("n")).first()
    assert abs((total["AvgGPUUtil"] or 0) - (plain.a or 0)) < 1e-6 and abs((total["NodeCnt"] or 0) - (plain.n or 0)) < 1e-6
    probs = flat.where(F.col("Source") == "Problems").select(*olap.PROBLEM_NAMES).distinct().collect()
    assert {v for row in probs for v in row} <= {0, 100, None}  # filled values are only 0 / 100 / NULL
    types = olap.promote_types(flat)
    assert types["AvgGPUUtil"] == "float" and types["NodeCnt"] == "integer"
    assert r.where(F.col("grouping_id") >= 63).count() == r.where(F.col("Period").isNotNull()).select("Period").distinct().count() + 1


def test_plans_stay_in_jvm_and_split_hot_keys(spark):
    a = analysis(spark, SF_SMALL)
    plan = a.timeseries_plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "__scan_key" in plan and "__scan_bkt" in plan  # windows partition by (key, bucket)
    g = a.gpu_usage._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in g
    m = a.mon.measurements.where(a.per.contains(F.col("recordid"))).select("recordid")
    scan = m._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in scan and "recordid" in scan


def test_chunk_size_does_not_change_results(spark):
    mon = fixtures.load(spark, SF_SMALL)
    big = Analysis(mon, half_period(mon.measurements), 1 << 22)
    small = Analysis(mon, half_period(mon.measurements), 16)
    cols = ["recordid", "measurement_batch", "delta_user_time", "delta_res_size_from_midline"]
    assert sorted(big.timeseries.select(*cols).collect()) == sorted(small.timeseries.select(*cols).collect())
    gc = ["batch", "gpuid", "zero_segment_length"]
    assert sorted(big.gpu_flagged.select(*gc).collect()) == sorted(small.gpu_flagged.select(*gc).collect())
