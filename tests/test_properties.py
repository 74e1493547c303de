"""Property checks from the test strategy."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from jobscope import fixtures
from jobscope.operators.core import Analysis, half_period
from jobscope.queries import analysis
from jobscope.sources import ingest as A


def test_in_use_counts_sum_to_node_totals(spark):
    u = analysis(spark, SF_SMALL).gpucpu_usage
    gpu = u.where(F.col("ngpu_in_use").isNotNull()).groupBy("user", "jobid", "stepid", "node") \
           .agg(F.sum("cnt_gpu").alias("s"), F.max("node_tot").alias("t"), F.min("node_tot").alias("t0"))
    assert gpu.where((F.col("s") != F.col("t")) | (F.col("t") != F.col("t0"))).count() == 0
    cpu = u.where(F.col("ncpu_in_use").isNotNull()).groupBy("user", "jobid", "stepid", "node") \
           .agg(F.sum("cnt_cpu").alias("s"), F.max("node_tot").alias("t"))
    assert cpu.where(F.col("s") != F.col("t")).count() == 0


def test_deltas_sum_to_last_minus_first(spark):
    ts = analysis(spark, SF_SMALL).timeseries
    u = F.col("user_sec") * 1000000 + F.col("user_usec")
    g = ts.groupBy("jobid", "stepid", "measurement_batch").agg(
        F.sum("delta_user_time").alias("d"), F.max_by(u, "recordid").alias("last"), F.min_by(u, "recordid").alias("first"),
        F.sum("delta_res_size").alias("dr"), F.max_by("res_size", "recordid").alias("rl"),
        F.min_by("res_size", "recordid").alias("rf"))
    bad = g.where((F.col("d") != F.col("last") - F.col("first")) | (F.col("dr") != F.col("rl") - F.col("rf")))
    assert g.count() > 0 and bad.count() == 0


def test_quality_gate_is_idempotent(spark):
    mon = fixtures.load(spark, SF_SMALL)
    once = A.quality_gate(mon.measurements, mon.watcher)
    twice = A.quality_gate(once, mon.watcher)
    assert sorted(r.recordid for r in once.select("recordid").collect()) == \
        sorted(r.recordid for r in twice.select("recordid").collect())


def test_result_independent_of_partition_count(spark):
    mon = fixtures.load(spark, SF_SMALL)
    out = []
    for parts in ("1", "4"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            a = Analysis(mon, half_period(mon.measurements), 1 << 22, materialize=False)
            out.append(sorted(tuple(r) for r in a.sys_ratio.select(
                "jobid", "stepid", "tot_in_batch", "sys_ratio_1_3", "measurement_batch").collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1] and len(out[0]) > 0
