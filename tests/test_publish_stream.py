from pyspark.sql import functions as F

from conftest import SF_SMALL
from jobscope import fixtures
from jobscope.operators import olap
from jobscope.operators import reports as R
from jobscope.plans.materialize import scratch_path
from jobscope.queries import analysis
from jobscope.sources import ingest as A
from jobscope.sources import publish as P
from jobscope.streaming import stream as S


def test_period_publication_roundtrip_and_viewer_filter(spark):
    a = analysis(spark, SF_SMALL)
    secs = {name: fn(a, spark) for name, fn in R.SECTIONS.items()}
    path = scratch_path(spark, "t-pub")
    P.write_period(P.section_rows(secs, F.lit(1), F.lit(10), F.lit(20)), path)
    P.write_period(P.section_rows(secs, F.lit(2), F.lit(30), F.lit(40)), path)
    # a growing period 2 is re-published: only its partition is replaced
    P.write_period(P.section_rows(secs, F.lit(2), F.lit(30), F.lit(50)), path)
    pub = P.read_periods(spark, path)
    periods = {r.period: (r.started, r.updated) for r in olap.list_periods(pub, admin=True).collect()}
    assert periods == {1: (10, 20), 2: (30, 50)}
    user = pub.select("user").first().user
    mine = olap.fetch_data(pub, [1], viewer=f"{user}@example.org")
    assert mine.count() > 0 and {r.user for r in mine.select("user").distinct().collect()} == {user}
    assert [r.period for r in olap.missing_periods(pub, [1, 3]).collect()] == [3]


def test_prune_config_drops_missing_inputs(spark):
    df = spark.createDataFrame([(1, "u", 10, 5)], "Period long, User string, CPUInUse long, AllocCPU long")
    cfg = olap.prune_config(df.schema)
    names = [e[0] for e in cfg["expressions"]]
    assert names == ["CPUUsage%"] and cfg["levels"] == ["Period", "User"]


def test_ranges_and_backfill(spark):
    mon = fixtures.load(spark, SF_SMALL)
    state = spark.createDataFrame([(100, 0)], "analysis_offset long, period_started long")
    r = A.analysis_range(mon.measurements, state, F.lit(7 * 86400), 7 * 86400).first()
    assert r.offset_start == 100 and r.offset_end == 1000 and r.commit
    reg = spark.createDataFrame([(1, None), (2, 500)], "id long, lastfetch long")
    f = {x.id: x.fetch_start for x in A.fetch_range(reg, F.lit(10_000_000)).collect()}
    assert f == {1: 10_000_000 - 28 * 86400, 2: 500}
    m = spark.createDataFrame([(1, 0), (2, 5)], "recordid long, watcherid long")
    w = spark.createDataFrame([(8, None, 0, None, 0)], "id long, target_node string, jobid long, stepid long, privileged int")
    assert {x.recordid: x.watcherid for x in A.backfill_watcher(m, w).collect()} == {1: 8, 2: 5}


def test_stream_publication_each_batch(spark):
    mon = fixtures.load(spark, SF_SMALL)
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")

    def analyse(batch, epoch_id):
        return batch.groupBy("jobid").agg(F.max("recordid").alias("latest")).withColumn("period", F.lit(1))

    def run(path):
        S.publish_stream(S.read_measurement_stream(spark, path), analyse, sink, ckpt).trigger(availableNow=True).start().awaitTermination()

    S.replay(mon.measurements, "recordid", 2, run)
    out = spark.read.parquet(sink)
    assert out.select("period").distinct().count() == 1 and out.count() > 0
