"""Runs over batches: equal to plain runs of the whole series, whatever the cuts, and to D4 and D12."""
from itertools import groupby
from random import Random

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from jobscope import fixtures
from jobscope.operators.core import Analysis, Period
from jobscope.plans.materialize import scratch_path
from jobscope.queries_state import runs_over_batches
from jobscope.state.runs import LATE, RunTable

SCHEMA = "k string, at long, v long"


def table(spark, chunk=5, path=None):
    return RunTable(spark, path or scratch_path(spark, "runs"), SCHEMA, ["k"], "v", ["at"], chunk, buckets=3)


def plain(rows):
    out, keys = [], {k for k, _, _ in rows}
    for key in keys:
        series = sorted(r[1:] for r in rows if r[0] == key)
        runs = [list(g) for _, g in groupby(series, key=lambda r: r[1])]
        out += [(key, g[0][0], g[-1][0], g[0][1], len(g), i + 1, i == len(runs) - 1) for i, g in enumerate(runs)]
    return sorted(map(str, out))


def found(t):
    return sorted(str((r.k, r.first.at, r.last.at, r.value, r.rows, r.number, r.open)) for r in t.read().collect())


@pytest.mark.parametrize("chunk, cuts", [(1, (0, 40, 41, 90, 200)), (7, (0, 100, 200)), (1000, (0, 3, 150, 200))])
def test_runs_equal_those_of_the_whole_series(spark, chunk, cuts):
    rng = Random(chunk)
    rows = [(rng.choice(["a", "a", "a", "b", None]), at, rng.choice([0, 0, 0, 1, None])) for at in range(198)]
    rows += [("once", 198, 5), ("late to come", 199, None)]
    t = table(spark, chunk)
    for epoch, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        piece = [r for r in rows if lo <= r[1] < hi]
        Random(epoch).shuffle(piece)
        batch = spark.createDataFrame(piece, SCHEMA)
        assert t.take_in(batch, epoch) and not t.take_in(batch, epoch)
        assert found(t) == plain([r for r in rows if r[1] < hi])


def test_empty_batches_and_tables(spark):
    t = table(spark)
    assert found(t) == []
    nothing = spark.createDataFrame([], SCHEMA)
    assert t.take_in(nothing, 1) and not t.take_in(nothing, 1) and found(t) == []
    t.take_in(spark.createDataFrame([("a", 1, 1)], SCHEMA), 2)
    t.take_in(nothing, 3)
    assert found(t) == plain([("a", 1, 1)])


def test_a_batch_that_dies_before_its_commit_is_made_again(spark):
    t = table(spark)
    t.take_in(spark.createDataFrame([("a", 1, 1), ("a", 2, 1)], SCHEMA), 1)
    second = spark.createDataFrame([("a", 3, 1), ("a", 4, 2), ("a", 5, 3)], SCHEMA)
    again = table(spark, path=t.path)

    def dies(*_):
        raise RuntimeError("lost")
    again.open.replace = dies
    with pytest.raises(RuntimeError, match="lost"):
        again.take_in(second, 2)
    assert found(t) == plain([("a", 1, 1), ("a", 2, 1)])
    assert table(spark, path=t.path).take_in(second, 2)
    assert found(t) == plain([("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("a", 5, 3)])


def test_a_record_that_comes_late_is_an_error(spark):
    t = table(spark)
    t.take_in(spark.createDataFrame([("a", 10, 1)], SCHEMA), 1)
    t.take_in(spark.createDataFrame([("b", 3, 1)], SCHEMA), 2)  # order counts within a key only
    with pytest.raises(Exception, match=LATE):
        t.take_in(spark.createDataFrame([("a", 10, 1)], SCHEMA), 3)
    assert found(t) == plain([("a", 10, 1), ("b", 3, 1)])


def test_sessions_and_idle_runs_equal_the_batch_analysis(spark):
    mon = fixtures.load(spark, SF_SMALL)
    newest = mon.measurements.agg(F.max("recordid")).first()[0]
    everything = Period(F.lit(-1).cast("long"), F.lit(newest).cast("long"))
    a = Analysis(mon, everything, 500)
    sessions = runs_over_batches(spark, a.user_stream.select("user", "recordid", "watcherid"), ["user"], "watcherid", ["recordid"], 300)
    batch = a.grouped_measurements.groupBy("user", "measurement_batch").agg(
        F.min("recordid"), F.max("recordid"), F.max("watcherid"), F.count(F.lit(1)))
    got = sessions.select("user", "number", "first.recordid", F.col("last.recordid").alias("l"), "value", "rows")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))

    flagged = a.gpu_flagged
    readings = flagged.select("jobid", "stepid", "gpuid", "batch", "pid", (F.col("util") == 0).alias("idle"))
    runs = runs_over_batches(spark, readings, ["jobid", "stepid", "gpuid"], "idle", ["batch", "pid"], 300)
    keys = ["jobid", "stepid", "gpuid"]
    idle = runs.where("value").groupBy(*keys, "open").agg(F.sum("rows").alias("n"), F.max("rows").alias("longest"), F.count(F.lit(1)).alias("c"))
    totals = {}
    for r in idle.collect():
        n, longest, c, last = totals.get(r[:3], (0, 0, 0, 0))
        totals[tuple(r[:3])] = (n + r.n, max(longest, r.longest), c + r.c, r.n if r.open else last)
    # a lone idle reading at the very end is not counted by D12
    expected = {k: (0, 0) if (c, last) == (1, 1) else (n, longest) for k, (n, longest, c, last) in totals.items()}
    d12 = flagged.groupBy(*keys).agg(F.sum("zero_segment_length").alias("n"), F.max("zero_segment_length").alias("longest"))
    assert {tuple(r[:3]): (r.n, r.longest) for r in d12.collect() if r.n} == {k: v for k, v in expected.items() if v[0]}
