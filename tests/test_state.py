"""Operators that keep state over rounds and micro-batches: retries, restarts and expiry."""
from collections import defaultdict
from dataclasses import replace

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from jobscope import fixtures
from jobscope.operators.core import Analysis, Period
from jobscope.plans.materialize import scratch_path
from jobscope.sources import derived as D
from jobscope.sources import ingest as A
from jobscope.state import registry as G
from jobscope.state.envelopes import EnvelopeTables
from jobscope.state.feed import Consumer, PeriodFeed
from jobscope.state.imports import MeasurementStore
from jobscope.state.keyed import KeyedTable
from jobscope.state.rounds import HighWaterMarks, RecordIds
from jobscope.streaming import stream as S
from jobscope.streaming.gate import gate_stream
from jobscope.streaming.growing import GrowingAnalysis


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


# ---- keyed tables
def test_changes_are_made_once_and_touch_their_buckets_only(spark):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), ["k", "j"], "k long, j string, v long", buckets=4)
    assert table.read().count() == 0
    first = spark.createDataFrame([(i, None if i % 2 else "x", i) for i in range(40)], "k long, j string, v long")
    newest = lambda old, new: old.unionByName(new).groupBy("k", "j").agg(F.max("v").alias("v"))
    assert table.merge(first, 1, newest) and not table.merge(first.withColumn("v", F.lit(99).cast("long")), 1, newest)
    assert rows(table.read()) == rows(first)
    one = spark.createDataFrame([(3, None, 300)], "k long, j string, v long")
    assert table.merge(one, 2, newest)
    assert table.commits().where("epoch = 2").count() == 1 and table.commits().where("epoch = 1").count() == 4
    assert rows(table.read()) == rows(first.withColumn("v", F.when(F.col("k") == 3, 300).otherwise(F.col("v"))))
    # keys can lose all rows, or get several; no change at all is a commit as well
    table.replace(spark.createDataFrame([(3, None), (4, "x"), (77, "new")], "k long, j string"),
                  spark.createDataFrame([(4, "x", 1), (4, "x", 2)], "k long, j string, v long"), 3)
    assert table.merge(one.limit(0), 4, newest) and table.committed(4)
    got = {(r.k, r.v) for r in table.read().collect()}
    assert {v for k, v in got if k in (3, 4, 77)} == {1, 2} and len(got) == 40


def test_a_change_that_dies_leaves_nothing_and_is_made_again(spark):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), ["k"], "k long, v long", buckets=2)
    table.merge(spark.createDataFrame([(1, 1), (2, 2)], "k long, v long"), 1, lambda old, new: old.unionByName(new))
    changes = spark.createDataFrame([(1, 10), (5, 50)], "k long, v long")
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("v").alias("v"))

    class Dies(KeyedTable):
        def committed(self, epoch):
            return False

    broken = Dies(spark, table.path, ["k"], "k long, v long", buckets=2)
    commit, broken.spark = broken.spark, None  # rows are written by the frames, the commit needs the session
    with pytest.raises(AttributeError):
        broken._current = lambda only=None: table._current(only)
        broken.merge(changes, 2, add)
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, 1), (2, 2)} and not table.committed(2)
    assert table.merge(changes, 2, add) and commit is spark
    assert {(r.k, r.v) for r in KeyedTable(spark, table.path, ["k"], "k long, v long", 2).read().collect()} == {(1, 11), (2, 2), (5, 50)}


def test_registry_in_any_batches_equals_the_registry_at_once(spark):
    registrations = D.registrations(spark, SF_SMALL).cache()
    want = rows(A.watcher_registry(registrations).select(*G.KEYS, "id", "pid", "source", "lastfetch", "prev_lastfetch"))
    for cuts in ([0, 1, 2, 3, 500, 500, 1000], [0, 40, 1000]):
        table = G.registry_table(spark, scratch_path(spark, "registry"), buckets=3)
        for epoch, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            batch = registrations.where((F.col("id") > lo) & (F.col("id") <= hi))
            assert G.register(table, batch, epoch) and not G.register(table, batch, epoch)
        assert rows(G.registry(table).select(*G.KEYS, "id", "pid", "source", "lastfetch", "prev_lastfetch")) == want


# ---- rounds
def test_rounds_survive_a_crash_between_announcement_and_commit(spark):
    table = lambda n: spark.range(1, n + 1).withColumnRenamed("id", "recordid")
    path, published = scratch_path(spark, "marks"), []
    marks = HighWaterMarks(spark, path, period_seconds=100)

    def dies(own):
        published.append((own.round, own.offset_start, own.offset_end))
        raise RuntimeError("lost")

    note = lambda own: published.append((own.round, own.offset_start, own.offset_end))
    assert marks.run(1, table(10), 0, note)[1]
    with pytest.raises(RuntimeError):
        marks.run(2, table(20), 150, dies)
    # another process takes the round up: the announced range, whatever has come since, and the period it closes
    again = HighWaterMarks(spark, path, period_seconds=100)
    own, ran = again.run(2, table(30), 500, note)
    assert ran and (own.offset_start, own.offset_end, own.closes) == (0, 20, True)
    assert again.run(2, table(40), 900, note) == (own, False)
    third, _ = again.run(3, table(40), 900, note)
    assert (third.offset_start, third.offset_end, third.closes, third.period_started) == (20, 40, False, 900)
    assert again.run(4, table(40).limit(0), 950, note)[0].offset_end == 20
    assert published == [(1, 0, 10), (2, 0, 20), (2, 0, 20), (3, 20, 40), (4, 20, 20)]


def test_every_renewal_is_given_once(spark):
    path = scratch_path(spark, "feed")
    feed = PeriodFeed(spark, path, "v long")
    consumer, seen = Consumer(feed, f"{path}-consumer"), []
    take = lambda rows: seen.append(sorted(tuple(r) for r in rows.select("period", "version", "v").collect()))
    value = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    assert consumer.poll(take) == []
    assert feed.publish(7, value(1)) == 1 and consumer.poll(take) == [(7, 1)] and consumer.poll(take) == []
    feed.publish(7, value(2)), feed.publish(8, value(5, 6)), feed.publish(7, value(3))

    def dies(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        consumer.poll(dies)
    # another process goes on where the last commit was
    again = Consumer(PeriodFeed(spark, path, "v long"), f"{path}-consumer")
    assert again.poll(take) == [(7, 3), (8, 1)] and again.poll(take) == []
    feed.publish(9, value())  # an empty period is a change as well
    assert again.poll(take) == [(9, 1)]
    assert seen == [[(7, 1, 1)], [(7, 3, 3), (8, 1, 5), (8, 1, 6)], []]


def test_record_ids_are_dense_and_stay(spark):
    ids = RecordIds(spark, scratch_path(spark, "ids"))
    number = lambda r, df: [x.recordid for x in ids.number(r, df, ["id"]).orderBy("id").collect()]
    assert number(1, spark.range(0, 50, 7)) == list(range(1, 9))
    assert number(2, spark.range(0)) == [] and number(3, spark.range(100, 103)) == [9, 10, 11]
    assert number(1, spark.range(0, 50, 7)) == list(range(1, 9))
    with pytest.raises(ValueError, match="reserved 3"):
        ids.reserve(3, 4)


def test_imported_rounds_feed_the_analysis(spark):
    """A1-A7 over two rounds, then D1-D8; a round that is run again, and one more process, change nothing."""
    watcher = fixtures.load(spark, SF_SMALL).watcher
    jobs, envelopes = D.jobs_raw(spark, SF_SMALL).cache(), D.envelopes(spark, SF_SMALL).cache()
    accounted = A.accounting_measurements(jobs, F.lit(8))
    path = scratch_path(spark, "store")
    store = MeasurementStore(spark, path)
    assert store.import_round(1, accounted.where("jobid % 2 = 0"), envelopes.where("seq < 400"), watcher)
    first = {r.recordid: tuple(r) for r in store.read().collect()}
    assert not store.import_round(1, accounted, envelopes, watcher)
    more = accounted.withColumn("user_sec", F.col("user_sec") + F.when(F.col("jobid") % 4 == 0, 5).otherwise(0))
    other = MeasurementStore(spark, path)
    assert other.import_round(2, more, envelopes.where("seq >= 400"), watcher)
    second = {r.recordid: tuple(r) for r in other.read().collect()}
    assert sorted(first) == list(range(1, len(first) + 1)) and sorted(second) == list(range(1, len(second) + 1))
    changed = [i for i in first if first[i] != second[i]]
    assert all(second[i][1] == 8 for i in changed) and {second[i][2] % 4 for i in changed} >= {0}
    assert all(first[i][2:4] == second[i][2:4] for i in first)  # an id stays with its job and step
    mon = replace(fixtures.load(spark, SF_SMALL), measurements=other.read(), jobinfo=A.latest_jobinfo(A.normalize_jobs(jobs)),
                  application_usage=A.application_usage_of(envelopes), job_step_cpu_available=A.cpu_available(envelopes))
    a = Analysis(mon, Period(F.lit(0).cast("bigint"), F.lit(len(second)).cast("bigint")), 64)
    series = a.timeseries.select("recordid", "jobid", "stepid", "user", "delta_user_time").collect()
    nodes = {r.id for r in watcher.where("target_node IS NOT NULL").collect()}
    assert series and all(second[r.recordid][1] in nodes for r in series)


def test_envelope_tables_equal_the_batch_after_a_crash_between_tables(spark):
    envelopes = D.envelopes(spark, SF_SMALL).cache()
    path = scratch_path(spark, "envelopes")
    tables = EnvelopeTables(spark, path, buckets=3)
    assert tables.take_in(envelopes.where("seq < 300"), 0)
    broken = EnvelopeTables(spark, path, buckets=3)

    def dies(*_):
        raise RuntimeError("lost")

    broken.cpus.merge = dies
    with pytest.raises(RuntimeError):
        broken.take_in(envelopes.where("seq >= 300 AND seq < 700"), 1)
    assert tables.read("measurements").agg(F.max("recordid")).first()[0] == 300  # not committed: not seen
    for _ in range(2):
        tables.take_in(envelopes.where("seq >= 300 AND seq < 700"), 1)
    tables.take_in(envelopes.where("seq < 0"), 2)
    tables.take_in(envelopes.where("seq >= 700"), 3)
    want = {"measurements": A.scrape_measurements(envelopes), "gpu": A.scrape_gpu_measurements(envelopes),
            "applications": A.application_usage_of(envelopes), "cpus": A.cpu_available(envelopes)}
    for name, df in want.items():
        assert rows(tables.read(name).select(*df.columns)) == rows(df)


# ---- S4
def test_growing_period_equals_the_batch_analysis_after_each_trigger(spark):
    mon = fixtures.load(spark, SF_SMALL)
    newest = mon.measurements.agg(F.max("recordid")).first()[0]
    growing, lo = GrowingAnalysis(spark, scratch_path(spark, "growing"), chunk=100), 0
    # two triggers in a period, and one in the next
    for epoch, (start, end) in enumerate([(newest // 3, newest * 5 // 10), (newest // 3, newest * 8 // 10), (newest * 8 // 10, newest)]):
        per = Period(F.lit(start).cast("bigint"), F.lit(end).cast("bigint"))
        batch = replace(mon, measurements=mon.measurements.where((F.col("recordid") > lo) & (F.col("recordid") <= end)))
        assert growing.trigger(epoch, batch, per) and not growing.trigger(epoch, batch, per)
        whole = Analysis(replace(mon, measurements=mon.measurements.where(F.col("recordid") <= end)), per, 100)
        for name in ("sys_ratio", "gpu_usage"):
            want = getattr(whole, name)
            key = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
            assert key(getattr(growing, name)(per).select(*want.columns)) == key(want)
        lo = end


def test_steps_without_new_records_are_not_analysed_again(spark):
    """Two users; the second batch has records of one only."""
    m = spark.createDataFrame([(i, 1 + i // 10 % 2, 10 + i % 2, 0, i, 0, 2 * i, 0, i * 3_000_000, 1000 + i, 16 * i, None) for i in range(1, 81)],
                              "recordid long, watcherid long, jobid long, stepid long, user_sec long, user_usec long, sys_sec long, "
                              "sys_usec long, tot_time long, res_size long, minor_pagefault long, gpu_measurement_batch long")
    jobs = [(10 + j, step, "ab"[j] if step is None else None, "n", "s", 10, 100, 200, 1 << 30 if step is None else None, None, 1, 4, 0)
            for j in (0, 1) for step in (None, 0)]
    mon = replace(fixtures.load(spark, SF_SMALL), measurements=m, jobinfo=spark.createDataFrame(
        jobs, "jobid long, stepid long, user string, name string, submit_line string, timelimit long, started_at long, ended_at long, "
              "mem long, peak_res_size long, nnodes long, ncpu long, ngpu long"),
        job_step_cpu_available=m.select("watcherid", "jobid", "stepid", F.lit(4).cast("long").alias("ncpu")).distinct())
    growing = GrowingAnalysis(spark, scratch_path(spark, "growing"), chunk=1000, buckets=64)
    per = lambda end: Period(F.lit(0).cast("bigint"), F.lit(end).cast("bigint"))
    growing.trigger(1, replace(mon, measurements=m.where("recordid <= 60")), per(60))
    growing.trigger(2, replace(mon, measurements=m.where("recordid > 60 AND jobid = 10")), per(80))
    commits = growing.results["sys_ratio"].commits()
    assert commits.where("epoch = 1").count() == 2 and commits.where("epoch = 2").count() == 1
    want = Analysis(replace(mon, measurements=m.where("recordid <= 60 OR jobid = 10")), per(80), 1000).sys_ratio
    assert want.count() == 2 and rows(growing.sys_ratio(per(80)).select(*want.columns)) == rows(want)


# ---- S6
GATE_ROW = "recordid long, watcherid long, jobid long, stepid long, user_sec long, at long"


def gate_input(spark, table):
    cols = [F.col(f.name) if f.name in table.columns else F.lit(0 if f.name.startswith(("user", "sys")) else None).cast("long").alias(f.name)
            for f in S.MEASUREMENT_SCHEMA.fields]
    return table.select(*cols, F.timestamp_seconds("at").alias("event_time"))


def plain_gate(table, pieces, accuracy, expire):
    """The trigger's rule row by row; a step's state goes at the end of a piece when the newest time of all pieces before
    has passed the step's newest time by ``expire``."""
    best, seen, last, mark, kept = {}, defaultdict(set), {}, None, []
    for lo, hi in pieces:
        piece = [r for r in table if lo < r[0] <= hi]
        for recordid, watcher, job, step, tot, at in piece:
            key, acc = (job, step), accuracy[watcher]
            last[key] = max(last.get(key, 0), at)
            if tot and best.get(key, acc) <= acc and (watcher, tot) not in seen[key]:
                kept.append(recordid)
                best[key] = acc
                seen[key].add((watcher, tot))
        if mark is not None and expire:
            for key in [k for k, t in last.items() if t + expire <= mark]:
                best.pop(key, None), seen.pop(key, None), last.pop(key)
        mark = max([mark or 0] + [r[5] for r in piece])
    return kept


@pytest.mark.parametrize("expire", [None, 25])
def test_gate_state_expires_by_event_time(spark, expire):
    watcher = spark.createDataFrame([(1, "n1", 0, None, 0), (2, "n1", 0, None, 1), (3, "n2", 0, None, 0)],
                                    "id long, target_node string, jobid long, stepid long, privileged int")
    table = [(i, 1 + (i % 7 == 0) + 2 * (i % 5 == 0 and i % 7 > 0), i % 3 if i < 60 or i > 130 else 1, 0, i % 4, i) for i in range(1, 181)]
    df = gate_input(spark, spark.createDataFrame([(a, b, c, d, e, f) for a, b, c, d, e, f in table], GATE_ROW))
    pieces = S.piece_bounds(df, "recordid", 6)

    def stream(path):
        return gate_stream(spark.readStream.schema(df.schema).parquet(path), watcher, expire)

    got = sorted(r.recordid for r in S.replay_to_table(df, "recordid", 6, stream, "gate-test").collect())
    tot = [(r, w, j, s, t * 1_000_000, at) for r, w, j, s, t, at in table]
    want = plain_gate(tot, pieces, {1: 0, 2: 2, 3: 0}, expire)
    assert got == want
    without = plain_gate(tot, pieces, {1: 0, 2: 2, 3: 0}, None)
    assert (set(want) > set(without)) == (expire is not None)


def test_gate_with_state_equals_the_batch_gate(spark):
    mon = fixtures.load(spark, SF_SMALL)
    got = S.replay_to_table(mon.measurements, "recordid", 3, lambda p: gate_stream(S.read_measurement_stream(spark, p), mon.watcher), "gate")
    assert sorted(r.recordid for r in got.collect()) == sorted(r.recordid for r in A.quality_gate(mon.measurements, mon.watcher).collect())
