"""Registered queries of the operators that keep state over rounds and micro-batches."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope import fixtures
from jobscope.operators.core import Period
from jobscope.plans.materialize import materialize, scratch_path
from jobscope.queries import analysis, round_doubles
from jobscope.session import scan_chunk
from jobscope.sources import derived as D
from jobscope.sources import ingest as A
from jobscope.sources import publish as P
from jobscope.state import registry as G
from jobscope.state.envelopes import EnvelopeTables, run_envelopes
from jobscope.state.feed import Consumer, PeriodFeed
from jobscope.state.imports import MeasurementStore
from jobscope.state.rounds import HighWaterMarks, Round, in_range
from jobscope.state.runs import RunTable
from jobscope.streaming import stream as S
from jobscope.streaming.gate import gate_stream
from jobscope.streaming.growing import GrowingAnalysis

L = "bigint"
WEEK, HOUR = 7 * 86400, 3600


# ---- S5: rounds with high-water marks
def _rounds(spark: SparkSession, sf: str) -> tuple[list[tuple[int, Round, bool]], str]:
    """Four rounds over a table that grows by a quarter each: the second is run twice (the second time more records are
    there), the third closes the period.  Returned: the calls, and where the periods were published."""
    m = fixtures.load(spark, sf).measurements
    newest = m.agg(F.max("recordid")).first()[0]
    path = scratch_path(spark, "rounds")
    marks, sink = HighWaterMarks(spark, f"{path}/marks", WEEK), f"{path}/published"
    calls = []
    for number, quarters, now in ((1, 1, 0), (2, 2, HOUR), (2, 3, 2 * HOUR), (3, 3, WEEK + HOUR), (4, 4, WEEK + 2 * HOUR)):
        there = m.where(F.col("recordid") <= newest * quarters // 4)

        def publish(own: Round) -> None:
            rows = there.where(in_range(own, F.col("recordid"))).groupBy("jobid", "stepid").agg(
                F.count(F.lit(1)).alias("samples"), F.max("recordid").alias("latest_recordid"))
            P.write_period(rows.withColumn("period", F.lit(own.offset_start).cast(L)), sink)
        calls.append((number, *marks.run(number, there, now, publish)))
    return calls, sink


def s05(spark, sf):
    """What each call of a round worked on."""
    calls, _ = _rounds(spark, sf)
    rows = [(i + 1, number, own.offset_start, own.offset_end, own.closes, ran) for i, (number, own, ran) in enumerate(calls)]
    return spark.createDataFrame(rows, "call long, round long, offset_start long, offset_end long, closes boolean, ran boolean")


def s05_published(spark, sf):
    """What stands published after all rounds."""
    _, sink = _rounds(spark, sf)
    return spark.read.schema("period bigint, jobid bigint, stepid bigint, samples bigint, latest_recordid bigint").parquet(sink)


# ---- S4: a period that grows with every trigger
def _growing(spark: SparkSession, sf: str, result: str) -> DataFrame:
    """Results after each of three triggers, the period starting at half of all records."""
    mon = fixtures.load(spark, sf)
    newest = mon.measurements.agg(F.max("recordid")).first()[0]
    path = scratch_path(spark, "growing")
    growing, out = GrowingAnalysis(spark, f"{path}/state", scan_chunk(spark)), []

    def take_in(batch: DataFrame, epoch: int) -> None:
        end = batch.agg(F.max("recordid")).first()[0]
        per = Period(F.lit(newest // 2).cast(L), F.lit(end).cast(L))
        growing.trigger(epoch, replace(mon, measurements=batch), per)
        rows = getattr(growing, result)(per).withColumn("upto", F.lit(end).cast(L))
        rows.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    def run(folder: str) -> None:
        S.read_measurement_stream(spark, folder).writeStream.foreachBatch(take_in) \
            .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    S.replay(mon.measurements, "recordid", 3, run, "growing-src")
    return spark.read.parquet(f"{path}/out").drop("epoch")


def s04_sys_ratio(spark, sf):
    return _growing(spark, sf, "sys_ratio")


def s04_gpu_usage(spark, sf):
    return _growing(spark, sf, "gpu_usage")


# ---- A2 + A14 + A7: record ids over rounds
def a02_rounds(spark, sf):
    """Two rounds of accounting and scrape rows; the second renews every accounting row (odd jobs have used more) and is
    run twice."""
    watcher = fixtures.watcher(spark, sf)  # no samples are read here: they are not curated
    jobs, envelopes = D.jobs_raw(spark, sf), D.envelopes(spark, sf)
    half = envelopes.agg(F.max("seq")).first()[0] // 2
    accounted = materialize(A.accounting_measurements(jobs, F.lit(8)), "accounted", compression="zstd")  # both rounds take it in
    store = MeasurementStore(spark, scratch_path(spark, "measurement-store"))
    store.import_round(1, accounted.where(F.col("jobid") % 3 != 0), envelopes.where(F.col("seq") <= half), watcher)
    renewed = accounted.withColumn("user_sec", F.col("user_sec") + F.col("jobid") % 2)
    for _ in range(2):
        store.import_round(2, renewed, envelopes.where(F.col("seq") > half), watcher)
    return store.read().select("recordid", "watcherid", "jobid", "stepid", "user_sec", "user_usec", "sys_sec", "sys_usec", "res_size",
                               "gpu_measurement_batch")


# ---- S1: envelopes into four tables
def _envelope_table(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        envelopes = D.envelopes(spark, sf)
        path = scratch_path(spark, "envelopes")
        tables = EnvelopeTables(spark, path)

        def take_in(folder: str) -> None:
            run_envelopes(spark.readStream.schema(envelopes.schema).parquet(folder), tables, f"{path}/checkpoint")
        S.replay(envelopes, "seq", 2, take_in, "envelopes-src")
        return tables.read(name)
    run.__doc__ = f"The {name} after two micro-batches of envelopes."
    return run


# ---- A18 as a stream: each renewal once
def a18_feed(spark, sf):
    """Six publications of three periods, polled after the first, the third and the last (a fourth poll finds nothing):
    what each poll was given."""
    m = fixtures.load(spark, sf).measurements
    newest = m.agg(F.max("recordid")).first()[0]
    path = scratch_path(spark, "feed")
    feed = PeriodFeed(spark, f"{path}/feed", "jobid long, stepid long, samples long")
    consumer = Consumer(feed, f"{path}/consumer")

    def take_into(poll: int):
        return lambda rows: rows.withColumn("poll", F.lit(poll).cast(L)).write.mode("overwrite").parquet(f"{path}/out/poll_{poll}")

    polls = 0
    for period, last, polled in ((0, 1, True), (0, 2, False), (1, 3, True), (1, 4, False), (2, 5, False), (1, 6, True)):
        here = m.where((F.col("recordid") > newest * period // 4) & (F.col("recordid") <= newest * last // 6))
        feed.publish(period, here.groupBy("jobid", "stepid").agg(F.count(F.lit(1)).alias("samples")))
        if polled:
            polls += 1
            consumer.poll(take_into(polls))
    assert consumer.poll(take_into(polls + 1)) == []
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/out").select("poll", "period", "version", "jobid", "stepid", "samples")


# ---- S6, S3
def s06(spark, sf):
    """The quality gate as a stream with keyed value and map state."""
    mon = fixtures.load(spark, sf)
    gated = S.replay_to_table(mon.measurements, "recordid", 4,
                              lambda path: gate_stream(S.read_measurement_stream(spark, path), mon.watcher), "gate")
    return gated.select("recordid", "watcherid", "jobid", "stepid")


def s03_registry(spark, sf):
    """The watcher registry after four micro-batches, each handed over twice."""
    table = G.registry_table(spark, scratch_path(spark, "registry"))
    registrations = D.registrations(spark, sf)
    ckpt = scratch_path(spark, "registry-ckpt")

    def take_in(batch: DataFrame, epoch: int) -> None:
        for _ in range(2):
            G.register(table, batch, epoch)

    def run(folder: str) -> None:
        spark.readStream.schema(registrations.schema).parquet(folder).writeStream.foreachBatch(take_in) \
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()

    S.replay(registrations, "id", 4, run, "registrations")
    return G.registry(table).select("jobstep_str", "target_node", "accuracy", "id", "pid", "source", "lastfetch", "prev_lastfetch")


# ---- S7: sessions and idle runs over batches
def runs_over_batches(spark: SparkSession, rows: DataFrame, keys: list[str], value: str, order: list[str], chunk: int) -> DataFrame:
    """All runs of ``value`` after four micro-batches, each handed over twice."""
    path = scratch_path(spark, "runs")
    table = RunTable(spark, path, rows.schema, keys, value, order, chunk)

    def take_in(batch: DataFrame, epoch: int) -> None:
        for _ in range(2):
            table.take_in(batch, epoch)

    def run(folder: str) -> None:
        spark.readStream.schema(rows.schema).parquet(folder).writeStream.foreachBatch(take_in) \
            .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    S.replay(rows, order[0], 4, run, "runs-src")
    return table.read()


def s07_sessions(spark, sf):
    """Watcher sessions of every analysed user's samples: the islands of D4."""
    samples = analysis(spark, sf).user_stream.select("user", "recordid", "watcherid")
    runs = runs_over_batches(spark, samples, ["user"], "watcherid", ["recordid"], scan_chunk(spark))
    return runs.select("user", F.col("number").alias("session"), F.col("value").alias("watcherid"),
                       F.col("first.recordid").alias("first_record"), F.col("last.recordid").alias("last_record"),
                       F.col("rows").alias("samples"), "open")


def s07_idle(spark, sf):
    """Idle runs of every GPU of a step among its kept readings: the runs of D12; ``run`` counts idle and busy ones."""
    readings = analysis(spark, sf).gpu_flagged.select("jobid", "stepid", "gpuid", "batch", "pid", (F.col("util") == 0).alias("idle"))
    runs = runs_over_batches(spark, readings, ["jobid", "stepid", "gpuid"], "idle", ["batch", "pid"], scan_chunk(spark))
    return runs.where("value").select("jobid", "stepid", "gpuid", F.col("number").alias("run"), F.col("first.batch").alias("first_batch"),
                                      F.col("last.batch").alias("last_batch"), F.col("rows").alias("readings"), "open")


def _r(fn):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return round_doubles(fn(spark, sf))
    run.__doc__ = fn.__doc__
    return run


REGISTRY_STATE = {
    "a02_import_rounds": _r(a02_rounds), "a18_period_feed": _r(a18_feed), "s01_envelope_applications": _envelope_table("applications"),
    "s01_envelope_cpus": _envelope_table("cpus"), "s01_envelope_gpu": _envelope_table("gpu"),
    "s01_envelope_measurements": _envelope_table("measurements"), "s03_registry_upserts": _r(s03_registry), "s04_growing_gpu_usage": _r(s04_gpu_usage),
    "s04_growing_sys_ratio": _r(s04_sys_ratio), "s05_high_water_marks": _r(s05), "s05_published_rows": _r(s05_published),
    "s06_gate_with_state": _r(s06), "s07_idle_runs": _r(s07_idle), "s07_watcher_sessions": _r(s07_sessions),
}
