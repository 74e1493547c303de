"""Structured Streaming.

* S1: envelopes / measurements arrive as files -> ``readStream`` with
  ``availableNow`` or processing-time triggers (micro-batches).
* S2: the measurement quality gate as a stateful operator keyed by
  (jobid, stepid) (``applyInPandasWithState``): state = max accuracy seen and
  the (accuracy, node, tot_time) keys already accepted; rows of a key are
  processed in record-id order.  Equal to the batch closed form (A7) when
  records arrive in order.
* S3: insert-ignore sets (applications, CPU availability) -> ``dropDuplicates``.
* S4: :mod:`jobscope.streaming.growing` takes in only a batch's new records;
  :func:`publish_stream` overwrites the period's partition (A17).
* S5: :mod:`jobscope.state.rounds` keeps the high-water marks.
* S6: :mod:`jobscope.streaming.gate` expires the state of steps that stopped
  reporting by timers on event time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jobscope.plans.joins import broadcast_if_small
from jobscope.plans.materialize import scratch_path
from jobscope.sources.ingest import watcher_registry_columns

MEASUREMENT_SCHEMA = T.StructType([
    T.StructField("recordid", T.LongType()), T.StructField("watcherid", T.LongType()),
    T.StructField("jobid", T.LongType()), T.StructField("stepid", T.LongType()),
    T.StructField("dev_in", T.LongType()), T.StructField("dev_out", T.LongType()),
    T.StructField("user_sec", T.LongType()), T.StructField("user_usec", T.LongType()),
    T.StructField("sys_sec", T.LongType()), T.StructField("sys_usec", T.LongType()),
    T.StructField("tot_time", T.LongType()), T.StructField("res_size", T.LongType()),
    T.StructField("minor_pagefault", T.LongType()), T.StructField("gpu_measurement_batch", T.LongType()),
])

GATE_STATE = T.StructType([T.StructField("max_accuracy", T.LongType()),
                           T.StructField("seen", T.ArrayType(T.StringType()))])


def _gate(key, pdfs: Iterator[pd.DataFrame], state: GroupState, timeout_ms: int | None = None
          ) -> Iterator[pd.DataFrame]:
    """Row-by-row trigger semantics for one (jobid, stepid), over micro-batches."""
    if state.hasTimedOut:
        state.remove()
        return
    if timeout_ms:
        state.setTimeoutDuration(timeout_ms)
    if state.exists:
        max_acc, seen = state.get
        seen = set(seen or [])
    else:
        max_acc, seen = None, set()
    pdf = pd.concat(list(pdfs), ignore_index=True)
    if pdf.empty:
        return
    pdf = pdf.sort_values("recordid", kind="stable")
    keep = []
    for acc, node, tot in zip(pdf["accuracy"].tolist(), pdf["target_node"].tolist(), pdf["__tot"].tolist()):
        dkey = f"{acc}|{node}|{tot}"
        if tot == 0 or (max_acc is not None and max_acc > acc) or dkey in seen:
            keep.append(False)
            continue
        keep.append(True)
        if max_acc is not None and acc > max_acc:
            # rows below the new maximum are refused from now on: their keys can go
            seen = {k for k in seen if int(k.split("|", 1)[0]) >= acc}
        seen.add(dkey)
        max_acc = acc if max_acc is None else max(max_acc, acc)
    state.update((int(max_acc) if max_acc is not None else None, sorted(seen)))
    out = pdf[keep]
    if not out.empty:
        yield out[[f.name for f in MEASUREMENT_SCHEMA.fields]]


def quality_gate_stream(stream: DataFrame, watcher: DataFrame, state_timeout_ms: int | None = None) -> DataFrame:
    """The stateful quality gate over a measurement stream.  With a timeout
    the state of a (job, step) that stopped reporting is dropped (S6)."""
    w = watcher_registry_columns(watcher).select(F.col("id").alias("watcherid"), "accuracy", "target_node")
    x = stream.join(broadcast_if_small(w), "watcherid").withColumn(
        "__tot", F.col("user_sec") * 1000000 + F.col("user_usec") + F.col("sys_sec") * 1000000 + F.col("sys_usec"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if state_timeout_ms else GroupStateTimeout.NoTimeout

    def gate(key, pdfs, state):
        return _gate(key, pdfs, state, state_timeout_ms)
    return x.groupBy("jobid", "stepid").applyInPandasWithState(
        gate, MEASUREMENT_SCHEMA, GATE_STATE, "append", timeout)


def read_measurement_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Measurement files as a stream (schema fixed, no inference)."""
    r = spark.readStream.schema(MEASUREMENT_SCHEMA)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def dedupe_stream(stream: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """S3: insert-ignore on a stream; with a watermark the state is bounded."""
    if watermark:
        stream = stream.withWatermark(*watermark)
        return stream.dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def run_to_table(df: DataFrame, name: str, trigger_available_now: bool = True) -> DataFrame:
    """Run a streaming frame to completion into Parquet under the checkpoint
    folder (checkpoint location next to it) and read the result back."""
    spark = df.sparkSession
    out = scratch_path(spark, f"stream-{name}")
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-ckpt").outputMode("append")
    q = (w.trigger(availableNow=True) if trigger_available_now else w).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def piece_bounds(df: DataFrame, order_col: str, pieces: int) -> list[tuple[int, int]]:
    """``pieces`` ranges (from, to] of ``order_col`` that cover it."""
    ends = df.select(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()
    lo, hi = int(ends["lo"] or 0) - 1, int(ends["hi"] or 0)
    cuts = [lo + (hi - lo) * i // pieces for i in range(pieces + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def replay(df: DataFrame, order_col: str, pieces: int, run: Callable[[str], None], name: str = "replay") -> None:
    """Let the records of ``df`` arrive piece by piece in ``order_col`` order: each piece is written by as many tasks as it
    takes, into one folder, and ``run(folder)`` then runs a stream over it to its end (one trigger a piece)."""
    path = scratch_path(df.sparkSession, name)
    for lo, hi in piece_bounds(df, order_col, pieces):
        df.where((F.col(order_col) > lo) & (F.col(order_col) <= hi)).write.mode("append").parquet(path)
        run(path)


def replay_to_table(df: DataFrame, order_col: str, pieces: int, stream: Callable[[str], DataFrame], name: str) -> DataFrame:
    """The result of ``stream(folder)`` over records that arrive piece by piece."""
    spark = df.sparkSession
    out, schema = scratch_path(spark, f"stream-{name}"), []

    def run(path: str) -> None:
        frame = stream(path)
        schema.append(frame.schema)
        frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-ckpt") \
            .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    replay(df, order_col, pieces, run, name)
    return spark.read.schema(schema[0]).parquet(out)


def publish_stream(stream: DataFrame, analyse, sink_path: str, checkpoint: str):
    """Each micro-batch re-analyses the growing period and overwrites its
    partition (``analyse(batch_df, epoch_id) -> DataFrame`` with a ``period`` column)."""
    def each(batch: DataFrame, epoch_id: int) -> None:
        out = analyse(batch, epoch_id)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period") \
           .parquet(sink_path)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
