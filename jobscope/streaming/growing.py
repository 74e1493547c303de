"""A period's analysis that grows with every batch of new records.

The batch analysis (:class:`jobscope.operators.core.Analysis`) reads all records each time.  Here every trigger takes in
only the new ones and works out anew only the (job, step)s whose result they change:

* A user's records, in order, fall into *runs* of one watcher.  A run is told by its first record alone, so the runs of
  new records follow from the last run so far.  They are stored with the records (``samples``), and the first records
  of runs and the (job, step, run) pairs (``segments``) apart.
* A session batch counts the runs that begin with a record of an active script.  Scripts become active as the period
  grows, which renumbers batches and can part a step's records differently.  A step's *signature* is the hash of its
  runs and of their batches, counted from its first one: it changes when the step's records are parted differently, and
  it comes from runs and segments, without reading records.
* Steps with new records or another signature are analysed again from their stored records, by the very code of the
  batch analysis; their result rows replace the old ones in keyed tables (:class:`jobscope.state.keyed.KeyedTable`).

Every table is written by epoch: an epoch that is run again overwrites or skips what it wrote, so triggers are exactly
once.  Job rows are taken as they are at the trigger; a step's rows are analysed anew when it has new records.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.fixtures import Monitoring
from jobscope.operators.core import Analysis, Period, null_safe_join
from jobscope.plans.materialize import materialize
from jobscope.plans.scan import ordered_scan
from jobscope.state.keyed import KeyedTable

STEP = ["jobid", "stepid"]
SCRIPT = ["user", "name", "submit_line"]
RUN_SCHEMA = "user string, run long, recordid long, name string, submit_line string, epoch long"
SEGMENT_SCHEMA = "user string, jobid long, stepid long, run long, epoch long"
TAIL_SCHEMA = "user string, tail_watcher long, tail_run long, epoch long"
STEP_SCHEMA = "jobid long, stepid long, user string, name string, submit_line string, latest_recordid long, signature long, first_batch long"


class _Everyone(Analysis):
    """All users but the skipped ones: whoever is active later is then at hand."""

    @cached_property
    def active_users(self) -> DataFrame:
        users = self.mon.jobinfo.where(F.col("stepid").isNull() & F.col("user").isNotNull()).select("user").distinct()
        skip = self.mon.analyze_user_info.where(F.col("skip") == 1).select("user")
        return users.join(skip, "user", "left_anti") if self.honor_skip else users

    @cached_property
    def step_rows(self) -> DataFrame:
        return self.recombined_jobinfo.where(F.col("stepid").isNotNull())

    @cached_property
    def new_samples(self) -> DataFrame:
        return self.node_samples.join(self.step_rows, STEP)


class _Of(Analysis):
    """The batch analysis of records that have their session batch already."""

    step_sizes = None  # the scan counts them

    def __init__(self, grouped: DataFrame, texts: DataFrame, mon: Monitoring, per: Period, chunk: int):
        super().__init__(mon, per, chunk)
        self.grouped, self.texts = grouped, texts

    @cached_property
    def batched_samples(self) -> DataFrame:
        return self.grouped

    def with_step_columns(self, samples: DataFrame) -> DataFrame:
        return samples

    @cached_property
    def step_texts(self) -> DataFrame:
        return self.texts


def _typed(columns: list[tuple[str, str]]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in columns))


class GrowingAnalysis:
    """``mon`` holds the tables at the trigger; its measurements are those of the batch only."""

    def __init__(self, spark: SparkSession, path: str, chunk: int, buckets: int = 8):
        self.spark, self.path, self.chunk, self.buckets = spark, path.rstrip("/"), chunk, buckets
        for name, schema in (("runs", RUN_SCHEMA), ("segments", SEGMENT_SCHEMA), ("tails", TAIL_SCHEMA)):
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy("epoch").parquet(f"{self.path}/{name}")
        self.steps = KeyedTable(spark, f"{self.path}/steps", STEP, STEP_SCHEMA, buckets)
        self.results: dict[str, KeyedTable] = {}

    # ---- tables by epoch
    def _put(self, name: str, rows: DataFrame, epoch: int) -> None:
        rows.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{self.path}/{name}")

    def _get(self, name: str, schema: str | T.StructType, last: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("epoch") <= last)

    # ---- a trigger
    def trigger(self, epoch: int, mon: Monitoring, per: Period) -> bool:
        """Take in a batch of records, younger than all before; False if the epoch is done already."""
        if self.steps.committed(epoch):
            return False
        everyone = _Everyone(mon, per, self.chunk)
        samples, schema = self._take_in(epoch, everyone.new_samples)
        new_steps = samples.where(F.col("epoch") == epoch).groupBy(*STEP).agg(
            *[F.max_by(c, "recordid").alias(c) for c in SCRIPT], F.max("recordid").alias("latest_recordid"))
        new_steps = materialize(new_steps, "new-steps")
        old = self.steps.read()
        now = new_steps.withColumn("new", F.lit(True)) \
            .unionByName(null_safe_join(old, new_steps.select(*STEP), STEP, "left_anti")
                         .select(*new_steps.columns, F.lit(False).alias("new")))
        now = materialize(now, "steps-now")
        kept = null_safe_join(now, self._active(now, per), SCRIPT, "left_semi")
        batches = self._run_batches(epoch, now, per)
        own = self._get("segments", SEGMENT_SCHEMA, epoch).drop("epoch").distinct() \
            .join(kept.select(*STEP), STEP, "left_semi").join(batches, ["user", "run"])
        first = own.groupBy(*STEP).agg(F.min("measurement_batch").alias("first_batch"))
        signed = own.join(first, STEP).groupBy(*STEP, "first_batch").agg(
            F.sum(F.shiftright(F.xxhash64("run", F.col("measurement_batch") - F.col("first_batch")), 16)).alias("signature"))
        before = old.select(*STEP, F.col("signature").alias("old_signature"))
        state = materialize(kept.join(signed, STEP).join(before, STEP, "left"), "signed-steps")
        changed = materialize(state.where(F.col("new") | ~F.col("signature").eqNullSafe(F.col("old_signature")))
                              .select(*STEP, "latest_recordid", "first_batch"), "changed-steps")
        again = samples.drop("epoch").join(changed.select(*STEP, "latest_recordid"), STEP).join(batches, ["user", "run"]).drop("run")
        analysed = _Of(again, state.select(*STEP, "name", "submit_line"), mon, per, self.chunk)
        relative = analysed._sys_ratio().join(changed.select(*STEP, "first_batch"), STEP) \
            .withColumn("measurement_batch", F.col("measurement_batch") - F.col("first_batch")).drop("first_batch", "is_new_in_period")
        for name, rows in (("sys_ratio", relative), ("gpu_usage", analysed._gpu_usage().drop("is_new_in_period"))):
            self._result(name, rows.schema).replace(changed, rows, epoch)
        # the last commit: what the next trigger compares with
        noted = now.drop("new").join(state.select(*STEP, "signature", "first_batch"), STEP, "left")
        noted = null_safe_join(noted, old, self.steps.schema.fieldNames(), "left_anti")
        self.steps.replace(noted.select(*STEP), materialize(noted, "noted-steps"), epoch)
        analysed.release()
        return True

    def _take_in(self, epoch: int, new: DataFrame) -> tuple[DataFrame, T.StructType]:
        """Store a batch's records with their runs; all stored records."""
        tails = self._get("tails", TAIL_SCHEMA, epoch - 1)
        last = tails.groupBy("user").agg(F.max_by(F.struct("tail_watcher", "tail_run"), "epoch").alias("t")).select("user", "t.*")
        seen = ordered_scan(new, ["user"], ["recordid"], [("__watcher", "lag", "watcherid"), ("__has", "lag", F.lit(1))], self.chunk, split=True)
        seen = seen.join(last, "user", "left")
        before = F.when(F.col("__has").isNull(), F.col("tail_watcher")).otherwise(F.col("__watcher"))
        seen = seen.withColumn("flag", F.when(before.eqNullSafe(F.col("watcherid")), 0).otherwise(1)).drop("__watcher", "__has", "tail_watcher")
        runs = ordered_scan(seen, ["user"], ["recordid"], [("__runs", "sum_incl", "flag")], self.chunk, split=True)
        runs = runs.withColumn("run", (F.coalesce("tail_run", F.lit(0)) + F.col("__runs")).cast("long")).drop("tail_run", "__runs")
        self._put("samples", runs.sortWithinPartitions("jobid", "recordid"), epoch)
        schema = T.StructType([*runs.schema.fields, T.StructField("epoch", T.LongType())])
        stored = self._get("samples", schema, epoch)
        batch = stored.where(F.col("epoch") == epoch)
        self._put("runs", batch.where("flag = 1").select("user", "run", "recordid", "name", "submit_line"), epoch)
        self._put("segments", batch.select("user", *STEP, "run").distinct(), epoch)
        self._put("tails", batch.groupBy("user").agg(F.max_by(F.struct("watcherid", "run"), "recordid").alias("t"))
                  .select("user", F.col("t.watcherid").alias("tail_watcher"), F.col("t.run").alias("tail_run")), epoch)
        return stored.drop("flag"), schema

    def _active(self, steps: DataFrame, per: Period) -> DataFrame:
        """Scripts with a sample in the period."""
        return steps.groupBy(*SCRIPT).agg(F.max("latest_recordid").alias("latest")).where(per.contains(F.col("latest"))).select(*SCRIPT)

    def _run_batches(self, epoch: int, steps: DataFrame, per: Period) -> DataFrame:
        """``user, run, measurement_batch``: runs that begin with a record of an active script, counted up to each run."""
        runs = self._get("runs", RUN_SCHEMA, epoch).drop("epoch")
        flagged = null_safe_join(runs, self._active(steps, per).withColumn("one", F.lit(1)), SCRIPT, "left")
        counted = ordered_scan(flagged.withColumn("one", F.coalesce("one", F.lit(0))), ["user"], ["recordid"],
                               [("measurement_batch", "sum_incl", "one")], self.chunk, split=True)
        return materialize(counted.select("user", "run", F.col("measurement_batch").cast("long").alias("measurement_batch")), "run-batches")

    def _result(self, name: str, schema: T.StructType | None = None) -> KeyedTable:
        if name not in self.results:
            fields = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
            self.results[name] = KeyedTable(self.spark, f"{self.path}/{name}", STEP, fields, self.buckets)
        return self.results[name]

    # ---- results so far
    def _kept(self, per: Period) -> DataFrame:
        steps = self.steps.read()
        kept = null_safe_join(steps, self._active(steps, per), SCRIPT, "left_semi")
        return kept.select(*STEP, "first_batch", per.contains(F.col("latest_recordid")).alias("is_new_in_period"))

    def sys_ratio(self, per: Period) -> DataFrame:
        """D10 of everything so far."""
        rows = self._result("sys_ratio").read().join(self._kept(per), STEP)
        return rows.withColumn("measurement_batch", F.col("measurement_batch") + F.col("first_batch")).drop("first_batch")

    def gpu_usage(self, per: Period) -> DataFrame:
        """D13 of everything so far."""
        return self._result("gpu_usage").read().join(self._kept(per), STEP).drop("first_batch")
