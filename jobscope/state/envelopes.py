"""Scrape envelopes as a stream into several tables, exactly once (S1 with A3-A6).

One micro-batch of nested envelopes becomes measurements and GPU rows (stored by epoch, with record ids reserved for the
epoch), and changes of two keyed tables: the applications of steps (a set) and the CPUs of steps (the first report
stays).  The epoch's commit comes last.  A micro-batch that is handed over again, whole or after some of its tables were
written, gives the same ids, overwrites its own partitions, finds its keyed changes made, and is committed once; readers
see committed epochs only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.operators.core import null_safe_join
from jobscope.plans.materialize import materialize
from jobscope.sources import ingest as A
from jobscope.state.keyed import KeyedTable
from jobscope.state.rounds import Ledger, RecordIds

MEASUREMENT_SCHEMA = ", ".join(f"{c} long" for c in (
    "recordid", "watcherid", "jobid", "stepid", "dev_in", "dev_out", "user_sec", "user_usec", "sys_sec", "sys_usec", "res_size",
    "minor_pagefault", "gpu_measurement_batch"))
GPU_SCHEMA = ("watcherid long, batch long, pid long, jobid long, stepid long, gpuid long, age long, power_usage long, temperature long, "
              "sm_clock long, util long, clock_limit_reason string, source string")
CPU_KEYS = ["watcherid", "jobid", "stepid"]


class EnvelopeTables:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        self.ids = RecordIds(spark, f"{self.path}/ids")
        self.commits = Ledger(spark, f"{self.path}/commits", "n long")
        self.applications = KeyedTable(spark, f"{self.path}/applications", ["jobid", "stepid", "application"],
                                       "jobid long, stepid long, application string", buckets)
        self.cpus = KeyedTable(spark, f"{self.path}/cpus", CPU_KEYS, "watcherid long, jobid long, stepid long, ncpu long", buckets)
        self.by_epoch = {"measurements": MEASUREMENT_SCHEMA, "gpu": GPU_SCHEMA}
        for name, schema in self.by_epoch.items():
            spark.createDataFrame([], f"{schema}, epoch long").write.mode("ignore").partitionBy("epoch").parquet(f"{self.path}/{name}")

    def _put(self, name: str, rows: DataFrame, epoch: int) -> None:
        rows.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{self.path}/{name}")

    def take_in(self, envelopes: DataFrame, epoch: int) -> bool:
        """One micro-batch, younger (by ``seq``) than all before; False if it is committed already."""
        if self.commits.get(epoch) is not None:
            return False
        batch = materialize(envelopes, "envelopes")
        n = batch.agg(F.sum(F.coalesce(F.size("scrape_results"), F.lit(0)))).first()[0] or 0
        first = self.ids.reserve(epoch, n)
        results = materialize(A.numbered_results(batch, first), "results")  # both tables come from one numbering
        self._put("measurements", A.scrape_measurements(batch, results=results), epoch)
        self._put("gpu", A.scrape_gpu_measurements(batch, results=results), epoch)
        self.applications.merge(A.application_usage_of(batch), epoch, lambda old, new: old.unionByName(new).distinct())
        self.cpus.merge(A.cpu_available(batch), epoch,
                        lambda old, new: old.unionByName(null_safe_join(new, old.select(*CPU_KEYS), CPU_KEYS, "left_anti")))
        self.commits.put({"round": epoch, "n": n})
        return True

    def read(self, name: str) -> DataFrame:
        """The rows of the committed epochs: ``measurements``, ``gpu``, ``applications`` or ``cpus``."""
        if name in ("applications", "cpus"):
            return getattr(self, name).read()
        done = [r.round for r in self.commits.rows().select("round").collect()]
        return self.spark.read.schema(f"{self.by_epoch[name]}, epoch long").parquet(f"{self.path}/{name}") \
            .where(F.col("epoch").isin(done)).drop("epoch")


def run_envelopes(stream: DataFrame, tables: EnvelopeTables, checkpoint: str) -> None:
    """Run a stream of envelopes to its end."""
    stream.writeStream.foreachBatch(lambda batch, epoch: tables.take_in(batch, epoch)) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
