"""Runs of equal values in series that arrive batch by batch (S7): watcher sessions (D4), idle runs.

A piece of a series is summed up by its runs, of which only the first and the last can go on beyond its edges.  Two
neighbouring pieces merge by joining the last run of one to the first of the other where their values are equal, which is
associative.  It is used twice:

* within a batch, a key's rows are dealt to buckets by position, so that a hot key is split over many tasks; the window
  over a whole key sees at most two runs a bucket;
* over batches, only the open (last) run of a key is kept, in a :class:`KeyedTable`; a batch continues or closes it, and
  everything before is never read again.

Every batch (epoch) writes its runs, then commits the open ones.  A batch that dies in between is made again over the
state it found, and a batch whose epoch is committed is not made twice; readers see committed epochs only.

Records of a key must arrive in the order of their positions, which are unique in a key: one that is not behind the key's
newest raises an error, as the runs that it would part are closed.  NULL is a value like others, and so is a NULL key;
an empty batch is a commit and nothing else.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.plans.joins import broadcast_if_small
from jobscope.state.keyed import KeyedTable

LATE = "a record is not behind the newest record of its key"


class RunTable:
    def __init__(self, spark: SparkSession, path: str, batch_schema, keys: list[str], value: str, order: list[str], chunk: int,
                 buckets: int = 16):
        """``batch_schema`` names the types of ``keys``, ``value`` and ``order`` (positions; the first one a number)."""
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.value, self.order, self.chunk = keys, value, order, int(chunk)
        summed = self._summed(spark.createDataFrame([], batch_schema))
        self.schema = summed.select(*[F.col(f"key.{k}").alias(k) for k in keys], "first", "last", "value", "rows",
                                    F.lit(1).cast("long").alias("number"), F.lit(True).alias("open")).schema
        self.open = KeyedTable(spark, f"{self.path}/open", keys, self.schema, buckets)

    def _summed(self, batch: DataFrame) -> DataFrame:
        """Runs of every (key, bucket): ``run`` counts them from 1, ``of`` is their number."""
        x = batch.select(F.struct(*self.keys).alias("key"), F.struct(*self.order).alias("at"), F.col(self.value).alias("value"),
                         F.coalesce(F.expr(f"`{self.order[0]}` div {self.chunk}"), F.lit(-(2 ** 63)).cast("long")).alias("part"))
        w = Window.partitionBy("key", "part").orderBy("at")
        begins = F.lag(F.lit(1)).over(w).isNull() | ~F.col("value").eqNullSafe(F.lag("value").over(w))
        runs = x.withColumn("begins", begins.cast("long")) \
                .withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
                .groupBy("key", "part", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("value").alias("value"),
                                                   F.count(F.lit(1)).alias("rows"))
        return runs.withColumn("of", F.max("run").over(Window.partitionBy("key", "part")))

    def _joined(self, runs: DataFrame, carried: DataFrame) -> DataFrame:
        """Runs of the batch's keys, merged over buckets and with the open ones of before."""
        columns = ["key", "part", "run", "of", "first", "last", "value", "rows", "carried"]
        edges = runs.where((F.col("run") == 1) | (F.col("run") == F.col("of"))).withColumn("carried", F.lit(None).cast("long"))
        before = carried.select(F.struct(*self.keys).alias("key"), F.lit(None).cast("long").alias("part"), F.lit(1).cast("long").alias("run"),
                                F.lit(1).cast("long").alias("of"), "first", "last", "value", "rows", F.col("number").alias("carried"))
        before = before.join(edges.select("key").distinct(), "key", "left_semi")
        w = Window.partitionBy("key").orderBy("first")
        x = edges.select(*columns).unionByName(before.select(*columns)) \
            .withColumn("previous", F.lag(F.struct("part", "value", "last")).over(w))
        begins = F.col("previous").isNull() | F.coalesce(F.col("part") == F.col("previous.part"), F.lit(False)) \
            | ~F.col("value").eqNullSafe(F.col("previous.value"))
        inside = F.when((F.col("run") == F.col("of")) & (F.col("of") > 1), F.col("of") - 2).otherwise(0)
        numbered = x.where(F.when(F.col("first") <= F.col("previous.last"), F.raise_error(F.lit(LATE)).cast("boolean")).otherwise(True)) \
            .withColumn("step", F.coalesce("carried", begins.cast("long") + inside)) \
            .withColumn("number", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        merged = numbered.groupBy("key", "number").agg(F.min("first").alias("first"), F.max("last").alias("last"),
                                                       F.max("value").alias("value"), F.sum("rows").alias("rows"))
        merged = merged.withColumn("open", F.col("number") == F.max("number").over(Window.partitionBy("key")))
        heads = numbered.where((F.col("run") == 1) & F.col("carried").isNull()).select("key", "part", F.col("number").alias("head"))
        inner = runs.where((F.col("run") > 1) & (F.col("run") < F.col("of"))).join(heads, ["key", "part"]) \
            .withColumn("number", F.col("head") + F.col("run") - 1).withColumn("open", F.lit(False))
        out = ["key", "first", "last", "value", "rows", "number", "open"]
        return merged.select(*out).unionByName(inner.select(*out)).select(
            *[F.col(f"key.{k}").alias(k) for k in self.keys], *out[1:])

    def take_in(self, batch: DataFrame, epoch: int) -> bool:
        """Add a batch; False, and nothing done, if its epoch is committed already."""
        if self.open.committed(epoch):
            return False
        runs = self._summed(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            carried = self.open.beside(runs.select("key.*"))
            target = f"{self.path}/runs/epoch={epoch}"
            self._joined(runs, carried).write.mode("overwrite").parquet(target)
        finally:
            runs.unpersist()
        now_open = self.spark.read.schema(self.schema).parquet(target).where("open")
        return self.open.replace(now_open, now_open, epoch)

    def read(self) -> DataFrame:
        """All runs: keys, ``first`` and ``last`` position, ``value``, ``rows``, ``number`` (from 1 in a key), ``open``."""
        done = self.open.commits().select("epoch").distinct()
        if done.isEmpty():
            return self.open.read()
        stored = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("epoch", T.LongType())])).parquet(f"{self.path}/runs")
        closed = stored.where(~F.col("open")).join(broadcast_if_small(done), "epoch", "left_semi")
        return closed.select(*self.schema.names).unionByName(self.open.read())
