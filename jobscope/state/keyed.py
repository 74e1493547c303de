"""Tables that change by key, kept as Parquet.

Rows are dealt to buckets by a hash of their key.  A change (an *epoch*: a micro-batch or a round) writes anew only the
buckets that it touches, and then one small commit that says which; a bucket's rows are those of the last committed
epoch that wrote it.  A change that was not committed leaves nothing behind that a reader sees, and is simply made
again; a change whose epoch is committed is not made twice.  So changes are exactly once under retries, and a reader
that began before a commit goes on reading the files it began with.

The number of buckets is fixed for a table; choose it so that a bucket is some 128 MB.  Only the commits (one row a
touched bucket) pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT_SCHEMA = "bucket int, epoch long"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType | str, buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        # the folders exist from the start, so that an empty table can be read
        spark.createDataFrame([], self._stored()).write.mode("ignore").partitionBy("epoch", "bucket").parquet(f"{self.path}/rows")
        spark.createDataFrame([], COMMIT_SCHEMA).write.mode("ignore").partitionBy("epoch").parquet(f"{self.path}/commits")

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("epoch", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def commits(self) -> DataFrame:
        """``bucket, epoch``: what every committed epoch wrote (bucket -1: that it was made)."""
        return self.spark.read.schema(COMMIT_SCHEMA).parquet(f"{self.path}/commits")

    def committed(self, epoch: int) -> bool:
        return not self.commits().where(F.col("epoch") == epoch).isEmpty()

    def _current(self, only: list[int] | None = None) -> DataFrame:
        """The rows, with their bucket; only the wanted buckets' files of their last epochs are read."""
        last = self.commits().where("bucket >= 0").groupBy("bucket").agg(F.max("epoch").alias("epoch")).collect()  # a row a bucket
        by_epoch: dict[int, list[int]] = {}
        for row in last:
            if only is None or row.bucket in only:
                by_epoch.setdefault(row.epoch, []).append(row.bucket)
        read = self.spark.read.schema(self._stored()).parquet(f"{self.path}/rows")
        wanted = [(F.col("epoch") == e) & F.col("bucket").isin(sorted(b)) for e, b in sorted(by_epoch.items())]
        return read.where(reduce(lambda a, b: a | b, wanted, F.lit(False))).drop("epoch")

    def read(self) -> DataFrame:
        return self._current().drop("bucket")

    def beside(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that hold ``keys``: theirs, and some others."""
        touched = [r.bucket for r in self._bucket(keys).select("bucket").distinct().collect()]
        return self._current(touched).drop("bucket")

    def merge(self, changes: DataFrame, epoch: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Make one change: ``combine(rows of the touched buckets, changes)`` gives those buckets' new rows.

        ``combine`` must keep rows of other keys as they are.  Returns False, and does nothing, if the epoch is
        committed already.  ``changes`` is read twice (touched buckets, then the rows), so it should be stored or
        cached; it need not have all columns of the table, only the key."""
        if self.committed(epoch):
            return False
        touched = sorted(r.bucket for r in self._bucket(changes).select("bucket").distinct().collect())
        if touched:
            columns = self.schema.fieldNames()
            rows = self._bucket(combine(self._current(touched).drop("bucket"), changes).select(*columns))
            # a bucket without rows left has no file, and that is what its commit then says
            rows.withColumn("epoch", F.lit(epoch).cast("long")).repartition("bucket").write.mode("overwrite") \
                .option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "bucket").parquet(f"{self.path}/rows")
        done = [(b, epoch) for b in touched or [-1]]
        self.spark.createDataFrame(done, COMMIT_SCHEMA).coalesce(1).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{self.path}/commits")
        return True

    def replace(self, keys: DataFrame, rows: DataFrame, epoch: int) -> bool:
        """Make one change: all rows of the changed ``keys`` go, and ``rows`` (of these keys) come in their place."""
        def instead(old: DataFrame, changed: DataFrame) -> DataFrame:
            same = [old[k].eqNullSafe(changed[k]) for k in self.keys]
            kept = old.join(changed, reduce(lambda a, b: a & b, same), "left_anti")
            return kept.unionByName(rows.select(*self.schema.fieldNames()))
        return self.merge(keys.select(*self.keys).distinct(), epoch, instead)
