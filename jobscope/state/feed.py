"""A change feed over published periods (A18 as a stream).

A file stream does not see that a partition was overwritten.  Here every publication of a period is a version of its
own, written beside the others and then entered in a ledger under the next number; a consumer keeps the number up to
which it has read, and takes the newest version of every period that was published since, each renewal once.  A
publication that dies before its entry is not seen and is overwritten by the next one of its number; a consumer that dies
before its commit is given the same changes again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.state.rounds import Ledger


class PeriodFeed:
    """Rows of ``schema`` by period; ``round`` of the ledgers is the number of a publication or of a poll."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.entries = Ledger(spark, f"{self.path}/entries", "period long, version long")
        fields = T.StructType.fromDDL(schema).fields
        self.schema = T.StructType([*fields, T.StructField("period", T.LongType()), T.StructField("version", T.LongType())])
        spark.createDataFrame([], self.schema).write.mode("ignore").partitionBy("period", "version").parquet(f"{self.path}/rows")

    def publish(self, period: int, rows: DataFrame) -> int:
        """Publish a period's rows anew; its version."""
        entries = self.entries.rows()
        number = (entries.agg(F.max("round")).first()[0] or 0) + 1
        version = (entries.where(F.col("period") == period).agg(F.max("version")).first()[0] or 0) + 1
        rows.withColumns({"period": F.lit(period).cast("long"), "version": F.lit(version).cast("long")}).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("period", "version").parquet(f"{self.path}/rows")
        self.entries.put({"round": number, "period": period, "version": version})
        return version

    def rows(self) -> DataFrame:
        """All rows of all versions, entered or not."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def newest(self, after: int = 0, upto: int | None = None) -> list[tuple[int, int]]:
        """(period, version) of the periods published under numbers in ``(after, upto]``, each with its newest version."""
        entries = self.entries.rows().where(F.col("round") > after)
        entries = entries if upto is None else entries.where(F.col("round") <= upto)
        return [(r.period, r.v) for r in entries.groupBy("period").agg(F.max("version").alias("v")).orderBy("period").collect()]

    def of(self, versions: list[tuple[int, int]]) -> DataFrame:
        """The rows of some versions; only their folders are read."""
        wanted = F.lit(False)
        for period, version in versions:
            wanted = wanted | ((F.col("period") == period) & (F.col("version") == version))
        return self.rows().where(wanted)


class Consumer:
    """Reads a feed's changes, each once."""

    def __init__(self, feed: PeriodFeed, path: str):
        self.feed = feed
        self.offsets = Ledger(feed.spark, path, "upto long")

    def poll(self, take: Callable[[DataFrame], None]) -> list[tuple[int, int]]:
        """Hand over what has been published since the last poll, and commit; the (period, version)s taken."""
        last = self.offsets.rows().agg(F.max("round").alias("n"), F.max("upto").alias("upto")).first()
        upto = self.feed.entries.rows().agg(F.max("round")).first()[0] or 0
        changes = self.feed.newest(last.upto or 0, upto)
        if changes:
            take(self.feed.of(changes))
            self.offsets.put({"round": (last.n or 0) + 1, "upto": upto})
        return changes
