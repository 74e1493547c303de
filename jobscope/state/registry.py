"""The watcher registry as an upsert table (A9 over batches; S3 with replacement).

A key's registrations, in order of arrival, keep the first id and move ``lastfetch`` on.  What a batch says about a key
is one row (its first and its last registration, and the last but one if there are two), and two such rows, one after
the other, make one: so batches merge in any grouping as long as they come in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.plans.scan import ordered_scan
from jobscope.session import scan_chunk
from jobscope.sources.ingest import watcher_registry_columns
from jobscope.state.keyed import KeyedTable

KEYS = ["jobstep_str", "target_node", "accuracy"]
FIRST = ["pid", "jobid", "stepid", "privileged", "source"]
SCHEMA = ("jobstep_str string, target_node string, accuracy int, id long, pid long, jobid long, stepid long, privileged int, "
          "source string, last_id long, lastfetch long, before long")
FIRST_LOOKBACK = 28 * 86400


def registry_table(spark: SparkSession, path: str, buckets: int = 8) -> KeyedTable:
    return KeyedTable(spark, path, KEYS, SCHEMA, buckets)


def batch_summary(registrations: DataFrame) -> DataFrame:
    """One row a key; ``before`` (the fetch before the last one) is null where the batch registers it once."""
    w = watcher_registry_columns(registrations)
    w = ordered_scan(w, KEYS, ["id"], [("before", "lag", "lastfetch")], scan_chunk(registrations.sparkSession))
    return w.groupBy(*KEYS).agg(
        F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in FIRST], F.max("id").alias("last_id"),
        F.max_by("lastfetch", "id").alias("lastfetch"), F.max_by("before", "id").alias("before"))


def merged(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Registry rows with a later batch's rows taken in."""
    columns = known.columns
    both = known.unionByName(batch.select(*columns))
    newest = F.max_by(F.struct("last_id", "lastfetch", "before"), "last_id")
    out = both.groupBy(*KEYS).agg(
        F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in FIRST], newest.alias("newest"),
        F.min_by("lastfetch", "last_id").alias("older"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.col("newest.before"), F.when(F.col("n") > 1, F.col("older")))
    return out.select(*KEYS, "id", *FIRST, "newest.last_id", "newest.lastfetch", before.alias("before"))


def register(table: KeyedTable, registrations: DataFrame, epoch: int) -> bool:
    """Take a batch in, once an epoch.  Its registrations are younger than those of all epochs before."""
    return table.merge(batch_summary(registrations), epoch, merged)


def registry(table: KeyedTable, first_lookback: int = FIRST_LOOKBACK) -> DataFrame:
    """The registry as :func:`jobscope.sources.ingest.watcher_registry` gives it for all registrations at once."""
    return table.read().withColumn("prev_lastfetch", F.coalesce("before", F.col("lastfetch") - first_lookback)).drop("before", "last_id")
