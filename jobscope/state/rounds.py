"""Rounds of the analysis with durable high-water marks (S5), and record ids that are reserved for good.

A round is announced (*intent*: the range it works on, fixed for good), works and publishes, and is then committed.  If
it dies, it is run again under its number: the announced range is taken up again, whatever has arrived since, and the
publication overwrites the same period.  A committed round is not run twice.  The mark only moves when a round has
closed its period; until then the next round starts where this one did, so a period is analysed anew as it grows.

Both ledgers are one small Parquet row a round, written in one job each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.plans.scan import ordered_scan
from jobscope.session import scan_chunk


class Ledger:
    """One row a round under ``path``; a round's row is written once or overwritten by itself."""

    def __init__(self, spark: SparkSession, path: str, fields: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"{fields}, round long"
        spark.createDataFrame([], self.schema).write.mode("ignore").partitionBy("round").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def put(self, row: dict) -> None:
        self.spark.createDataFrame([row], self.schema).coalesce(1).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(self.path)

    def get(self, round_: int) -> dict | None:
        found = self.rows().where(F.col("round") == round_).first()
        return found.asDict() if found else None


@dataclass(frozen=True)
class Round:
    """What a round works on: records in ``(offset_start, offset_end]``; whether it closes the period."""
    round: int
    offset_start: int
    offset_end: int
    period_started: int
    closes: bool


_ROUND_FIELDS = "offset_start long, offset_end long, period_started long, closes boolean"


class HighWaterMarks:
    def __init__(self, spark: SparkSession, path: str, period_seconds: int):
        self.period_seconds = period_seconds
        self.intents = Ledger(spark, f"{path}/intents", _ROUND_FIELDS)
        self.commits = Ledger(spark, f"{path}/commits", _ROUND_FIELDS)

    def announce(self, round_: int, measurements: DataFrame, now: int) -> Round:
        """The round's range: as announced before, or from the mark to the newest record."""
        known = self.intents.get(round_)
        if known is None:
            mark, started = 0, now
            closed = self.commits.rows().where("closes").agg(F.max("offset_end").alias("mark")).first()
            mark = closed.mark or 0
            open_since = self.commits.rows().where(F.col("offset_start") == mark).agg(F.min("period_started").alias("t")).first().t
            started = now if open_since is None else open_since
            newest = measurements.agg(F.max("recordid")).first()[0]
            known = {"round": round_, "offset_start": mark, "offset_end": max(newest or mark, mark), "period_started": started,
                     "closes": now - started >= self.period_seconds}
            self.intents.put(known)
        return Round(**{k: known[k] for k in Round.__annotations__})

    def run(self, round_: int, measurements: DataFrame, now: int, publish: Callable[[Round], None]) -> tuple[Round, bool]:
        """Announce, publish and commit; the round, and whether it was run (False: it had been committed)."""
        done = self.commits.get(round_)
        if done is not None:
            return Round(**{k: done[k] for k in Round.__annotations__}), False
        own = self.announce(round_, measurements, now)
        publish(own)
        self.commits.put(asdict(own))
        return own, True


class RecordIds:
    """Dense record ids: every round reserves as many as it has new rows, behind those of all rounds before."""

    def __init__(self, spark: SparkSession, path: str):
        self.ranges = Ledger(spark, path, "first_id long, n long")

    def next_id(self, round_: int) -> int:
        """The id behind those of all rounds before."""
        return self.ranges.rows().where(F.col("round") < round_).agg(F.max(F.col("first_id") + F.col("n"))).first()[0] or 1

    def reserve(self, round_: int, n: int) -> int:
        """First id of the round's range; the same for a round that is run again."""
        known = self.ranges.get(round_)
        if known is None:
            known = {"round": round_, "first_id": self.next_id(round_), "n": n}
            self.ranges.put(known)
        if known["n"] != n:
            raise ValueError(f"round {round_} reserved {known['n']} record ids and now asks for {n}")
        return known["first_id"]

    def number(self, round_: int, rows: DataFrame, order: list[str], place: str | None = None) -> DataFrame:
        """``rows`` (stored or cached) with ``recordid``: the round's ids in ``order``, whose first column is a number and
        which has no ties.

        ``place`` counts the rows of each value of ``order`` (then one column, with some values per task that stored the
        rows) from 1 on: only these values are put in order, and no row moves."""
        if place is not None:
            runs = rows.groupBy(*order).agg(F.count(F.lit(1)).alias("__n"))
            first = self.reserve(round_, runs.agg(F.sum("__n")).first()[0] or 0)
            before = ordered_scan(runs, [], order, [("__before", "sum_excl", "__n")], scan_chunk(rows.sparkSession), persist=False) \
                .select(*order, F.coalesce("__before", F.lit(0)).alias("__before"))
            return rows.join(F.broadcast(before), order) \
                .withColumn("recordid", (F.col("__before") + F.col(place) + (first - 1)).cast("long")).drop("__before")
        first = self.reserve(round_, rows.count())
        seen = ordered_scan(rows, [], order, [("__place", "sum_incl", F.lit(1))], scan_chunk(rows.sparkSession))
        return seen.withColumn("recordid", (F.col("__place") + (first - 1)).cast("long")).drop("__place")


def in_range(own: Round, position: Column) -> Column:
    return (position > own.offset_start) & (position <= own.offset_end)
