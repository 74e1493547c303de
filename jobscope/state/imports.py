"""Accounting and scrape rows imported in rounds, with record ids that stay (A2, A3, A7, A14 together).

A round's rows come in one order of arrival: the accounting rows by (jobid, stepid), then the scrape results as they
came.  An accounting row whose (job, step) has an accounting row already takes that one's place and id, if it passes the
quality gate.  All other rows go through the gate behind everything stored before, and those accepted get the next dense
ids in order of arrival (:class:`jobscope.state.rounds.RecordIds`).  A round is stored as one partition and committed;
run again before its commit it gives the same rows and ids, after it does nothing.

What is stored, the accounting rows and the scrape results of a round meet in one exchange, by ranges of (jobid, stepid).
There they are looked up and judged, and the accepted ones are stored in the order of the ranges, so that dense ids only
need the number of rows in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.plans.joins import BROADCAST_LIMIT
from jobscope.plans.materialize import materialize
from jobscope.plans.scan import crowded_keys, keep_rows, ordered_scan
from jobscope.session import scan_chunk
from jobscope.sources.ingest import latest_global_record, quality_gate, scrape_measurements
from jobscope.state.rounds import Ledger, RecordIds

L = "bigint"
COLUMNS = ["recordid", "watcherid", "jobid", "stepid", "dev_in", "dev_out", "user_sec", "user_usec", "sys_sec", "sys_usec",
           "res_size", "minor_pagefault", "gpu_measurement_batch"]
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS) + ", replaces boolean"
STEP = ["jobid", "stepid"]
CARRIED = COLUMNS[1:]
# record ids of one bitmap, and its bytes
BITMAP_IDS, BITMAP_BYTES = 1 << 15, 1 << 12
# rows that a task sorts at most, unless one step has more
TASK_ROWS = 1 << 20
# the run of the scrape results, behind those of the accounting rows (one a task)
LAST_RUN = 1 << 32


def total_time() -> F.Column:
    return F.col("user_sec") * 1000000 + F.col("user_usec") + F.col("sys_sec") * 1000000 + F.col("sys_usec")


class MeasurementStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.ids = RecordIds(spark, f"{self.path}/ids")
        self.commits = Ledger(spark, f"{self.path}/commits", "n long, renewed long")
        spark.createDataFrame([], f"{SCHEMA}, round long").write.mode("ignore").partitionBy("round").parquet(f"{self.path}/rows")

    def read(self, before: int | None = None) -> DataFrame:
        """The committed rows (of the rounds before ``before``): of a replaced record the last one."""
        renewed = {r.round: r.renewed for r in self.commits.rows().collect() if before is None or r.round < before}
        rows = self.spark.read.schema(f"{SCHEMA}, round long").parquet(f"{self.path}/rows").where(F.col("round").isin(list(renewed)))
        last = max((r for r, n in renewed.items() if n), default=None)
        if last is None or last == min(renewed):
            return rows.select(*COLUMNS)
        old = self._not_replaced(rows.where(F.col("round") < last), rows.where("replaces").select("recordid", "round"), renewed)
        return old.select(*COLUMNS).unionByName(rows.where(F.col("round") >= last).select(*COLUMNS))

    def _not_replaced(self, rows: DataFrame, replaced: DataFrame, renewed: dict[int, int]) -> DataFrame:
        """``rows`` without those that a later round has replaced.  Ids are dense, so a bitmap of those that a round has
        replaced is small: as long as all are, they are sent to the rows, else both meet in an exchange."""
        most = self.ids.next_id(max(renewed) + 1) // BITMAP_IDS + 1
        if sum(min(n, most) for n in renewed.values()) * BITMAP_BYTES > BROADCAST_LIMIT:
            r = replaced.select(F.col("recordid").alias("r_id"), F.col("round").alias("r_round"))
            return rows.join(r, (F.col("recordid") == F.col("r_id")) & (F.col("r_round") > F.col("round")), "left_anti")
        bits = replaced.groupBy(F.bitmap_bucket_number("recordid").alias("r_bucket"), F.col("round").alias("r_round")) \
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("recordid")).alias("r_bits"))
        bit = F.bitmap_bit_position("recordid")
        octet = F.conv(F.hex(F.substring("r_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        is_set = F.floor(octet / F.pow(F.lit(2), bit % 8)) % 2 == 1
        return rows.join(F.broadcast(bits), (F.bitmap_bucket_number("recordid") == F.col("r_bucket")) & (F.col("r_round") > F.col("round"))
                         & is_set, "left_anti")

    def import_round(self, round_: int, accounting: DataFrame, envelopes: DataFrame, watcher: DataFrame) -> bool:
        """Take in one round: ``accounting`` rows (A2, one a job and step) and scrape ``envelopes`` (their ``seq`` rises over
        the rounds)."""
        if self.commits.get(round_) is not None:
            return False
        first = self.ids.next_id(round_)
        stored, is_new, scraped = self.read(before=round_), F.col("arrival") >= first, F.col("arrival") > first
        steps = envelopes.select(F.explode("scrape_results").alias("r")).select(*[F.col(f"r.{c}").cast(L).alias(c) for c in STEP])
        steps = stored.select(*STEP).unionByName(accounting.select(*STEP)).unionByName(steps)
        crowded, total = crowded_keys(steps, STEP, scan_chunk(self.spark))
        rows = self._arrivals(stored, accounting, envelopes, first)
        split = not crowded.isEmpty()  # scans that split steps read their rows several times
        rows = keep_rows(rows) if split else self._by_ranges(rows, total)
        rows = rows.withColumn("recordid", F.when(~is_new, F.col("arrival")))
        rows = latest_global_record(rows, watcher, beside="arrival", sizes=crowded)
        rows = keep_rows(rows) if split else rows
        rows = rows.withColumn("replaces", (F.col("arrival") == first) & F.col("latest_global_recordid").isNotNull())
        accepted = quality_gate(rows, watcher, order="arrival", unseen="replaces", sizes=crowded).where(is_new)
        accepted = accepted.withColumn("recordid", F.when(F.col("replaces"), F.col("latest_global_recordid"))) \
            .select(*COLUMNS, "arrival", "replaces", (~F.col("replaces") & ~scraped).alias("fresh"))
        accepted = self._in_order(accepted, total)
        fresh = accepted.where("fresh")
        late = ordered_scan(accepted.where(scraped).drop("run", "place"), [], ["arrival"], [("place", "sum_incl", F.lit(1))],
                            scan_chunk(self.spark), persist=False).withColumn("run", F.lit(LAST_RUN).cast(L))
        numbered = self.ids.number(round_, fresh.unionByName(late), ["run"], place="place") \
            .withColumn("gpu_measurement_batch", F.when(F.col("gpu_measurement_batch").isNotNull(), F.col("recordid")))
        renewed = accepted.where("replaces")
        rows = numbered.unionByName(renewed).select(*COLUMNS, "replaces")
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/round={round_}", compression="zstd")
        self.commits.put({"round": round_, "n": self.ids.ranges.get(round_)["n"], "renewed": renewed.count()})
        return True

    def _arrivals(self, stored: DataFrame, accounting: DataFrame, envelopes: DataFrame, first: int) -> DataFrame:
        """What is stored and what is new, with ``arrival``, which orders the rows of a step: stored rows by their ids, then
        the accounting row, then the scrape results.  Of stored rows only what the gate looks at is carried."""
        null = F.lit(None).cast(L)
        judged = {"watcherid": F.col("watcherid"), **{c: F.col(c) for c in STEP}, "user_sec": F.lit(0).cast(L), "user_usec": total_time(),
                  "sys_sec": F.lit(0).cast(L), "sys_usec": F.lit(0).cast(L)}
        there = stored.select(F.col("recordid").alias("arrival"), *[judged.get(c, null).alias(c) for c in CARRIED])
        mine = accounting.where(F.col("jobid").isNotNull()).select(F.lit(first).cast(L).alias("arrival"), *CARRIED)
        scraped = scrape_measurements(envelopes, first_recordid=first + 1).select(F.col("recordid").alias("arrival"), *CARRIED)
        return there.unionByName(mine).unionByName(scraped)

    def _by_ranges(self, rows: DataFrame, total: int) -> DataFrame:
        """``rows`` (``total`` at most) dealt by ranges of steps, so many that a task sorts them in memory."""
        tasks = -(-total // TASK_ROWS)
        more = tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartitionByRange(tasks, *STEP) if more else rows.repartitionByRange(*STEP)

    def _in_order(self, accepted: DataFrame, total: int) -> DataFrame:
        """``accepted``, stored: of the fresh accounting rows every task stores a ``run`` of the order of (jobid, stepid), in
        which ``place`` counts them from 1 on.  Should the runs overlap (steps were split, or Spark has dealt the rows anew
        by something else), the rows are dealt by ranges once more."""
        stored = self._stored_by_runs(accepted)
        step = F.struct(*STEP)
        runs = stored.where("fresh").groupBy("run").agg(F.min(step).alias("lo"), F.max(step).alias("hi")).collect()
        runs = [[tuple((x is not None, x or 0) for x in end) for end in (r.lo, r.hi)] for r in sorted(runs, key=lambda r: r.run)]
        if any(a[1] > b[0] for a, b in zip(runs, runs[1:])):
            stored = self._stored_by_runs(self._by_ranges(stored.drop("run", "place"), total))
        return stored

    def _stored_by_runs(self, rows: DataFrame) -> DataFrame:
        at = F.monotonically_increasing_id()  # partition number and place within it
        rows = rows.sortWithinPartitions(F.col("fresh").desc(), *STEP) \
            .withColumn("run", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND((1 << 33) - 1) + 1)
        return materialize(rows, "accepted", compression="zstd")
