"""The quality gate over a stream, with state that expires.

Keyed by (jobid, stepid), one value holds the best accuracy so far, the largest total time accepted at it and a count of
map entries; a map holds the accepted (node, total time) at that accuracy, in chunks by total time.  A batch writes the
chunks it adds and nothing else, and a total above the largest one is new without a look into the map; only others look
into the chunks whose range holds them.  With an expiry, a timer runs from the key's newest event time: when the
watermark has passed it, the step's state goes, and a row that comes later is judged as the first one of its step.

The processor is given what it judges by, and each row's measurements as one text: conversions by key and column and
calls to the state store cost far more than the judging.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from jobscope.plans.joins import broadcast_if_small
from jobscope.sources.ingest import watcher_registry_columns
from jobscope.streaming.stream import MEASUREMENT_SCHEMA

COLUMNS = [f.name for f in MEASUREMENT_SCHEMA.fields]
JUDGED = ("recordid", "accuracy", "target_node", "tot", "row")
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
# Accepted totals that one map entry holds at most.
CHUNK_ENTRIES = 1024


class GateProcessor(StatefulProcessor):
    def __init__(self, expire_seconds: int | None):
        self.expire_ms = expire_seconds and expire_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "accuracy int, top long, chunks int")
        self.seen = handle.getMapState("seen", "number int, low long, high long", "nodes array<string>, tots array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches = list(rows)
        if self.expire_ms:
            newest = int(max(b["event_time"].max() for b in batches).timestamp() * 1000) + self.expire_ms
            others = [t for (t,) in self._timers()]
            if not others or max(others) < newest:  # the last reading counts
                for t in others:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(newest)
        recordid, accuracy, node, tot, row = ([x for b in batches for x in b[c].tolist()] for c in JUDGED)
        best, top, chunks = self.best.get() or (-1, 0, 0)
        level, first = best, {}  # first row of every (accuracy, node, total) that is as accurate as all before
        for i in sorted(range(len(recordid)), key=recordid.__getitem__):
            if tot[i] and accuracy[i] >= level:
                level = accuracy[i]
                first.setdefault((level, node[i] if isinstance(node[i], str) else None, tot[i]), i)
        doubtful = {k[1:] for k in first if k[0] == best and k[2] <= top}
        known = self._known(doubtful) if doubtful else doubtful
        fresh = [(k, i) for k, i in first.items() if k[0] != best or k[1:] not in known]
        if not fresh:
            return
        if level > best:
            if best >= 0:  # less accurate rows are refused from now on: their entries can go
                self.seen.clear()
            chunks, top = 0, None
        added = sorted(((n, t) for (a, n, t), _ in fresh if a == level), key=lambda x: x[1])
        for at in range(0, len(added), CHUNK_ENTRIES):
            nodes, tots = map(list, zip(*added[at:at + CHUNK_ENTRIES]))
            self.seen.updateValue((chunks, tots[0], tots[-1]), (nodes, tots))
            chunks += 1
        self.best.update((level, added[-1][1] if top is None else max(top, added[-1][1]), chunks))
        yield pd.DataFrame({"row": [row[i] for _, i in fresh]})

    def _known(self, doubtful: set[tuple]) -> set[tuple]:
        """Those of some (node, total) that the map holds."""
        wanted, found = sorted({t for _, t in doubtful}), set()
        for number, low, high in list(self.seen.keys()):
            at = bisect_left(wanted, low)
            if at < len(wanted) and wanted[at] <= high:
                found.update(doubtful.intersection(zip(*self.seen.getValue((number, low, high)))))
        return found

    def _timers(self) -> list[tuple[int]]:
        return [(int(t if not isinstance(t, tuple) else t[0]),) for t in self.handle.listTimers()]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.best.clear()
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def gate_stream(stream: DataFrame, watcher: DataFrame, expire_seconds: int | None = None, event_time: str = "event_time",
                delay: str = "0 seconds") -> DataFrame:
    """The rows of a measurement stream that the gate accepts.  With ``expire_seconds`` the stream has a timestamp column
    ``event_time``, and a step's state goes when it has been silent for so long by the watermark."""
    spark = stream.sparkSession
    spark.conf.set(*STATE_STORE)  # value and map state with timers live in this store
    w = watcher_registry_columns(watcher).select(F.col("id").alias("watcherid"), F.col("accuracy").cast("int").alias("accuracy"), "target_node")
    if expire_seconds:
        stream = stream.withColumnRenamed(event_time, "event_time").withWatermark("event_time", delay)
    tot = F.col("user_sec") * 1000000 + F.col("user_usec") + F.col("sys_sec") * 1000000 + F.col("sys_usec")
    judged = stream.join(broadcast_if_small(w), "watcherid").select(
        "jobid", "stepid", "recordid", "accuracy", "target_node", F.coalesce(tot, F.lit(0)).alias("tot"),
        F.array_join(F.array(*[F.col(c).cast("string") for c in COLUMNS]), ",", "").alias("row"), *(["event_time"] if expire_seconds else []))
    passed = judged.groupBy("jobid", "stepid").transformWithStateInPandas(
        GateProcessor(expire_seconds), "row string", "Append", "EventTime" if expire_seconds else "None")
    # whole numbers all, an empty one is null
    fields = passed.select(F.split("row", ",", -1).alias("f"))
    return fields.select(*[F.nullif(F.col("f")[i], F.lit("")).cast(f.dataType).alias(f.name) for i, f in enumerate(MEASUREMENT_SCHEMA.fields)])
