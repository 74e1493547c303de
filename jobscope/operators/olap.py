"""Published data access and exploration.

Sections are published per (period, user) as typed rows; here they are
filtered for a viewer, flattened into one wide table, filled, typed, extended
with computed columns and rolled up over seven levels.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.functions.decode import step_name, user_of_address
from jobscope.operators.reports import PROBLEMS
from jobscope.plans.joins import broadcast_if_small
from jobscope.plans.materialize import materialize

PROBLEM_NAMES = [p[1] for p in PROBLEMS]

# fixed values: the column set of the flattened table (name, type)
TEXT_COLUMNS = ["Job", "Step", "User", "Name", "Source", "Node", "App", "GPUCPUEntryType"]
NUMERIC_COLUMNS = [
    "NodeCnt", "JobLength", "TimeLimit", "PeakRssSize", "MemLimit", "GPUCPUEntryRatio", "TotGPUCPUSamples",
    "AllocCPU", "AllocGPU", "CPUInUse", "GPUInUse", "GPUID", "AvgGPUUtil", "TotGPUSamples", "CntZeroGPUUtil",
    "CntLowGPUUtil", "LongestNoGPUUtil", "AvgGPUClockMHz", "AvgGPUPowerUsageWatt", "AvgGPUTempC",
    "TotSysTimeRatioSamples", "10%~33%", "33%~66%", "66%~100%", ">100%",
]
DOUBLE_COLUMNS = {"GPUCPUEntryRatio", "AvgGPUUtil", "AvgGPUClockMHz", "AvgGPUPowerUsageWatt", "AvgGPUTempC", ">100%"}

# fixed values: computed columns of the exploration view (name, numerator, denominator, factor)
EXPRESSIONS = [
    ("JobLengthHour", "JobLength", None, 1 / 3600),
    ("TimeLimitHour", "TimeLimit", None, 1 / 60),
    ("MemLimitMB", "MemLimit", None, 1 / (1024 * 1024)),
    ("PeakRssSizeMB", "PeakRssSize", None, 1 / (1024 * 1024)),
    ("PeakMemUsage%", "PeakRssSize", "MemLimit", 100.0),
    ("CPUUsage%", "CPUInUse", "AllocCPU", 100.0),
    ("GPUUsage%", "GPUInUse", "AllocGPU", 100.0),
    ("ZeroGPUUtil%", "CntZeroGPUUtil", "TotGPUSamples", 100.0),
    ("LowGPUUtil%", "CntLowGPUUtil", "TotGPUSamples", 100.0),
    ("LongestNoGPUUtil%", "LongestNoGPUUtil", "TotGPUSamples", 100.0),
    ("10~33%", "10%~33%", "TotSysTimeRatioSamples", 100.0),
    ("33~66%", "33%~66%", "TotSysTimeRatioSamples", 100.0),
    ("66~100%", "66%~100%", "TotSysTimeRatioSamples", 100.0),
    ("Ratios >100%", ">100%", "TotSysTimeRatioSamples", 100.0),
]

# fixed values: rollup levels and per-column aggregates of the exploration view
ROLLUP_LEVELS = ["Period", "User", "Name", "Job", "Step", "Source", "Node"]
AVG_COLUMNS = [
    "NodeCnt", "JobLengthHour", "TimeLimitHour", "Low Concurrency", "Low Compute Power", "Jupyter Detected",
    "Memory Oversubscribe", "Memory Underusage", "PeakMemUsage%", "MemLimitMB", "CPU Underusage", "AllocCPU",
    "Completely No Util", "GPU Underusage", "AllocGPU", "AvgGPUUtil", "ZeroGPUUtil%", "LowGPUUtil%",
    "LongestNoGPUUtil%", "Investigate GPU Usage", "Try Splitting", "AvgGPUClockMHz", "AvgGPUPowerUsageWatt",
    "AvgGPUTempC", "System Time Ratio", "10~33%", "33~66%", "66~100%", "Ratios >100%",
]
WEIGHTED_COLUMNS = [("CPUUsage%", "GPUCPUEntryRatio"), ("GPUUsage%", "GPUCPUEntryRatio")]
JOIN_COLUMNS = ["App"]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# ---- F1 / F2 / F10 ------------------------------------------------------------
def list_periods(pub: DataFrame, viewer: str | None = None, admin: bool = False) -> DataFrame:
    """Periods (started, updated) with rows visible to ``viewer``; admins see all."""
    rows = pub if admin else pub.where(F.col("user") == user_of_address(F.lit(viewer)))
    return rows.groupBy("period").agg(F.min("started").alias("started"), F.max("updated").alias("updated"))


def fetch_data(pub: DataFrame, periods: Iterable[int | Column], viewer: str | None = None, admin: bool = False,
               sections: Iterable[str] | None = None) -> DataFrame:
    """Rows of the requested periods (partition-pruned), the viewer's own unless admin."""
    rows = pub.where(reduce(lambda a, b: a | b, [F.col("period") == p for p in periods], F.lit(False)))
    if not admin:
        rows = rows.where(F.col("user") == user_of_address(F.lit(viewer)))
    if sections is not None:
        rows = rows.where(F.col("section").isin(list(sections)))
    return rows


def missing_periods(pub: DataFrame, periods: Iterable[int | Column]) -> DataFrame:
    """Requested periods that were never published."""
    literals = [(p if isinstance(p, Column) else F.lit(int(p))).cast("bigint") for p in periods]
    want = pub.sparkSession.range(1).select(F.explode(F.array(*literals)).alias("period")).distinct()
    return want.join(pub.select("period").distinct(), "period", "left_anti")


# ---- F3 -----------------------------------------------------------------------
def dedupe_sections(sections: DataFrame, keys: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Store identical text once: (content_id, text) and (keys..., content_id)."""
    with_id = sections.withColumn("content_id", F.sha2(F.col(text), 256))
    contents = with_id.select("content_id", text).dropDuplicates(["content_id"])
    refs = with_id.select(*keys, "content_id")
    return contents, refs


# ---- F4 + F5 --------------------------------------------------------------------
def flatten(period: Column, sections: dict[str, DataFrame]) -> DataFrame:
    """One wide row per section entry with Period, User, Source, Name and labels.

    ``sections`` are the export frames (E13-E19) keyed by section name; Name
    comes from the JobInfo section of the same (period, user, job).
    """
    names = sections["JobInfo"].groupBy("user", "Job").agg(F.max("Name").alias("__name"))
    parts = []
    for src, df in sections.items():
        d = df
        if src == "Problems":
            d = d.select("user", "Job", "Step", *[
                F.when(F.array_contains(F.map_keys("Problems"), p), F.lit(100)).alias(p) for p in PROBLEM_NAMES])
        if src != "JobInfo":
            d = d.join(broadcast_if_small(names), ["user", "Job"], "left").withColumnRenamed("__name", "Name")
        d = d.withColumn("Source", F.lit(src))
        parts.append(d)
    flat = parts[0]
    for p in parts[1:]:
        flat = flat.unionByName(p, allowMissingColumns=True)
    cols = []
    for c in TEXT_COLUMNS:
        if c == "User":
            cols.append(F.col("user").alias("User"))
        elif c == "Job":
            cols.append(F.col("Job").cast("string").alias("Job"))
        elif c == "Step":
            cols.append(step_name(F.col("Step")).alias("Step"))
        else:
            cols.append(_c(c).cast("string").alias(c) if c in flat.columns else F.lit(None).cast("string").alias(c))
    for c in NUMERIC_COLUMNS:
        t = "double" if c in DOUBLE_COLUMNS else "bigint"
        v = _c(c).cast(t) if c in flat.columns else F.lit(None).cast(t)
        if c == "JobLength":
            v = F.when(v >= 0, v)
        cols.append(v.alias(c))
    for p in PROBLEM_NAMES:
        cols.append(_c(p).cast("bigint").alias(p) if p in flat.columns else F.lit(None).cast("bigint").alias(p))
    out = flat.select(period.cast("bigint").alias("Period"), *cols,
                      F.col("Step").isNull().alias("__job_level"))
    return fill_problems(out)


def fill_problems(flat: DataFrame) -> DataFrame:
    """In Problems rows: absent problem = 0 if a row of the same level (job or
    step) in the period has it, else NULL (filled strictly per period)."""
    probs = flat.where(F.col("Source") == "Problems")
    seen = probs.groupBy("Period", "__job_level").agg(
        *[F.max(_c(p).isNotNull()).alias(f"__seen{i}") for i, p in enumerate(PROBLEM_NAMES)])
    x = flat.join(broadcast_if_small(seen), ["Period", "__job_level"], "left")
    is_p = F.col("Source") == "Problems"
    sel = []
    for c in x.columns:
        if c.startswith("__"):
            continue
        if c in PROBLEM_NAMES:
            i = PROBLEM_NAMES.index(c)
            sel.append(F.when(is_p & _c(c).isNull() & F.coalesce(F.col(f"__seen{i}"), F.lit(False)), F.lit(0))
                       .otherwise(_c(c)).cast("bigint").alias(c))
        else:
            sel.append(_c(c))
    return x.select(*sel)


# ---- F6 -----------------------------------------------------------------------
def promote_types(flat: DataFrame) -> dict[str, str]:
    """'integer' unless a non-integer or a value > 2^31-1 appears, then 'float'.

    One aggregate pass; returns column -> type for the numeric columns."""
    num = [f.name for f in flat.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not num:
        return {}
    row = flat.agg(*[F.max(F.when(_c(c).isNotNull() & ((_c(c) != F.floor(_c(c))) | (_c(c) > 2147483647)), 1)
                           .otherwise(0)).alias(str(i)) for i, c in enumerate(num)]).first()
    return {c: ("float" if row[str(i)] else "integer") for i, c in enumerate(num)}


# ---- F7 ---------------------------------------------------------------------------
def with_expressions(flat: DataFrame) -> DataFrame:
    cols = []
    for name, num, den, factor in EXPRESSIONS:
        x = _c(num).cast("double")
        if den is None:
            cols.append((x * factor).alias(name))
        else:
            cols.append((F.try_divide(x, _c(den).cast("double")) * factor).alias(name))
    return flat.select("*", *cols)


# ---- F9 ---------------------------------------------------------------------------
def prune_config(schema: T.StructType) -> dict[str, list]:
    """Expressions / aggregates whose inputs are present in ``schema``."""
    have = set(schema.fieldNames())
    exprs = [e for e in EXPRESSIONS if e[1] in have and (e[2] is None or e[2] in have)]
    names = have | {e[0] for e in exprs}
    return {
        "expressions": exprs,
        "avg": [c for c in AVG_COLUMNS if c in names],
        "weighted": [(c, w) for c, w in WEIGHTED_COLUMNS if c in names and w in names],
        "join": [c for c in JOIN_COLUMNS if c in names],
        "levels": [c for c in ROLLUP_LEVELS if c in names],
    }


# ---- F8 ---------------------------------------------------------------------------
def rollup_report(flat: DataFrame, depth: int | None = None) -> DataFrame:
    """Seven-level rollup; each level aggregates the leaf rows.

    Leaves are summed once and stored, a job's together; every level is then grouped from the
    sums and counts of the level below it (a task has most of a group's rows, so that about a
    row a group is shuffled, and the leaves themselves not again).  ``grouping_id`` tells subtotal rows from
    NULL keys; ``depth`` keeps levels up to that depth (1 = periods only)."""
    x = with_expressions(flat)
    cfg = prune_config(x.schema)
    names = cfg["levels"]
    levels = [_c(c) for c in names]
    leaf, sums, top = [], [], []

    def ratio(name: str, numerator: Column, denominator: Column) -> None:
        n, d = f"__n{len(top)}", f"__d{len(top)}"
        leaf.extend([F.sum(numerator).alias(n), F.sum(denominator).alias(d)])
        sums.extend([F.sum(n).alias(n), F.sum(d).alias(d)])
        top.append(F.try_divide(n, d).alias(name))

    for c in cfg["avg"]:
        ratio(c, _c(c).cast("double"), _c(c).isNotNull().cast("double"))
    for c, w in cfg["weighted"]:
        ratio(c, _c(c).cast("double") * _c(w), F.when(_c(c).isNotNull(), _c(w).cast("double")))
    for c in cfg["join"]:
        # distinct application names per group: bounded by the installed applications
        leaf.append(F.collect_set(_c(c)).alias(f"__{c}"))
        sums.append(F.array_distinct(F.flatten(F.collect_set(f"__{c}"))).alias(f"__{c}"))
        top.append(F.when(F.size(f"__{c}") > 0, F.array_join(F.array_sort(f"__{c}"), ", ")).alias(c))
    job = [_c(c) for c in names[:4]]
    leaves = x.groupBy(*levels).agg(*leaf)
    leaves = materialize(leaves.repartition(*job) if job else leaves, "leaves", names)
    depth = len(names) if depth is None else min(depth, len(names))
    out, rows = None, leaves
    for n in range(len(names), -1, -1):
        group = F.lit((1 << (len(names) - n)) - 1).cast("bigint").alias("grouping_id")
        if n < len(names):
            rows = rows.drop("grouping_id").groupBy(*levels[:n], group).agg(*sums)
            rows = materialize(rows, "level", names[:n]) if n >= 4 else rows  # the steps' and jobs' own; few rows above
        else:
            rows = rows.withColumn("grouping_id", group)
        if n <= depth:
            part = rows.select(*levels[:n], *[F.lit(None).cast(x.schema[c].dataType).alias(c) for c in names[n:]], "grouping_id", *top)
            out = part if out is None else out.unionByName(part)
    return out
