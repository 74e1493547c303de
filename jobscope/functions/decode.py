"""Field decoders as column expressions.

All built from Spark SQL functions (split, regexp, higher-order functions), so
they run inside whole-stage codegen on any table size; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions.text import slurm_time


# ---- B1: TRES strings ---------------------------------------------------------
def tres_map(col: Column) -> Column:
    """``"1=4,2=1000"`` -> map<int, bigint> (empty/NULL -> empty map)."""
    s = F.coalesce(col, F.lit(""))
    pairs = F.filter(F.split(s, ","), lambda p: F.instr(p, "=") > 0)
    entries = F.transform(pairs, lambda p: F.struct(
        F.substring_index(p, "=", 1).cast("int").alias("key"),
        F.substring_index(p, "=", -1).cast("bigint").alias("value")))
    return F.map_from_entries(entries)


def tres_get(m: Column, key: int) -> Column:
    """Value of one TRES id; a missing key counts as 0."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(0).cast("bigint"))


def tres_sum(df: DataFrame, keys: list[str], col: str, out: str = "tres") -> DataFrame:
    """Sum TRES maps per group: explode, aggregate per id, rebuild the map."""
    e = df.select(*keys, F.explode(F.col(col)).alias("__k", "__v"))
    s = e.groupBy(*keys, "__k").agg(F.sum("__v").alias("__v"))
    return s.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col("__k").alias("key"), F.col("__v").alias("value"))))).alias(out))


# ---- B2: host lists -------------------------------------------------------------
_HOSTLIST_EXPR = """
aggregate(
  slice(split({h}, '\\\\['), 2, size(split({h}, '\\\\[')) - 1),
  array(element_at(split({h}, '\\\\['), 1)),
  (acc, e) -> flatten(transform(acc, a -> transform(
    flatten(transform(split(substring_index(e, ']', 1), ';'), t ->
      transform(
        sequence(least(cast(element_at(split(t, '-'), 1) AS bigint),
                       cast(coalesce(try_element_at(split(t, '-'), 2), element_at(split(t, '-'), 1)) AS bigint)),
                 greatest(cast(element_at(split(t, '-'), 1) AS bigint),
                          cast(coalesce(try_element_at(split(t, '-'), 2), element_at(split(t, '-'), 1)) AS bigint))),
        i -> CASE WHEN length(cast(i AS string)) < length(element_at(split(t, '-'), 1))
                  THEN lpad(cast(i AS string), length(element_at(split(t, '-'), 1)), '0')
                  ELSE cast(i AS string) END))),
    n -> concat(a, n, CASE WHEN instr(e, ']') > 0 THEN substring_index(e, ']', -1) ELSE '' END)))))
"""


def hostlist_array(col: str) -> Column:
    """``rack7-n[08-11],login3`` -> array of node names.

    Zero padding follows the width of each range start; a reversed range is
    swapped; several brackets in one host give the cross product."""
    masked = f"regexp_replace(`{col}`, ',(?=[^\\\\[]*\\\\])', ';')"
    hosts = f"filter(split({masked}, ','), x -> x <> '')"
    return F.expr(f"flatten(transform({hosts}, h -> {_HOSTLIST_EXPR.format(h='h')}))")


def explode_hostlist(df: DataFrame, col: str, out: str = "node") -> DataFrame:
    return df.withColumn(out, F.explode(hostlist_array(col)))


# ---- B3: cpuset lists -----------------------------------------------------------
def cpuset_count(col: Column) -> Column:
    """``0-3,8`` -> 5."""
    parts = F.filter(F.split(F.coalesce(col, F.lit("")), ","), lambda p: p != "")
    sizes = F.transform(parts, lambda p: F.when(
        F.instr(p, "-") > 0,
        F.substring_index(p, "-", -1).cast("bigint") - F.substring_index(p, "-", 1).cast("bigint") + 1)
        .otherwise(F.lit(1).cast("bigint")))
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


# ---- B4: clock-limit reasons ------------------------------------------------------
# fixed values: GPU clock-limit reason bits and names, '-' when none
CLOCK_REASONS = [
    (0x01, "app"), (0x02, "idle"), (0x04, "external_power_limit"), (0x08, "hardware"),
    (0x10, "software"), (0x20, "sync"), (0x40, "temp"), (0x1000, "other"),
]
EMPTY_REASON = "-"


def clock_reasons(mask: Column) -> Column:
    """Bit mask -> comma-joined reason names ('-' for 0)."""
    table = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(n).alias("name")) for b, n in CLOCK_REASONS])
    names = F.transform(F.filter(table, lambda r: (mask.cast("bigint").bitwiseAND(r["bit"])) != 0),
                        lambda r: r["name"])
    return F.when(mask.isNull(), F.lit(None)).when(F.size(names) == 0, F.lit(EMPTY_REASON)) \
            .otherwise(F.array_join(names, ","))


def clock_mask(text: Column) -> Column:
    """Comma-joined reason names -> bit mask (inverse of :func:`clock_reasons`)."""
    parts = F.split(F.coalesce(text, F.lit(EMPTY_REASON)), ",")
    bits = F.create_map(*[x for b, n in CLOCK_REASONS for x in (F.lit(n), F.lit(b))])
    return F.aggregate(parts, F.lit(0).cast("bigint"),
                       lambda acc, p: acc.bitwiseOR(F.coalesce(F.try_element_at(bits, p), F.lit(0)).cast("bigint")))


# ---- B5: step ids ----------------------------------------------------------------
# fixed values: special step ids
STEP_NAMES = [(-3, "pending"), (-4, "extern"), (-5, "batch"), (-6, "interactive")]


def step_name(col: Column) -> Column:
    m = F.create_map(*[x for i, n in STEP_NAMES for x in (F.lit(i).cast("bigint"), F.lit(n))])
    return F.when(col.isNull(), F.lit("null")).otherwise(
        F.coalesce(F.try_element_at(m, col.cast("bigint")), col.cast("string")))


# ---- B6: GPU entity strings ------------------------------------------------------------
def entity_field(col: Column, key: str) -> Column:
    """Value of ``key="..."`` in an entity string (quotes respected, NULL if absent)."""
    v = F.regexp_extract(col, rf'(?:^|,)\s*{key}="((?:[^"\\]|\\.)*)"', 1)
    return F.when(v == "", F.lit(None)).otherwise(v)


def parse_entity(df: DataFrame, col: str, host: Column | None = None) -> DataFrame:
    """Entity -> (entity_host, entity_jobid, gpuid); rows of other hosts or
    without a numeric gpu are dropped."""
    c = F.col(col)
    out = df.select("*", entity_field(c, "hostname").alias("entity_host"),
                    entity_field(c, "job_id").cast("bigint").alias("entity_jobid"),
                    F.when(entity_field(c, "gpu").rlike("^[0-9]+$"), entity_field(c, "gpu").cast("bigint"))
                    .alias("gpuid"))
    out = out.where(F.col("gpuid").isNotNull())
    if host is not None:
        out = out.where(F.col("entity_host") == host)
    return out


# ---- B7 / B8 -----------------------------------------------------------------------
def slurm_duration(col: Column) -> Column:
    return slurm_time(col)


def split_ticks(ticks: Column, hz: int) -> tuple[Column, Column]:
    """Clock ticks -> (seconds, microseconds)."""
    t = ticks.cast("bigint")
    return (F.call_function("div", t, F.lit(hz).cast("bigint")),
            ((t % hz) * F.lit(1000000.0 / hz)).cast("bigint"))


# ---- B9: /proc/<pid>/stat lines --------------------------------------------------------
def parse_proc_stat(df: DataFrame, col: str) -> DataFrame:
    """pid, comm (greedy up to the last ')'), ppid, faults, times, rss pages."""
    line = F.col(col)
    comm = F.regexp_extract(line, r"^\s*\d+\s+\((.*)\)\s", 1)
    rest = F.split(F.trim(F.regexp_extract(line, r"^.*\)\s+(.*)$", 1)), r"\s+")
    f = lambda i: F.try_element_at(rest, F.lit(i - 2)).try_cast("bigint")  # noqa: E731  field i of stat(5)
    return df.select("*",
                     F.regexp_extract(line, r"^\s*(\d+)", 1).cast("bigint").alias("pid"),
                     comm.alias("comm"),
                     f(4).alias("ppid"), f(10).alias("minflt"), f(11).alias("cminflt"),
                     f(14).alias("utime"), f(15).alias("stime"), f(16).alias("cutime"),
                     f(17).alias("cstime"), f(24).alias("rss_pages"))


# ---- G1 / G2 --------------------------------------------------------------------------
def machine_name(col: Column) -> Column:
    """Lower-case; every character that is not a letter becomes '_'."""
    return F.regexp_replace(F.lower(col), "[^a-z]", "_")


def user_of_address(col: Column) -> Column:
    """User part of a mail address (text before '@')."""
    return F.substring_index(col, "@", 1)
