"""Join helpers: size-checked broadcast and a binned range (as-of) join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest side we hint for broadcast (bytes, optimizer estimate).
BROADCAST_LIMIT = 64 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer size estimate of ``df`` (None when the plan has no stats)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # pragma: no cover - Spark Connect has no _jdf
        return None


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only when the estimated size is known and below ``limit``.

    Otherwise the frame is returned unchanged and Spark/AQE choose the join from
    runtime sizes (a shuffle join beyond the threshold).
    """
    size = estimated_bytes(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    return df


def binned_range_join(left: DataFrame, pos: str, ranges: DataFrame, start: str, end: str,
                      bin_size: int, max_pos: Column) -> DataFrame:
    """Inner join ``left`` rows to ``ranges`` rows with ``start <= pos < end``.

    ``end`` may be NULL (open).  Each range is listed once per bin it covers and
    joined on the bin number, then filtered: an equi-join Spark can shuffle or
    broadcast by size, never a cartesian product.  ``max_pos`` closes open ranges.
    """
    bs = int(bin_size)
    r = ranges.withColumn("__rj_hi", F.coalesce(F.col(end) - 1, max_pos)) \
              .withColumn("__rj_bin", F.explode(F.sequence(
                  F.expr(f"`{start}` div {bs}"), F.expr(f"__rj_hi div {bs}")))) \
              .drop("__rj_hi")
    r = broadcast_if_small(r)
    l = left.withColumn("__rj_bin", F.expr(f"`{pos}` div {bs}"))
    cond = (l["__rj_bin"] == r["__rj_bin"]) & (l[pos] >= r[start]) & \
        (r[end].isNull() | (l[pos] < r[end]))
    out = l.join(r, cond, "inner")
    return out.drop(l["__rj_bin"]).drop(r["__rj_bin"])
