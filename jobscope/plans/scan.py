"""Skew-safe ordered scans (lag, lead, running and whole-group aggregates).

A plain ``Window.partitionBy(key).orderBy(recordid)`` puts every row of one key
into one task.  With monitoring data one user, job or session can hold a third
of all rows, so every ordered computation of the analysis goes through
:func:`ordered_scan` instead:

1. the rows of each key are counted; where no key is *hot* (more rows than
   ``chunk / SPLIT``), plain windows over one exchange do: no bucket, summary or join;
2. else rows of hot keys get a bucket ``b = position div (chunk / SPLIT)``
   (position = first order column, a record id), all other keys one bucket;
3. the window runs per (key, bucket) - a hot key is split over many tasks;
4. a per-(key, bucket) summary of the hot rows (last/first value, sum, max, min),
   and a window over it (rows per key = number of buckets, i.e. position range /
   bucket), give the carry from earlier or later buckets;
5. the carry is joined back on (key, bucket); both sides hash on the same
   struct key, so the big side is not shuffled again.

So the summary is as small as the hot keys are few, however many keys there are.

Keys are packed into one struct column there: struct equality treats NULL fields as
equal, which is the grouping semantics a window partition has.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# pieces of a chunk: a hot key's rows are cut so fine that they keep many tasks busy
SPLIT = 16

KINDS = {"lag", "lead", "sum_incl", "sum_excl", "max_excl", "first", "max_all", "min_all"}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


_PERSISTED: list[DataFrame] = []


def release_cached() -> None:
    """Unpersist the inputs cached by :func:`ordered_scan`."""
    while _PERSISTED:
        _PERSISTED.pop().unpersist()


def key_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by..., n``: the rows of each key, for ``sizes`` of :func:`ordered_scan`."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# values that rows are first counted by when only hot keys are looked for
HASHES = 1 << 16


def crowded_keys(df: DataFrame, by: Sequence[str], chunk: int) -> tuple[DataFrame, int]:
    """``by..., n`` of the keys that :func:`ordered_scan` has to split, for its ``sizes``, and the number of all rows.

    Rows are counted by a hash of their key first, so that nothing large is exchanged, and key by key only where that
    count allows for a hot key."""
    piece = max(1, int(chunk) // SPLIT)
    rows = df.select(*by).withColumn("__hash", F.pmod(F.xxhash64(*by), F.lit(HASHES)))
    counted = rows.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n")).collect()
    crowded, total = [(r["__hash"],) for r in counted if r["__n"] > piece], sum(r["__n"] for r in counted)
    if not crowded:
        return df.sparkSession.createDataFrame([], key_sizes(df, by).schema), total
    crowded = df.sparkSession.createDataFrame(crowded, "__hash long")
    return keep_rows(key_sizes(rows.join(F.broadcast(crowded), "__hash", "left_semi"), by).where(F.col("n") > piece)), total


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 specs: Sequence[tuple[str, str, object]], chunk: int, persist: bool = True,
                 sizes: DataFrame | None = None, gather: bool = False, split: bool = False) -> DataFrame:
    """Add one column per spec ``(name, kind, expr)`` to ``df``.

    kinds: ``lag``/``lead`` (1 row, NULL at the edges), ``sum_incl``/``sum_excl``
    (running sum including / excluding the current row), ``max_excl`` (running
    max of earlier rows), ``first`` (value of the first row of the group),
    ``max_all``/``min_all`` (whole group).  ``order`` must be unique inside a
    group and its first column numeric (the bucketed position).

    ``sizes`` tells the rows of each key where they can be had cheaper than from
    ``df``: ``by..., n`` with some or all of the keys, at least as many as ``df``
    has (:func:`key_sizes`).  One small job looks for hot keys.  ``gather`` brings
    rows together by the keys of ``sizes`` where none of these is hot, so that
    further scans by them need no exchange.  ``split`` is for few keys that are hot
    as a rule (users): all are split, and nothing is counted.  Without ``sizes``
    the rows are read twice, with hot keys once more for the summary (Catalyst
    prunes the window out of it), so an input that is not a plain scan is then
    persisted (memory and disk, lineage kept) to be computed once.
    """
    for _, kind, _ in specs:
        if kind not in KINDS:
            raise ValueError(f"unknown scan kind {kind}")
    keys, order, piece = list(keys), list(order), max(1, int(chunk) // SPLIT)
    counted, own = df, sizes is None
    if split or not keys:
        return _bucketed(df.withColumn("__scan_hot", F.lit(True)), df.columns, keys, order, specs, piece, persist)
    if sizes is None:
        counted = keep_rows(df) if persist else df
        sizes = key_sizes(counted, keys)
    by = [c for c in sizes.columns if c != "n"]
    hot = sizes.where(F.col("n") > piece).select(*by, F.lit(True).alias("__scan_hot"))
    if hot.isEmpty():
        return _plain(counted.repartition(*by) if gather and by else counted, keys, order, specs)
    if by:  # at most one key in ``piece`` rows
        h = F.broadcast(hot.select(*[F.col(c).alias(f"__scan_by_{c}") for c in by], "__scan_hot"))
        same = [counted[c].eqNullSafe(h[f"__scan_by_{c}"]) for c in by]
        d = counted.join(h, reduce(lambda x, y: x & y, same), "left").drop(*[f"__scan_by_{c}" for c in by])
    else:
        d = counted.withColumn("__scan_hot", F.lit(True))
    return _bucketed(d, df.columns, keys, order, specs, piece, persist and not own)


def keep_rows(df: DataFrame) -> DataFrame:
    """``df`` cached for scans (memory and disk, lineage kept) until the next table is stored."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _PERSISTED.append(df)
    return df


def _plain(df: DataFrame, keys: list[str], order: list[str], specs: Sequence[tuple[str, str, object]]) -> DataFrame:
    """The scan by windows over whole groups."""
    by = Window.partitionBy(*keys)
    w = by.orderBy(*order)
    unb, unf = Window.unboundedPreceding, Window.unboundedFollowing
    out = []
    for name, kind, expr in specs:
        e = _c(expr)
        out.append({
            "lag": lambda: F.lag(e).over(w), "lead": lambda: F.lead(e).over(w),
            "sum_incl": lambda: F.sum(e).over(w.rowsBetween(unb, 0)), "sum_excl": lambda: F.sum(e).over(w.rowsBetween(unb, -1)),
            "max_excl": lambda: F.max(e).over(w.rowsBetween(unb, -1)), "first": lambda: F.first(e).over(w.rowsBetween(unb, unf)),
            "max_all": lambda: F.max(e).over(by), "min_all": lambda: F.min(e).over(by)}[kind]().alias(name))
    return df.select("*", *out)


def _bucketed(df: DataFrame, columns: list[str], keys: list[str], order: list[str], specs: Sequence[tuple[str, str, object]],
              piece: int, persist: bool) -> DataFrame:
    """The scan with hot keys (rows marked ``__scan_hot``) split by position."""
    K, B = "__scan_key", "__scan_bkt"
    hot = F.col("__scan_hot").isNotNull()
    d = df.withColumn(K, F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)) \
          .withColumn(B, F.when(hot, F.coalesce(F.expr(f"`{order[0]}` div {piece}"), F.lit(-(2 ** 63)).cast("bigint")))
                      .otherwise(F.lit(0).cast("bigint")))
    # a NULL position gets the lowest bucket (windows order NULLS FIRST)
    if persist:
        d = keep_rows(d)
    wl = Window.partitionBy(K, B).orderBy(*order)
    whole = Window.partitionBy(K, B)
    unb, unf = Window.unboundedPreceding, Window.unboundedFollowing
    ord_struct = F.struct(*[F.col(o) for o in order])

    local: list[Column] = [
        F.lag(F.lit(1)).over(wl).isNull().alias("__scan_first"),
        F.lead(F.lit(1)).over(wl).isNull().alias("__scan_last"),
    ]
    aggs: list[Column] = []
    carries: list[Column] = []
    ws = Window.partitionBy(K).orderBy(B)
    wall = Window.partitionBy(K)
    finals: list[tuple[str, Column]] = []
    for i, (name, kind, expr) in enumerate(specs):
        e = _c(expr)
        t = f"__scan{i}"
        if kind == "lag":
            local.append(F.lag(e).over(wl).alias(t + "_l"))
            aggs.append(F.max_by(e, ord_struct).alias(t + "_a"))
            carries.append(F.lag(t + "_a").over(ws).alias(t + "_c"))
            finals.append((name, F.when(F.col("__scan_first"), F.col(t + "_c"))
                           .otherwise(F.col(t + "_l"))))
        elif kind == "lead":
            local.append(F.lead(e).over(wl).alias(t + "_l"))
            aggs.append(F.min_by(e, ord_struct).alias(t + "_a"))
            carries.append(F.lead(t + "_a").over(ws).alias(t + "_c"))
            finals.append((name, F.when(F.col("__scan_last"), F.col(t + "_c"))
                           .otherwise(F.col(t + "_l"))))
        elif kind in ("sum_incl", "sum_excl"):
            hi = 0 if kind == "sum_incl" else -1
            local.append(F.sum(e).over(wl.rowsBetween(unb, hi)).alias(t + "_l"))
            aggs.append(F.sum(e).alias(t + "_a"))
            carries.append(F.sum(t + "_a").over(ws.rowsBetween(unb, -1)).alias(t + "_c"))
            l, c = F.col(t + "_l"), F.col(t + "_c")
            finals.append((name, F.when(l.isNull() & c.isNull(), F.lit(None))
                           .otherwise(F.coalesce(l, F.lit(0)) + F.coalesce(c, F.lit(0)))))
        elif kind == "max_excl":
            local.append(F.max(e).over(wl.rowsBetween(unb, -1)).alias(t + "_l"))
            aggs.append(F.max(e).alias(t + "_a"))
            carries.append(F.max(t + "_a").over(ws.rowsBetween(unb, -1)).alias(t + "_c"))
            finals.append((name, F.greatest(F.col(t + "_l"), F.col(t + "_c"))))
        elif kind == "first":
            local.append(F.first(e).over(wl.rowsBetween(unb, unf)).alias(t + "_l"))
            aggs.append(F.min_by(e, ord_struct).alias(t + "_a"))
            carries.append(F.first(t + "_a").over(ws.rowsBetween(unb, unf)).alias(t + "_c"))
            finals.append((name, F.when(hot, F.col(t + "_c")).otherwise(F.col(t + "_l"))))
        elif kind in ("max_all", "min_all"):
            fn = F.max if kind == "max_all" else F.min
            local.append(fn(e).over(whole).alias(t + "_l"))
            aggs.append(fn(e).alias(t + "_a"))
            carries.append(fn(t + "_a").over(wall).alias(t + "_c"))
            finals.append((name, F.when(hot, F.col(t + "_c")).otherwise(F.col(t + "_l"))))

    windowed = d.select("*", *local)
    summary = d.where(hot).groupBy(K, B).agg(*aggs).select(K, B, *carries)
    joined = windowed.join(summary, [K, B], "left")
    return joined.select(*[F.col(c) for c in columns], *[expr.alias(n) for n, expr in finals])
