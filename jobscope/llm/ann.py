"""Approximate nearest neighbours by few stable projections under a kd-tree (operator 10).

Every vector is projected onto ``DIMS`` directions of independent normal entries.  The normal law is 2-stable: the
squared projected distance of two vectors, over their true squared distance, follows a chi-square law with ``DIMS``
degrees of freedom.  A kd-tree over the projected points hands out a query's neighbours in growing projected distance;
each is verified with its true distance.  Let ``d`` be the k-th smallest true distance so far and ``r`` the projected
distance that the tree has reached: a vector nearer than ``d`` that the tree has not handed out yet would have a
projected distance above ``r``, which happens with a chance of at most 1 - ChiSquare(r^2 / d^2).  The search ends when
that chance is below ``1 - CONFIDENCE``, so each true neighbour is found with that confidence.

The vectors are dealt by a hash into blocks, the queries into blocks of their own, and each pair of blocks is one
group: its tree is built and searched there, and the k best of every block are merged by a window per query.  Blocks are sized
by counts, so no group grows with the table.  The index covers every row; nothing is fitted.

Edge cases: vectors that are null, empty, zero, or that hold null or non-finite entries take no part; vectors of
different lengths are never compared; a query is never its own neighbour; ties go to the smaller id; of rows that
repeat an id the one with the smallest vector counts; with fewer than k candidates all are returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import ship

DIMS = 8
CONFIDENCE = 0.99
LEAF = 128
BLOCK_ROWS = 1 << 14
BLOCK_QUERIES = 1 << 14
SEED = 20240229
RESULT = "query_id long, vec_id long, score double"


def chi_square_cdf(x: float, dims: int) -> float:
    """P(chi-square with an even number of degrees of freedom <= x)."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, dims // 2):
        term *= half / i
        total += term
    return 1 - np.exp(-half) * total


def chi_square_point(p: float, dims: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dims) < p else (lo, mid)
    return hi


def directions(width: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, dims))


class KdTree:
    """Leaves of at most ``LEAF`` points, split at the median of the widest side, with their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # (low corner, high corner, first, last, left, right)
        self._build(points, 0, len(points), leaf)

    def _build(self, points: np.ndarray, a: int, b: int, leaf: int) -> int:
        own = points[self.order[a:b]]
        low, high = own.min(axis=0), own.max(axis=0)
        at = len(self.nodes)
        self.nodes.append((low, high, a, b, -1, -1))
        if b - a > leaf:
            side, mid = int(np.argmax(high - low)), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, side], mid)]
            left = self._build(points, a, a + mid, leaf)
            self.nodes[at] = (low, high, a, b, left, self._build(points, a + mid, b, leaf))
        return at

    def arrays(self) -> None:
        self.low = np.array([n[0] for n in self.nodes])
        self.high = np.array([n[1] for n in self.nodes])


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int,
                 confidence: float = CONFIDENCE, dims: int = DIMS) -> list[tuple[int, int, float]]:
    """The ``k`` nearest that the stopped search finds for each query: (query id, vector id, distance)."""
    if not len(ids) or not len(query_ids):
        return []
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    axes = directions(vectors.shape[1], dims)
    points, probes = vectors @ axes, queries @ axes
    tree = KdTree(points)
    tree.arrays()
    limit = chi_square_point(confidence, dims)
    out = []
    for q, p, qid in zip(queries, probes, query_ids):
        gap = np.maximum(0, np.maximum(tree.low - p, p - tree.high))
        reach = (gap * gap).sum(axis=1)
        queue = [(float(reach[0]), 0)]
        found = np.zeros(0)
        members = np.zeros(0, dtype=np.int64)
        worst = np.inf
        while queue:
            r2, node = heapq.heappop(queue)
            # nothing nearer than r2 is left in the projection: the chi-square test on the k-th distance so far
            if r2 > limit * worst + 1e-9:
                break
            _, _, a, b, left, right = tree.nodes[node]
            if left >= 0:
                heapq.heappush(queue, (float(reach[left]), left))
                heapq.heappush(queue, (float(reach[right]), right))
                continue
            own = tree.order[a:b]
            own = own[ids[own] != qid]
            gaps = vectors[own] - q
            d2 = np.einsum("ij,ij->i", gaps, gaps)
            near = d2 <= worst
            found, members = np.concatenate([found, d2[near]]), np.concatenate([members, own[near]])
            if len(found) >= k:
                best = np.lexsort((ids[members], found))[:k]
                found, members = found[best], members[best]
                worst = found[-1]
        gaps = vectors[members] - q
        out += [(int(qid), int(i), float(np.sqrt(d))) for i, d in zip(ids[members], (gaps * gaps).sum(axis=1))]
    return out


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")) \
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)) \
        .where(~bad & F.exists(v, lambda x: x != 0)) \
        .withColumn("width", F.size("vec"))


def _once(rows: pd.DataFrame) -> pd.DataFrame:
    if rows["vec_id"].is_unique:
        return rows
    return rows.assign(key=rows["vec"].map(tuple)).sort_values(["vec_id", "key"]).drop_duplicates("vec_id")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            confidence: float = CONFIDENCE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows of every row for which ``is_query`` (over vec_id)."""
    ship(vectors.sparkSession)
    rows = _usable(vectors, id_col, vec_col)
    queries = rows.where(is_query)
    n = rows.count()
    blocks, sets = -(-n // BLOCK_ROWS) or 1, -(-queries.count() // BLOCK_QUERIES) or 1
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    own_set = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(sets)).cast("int")
    stored = rows.withColumn("block", block).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    asked = queries.withColumn("set", own_set).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for width in left["width"].unique():
            a, b = (_once(x[x["width"] == width]) for x in (left, right))
            if len(b):
                found += search_block(np.stack(a["vec"].to_list()), a["vec_id"].to_numpy(),
                                      np.stack(b["vec"].to_list()), b["vec_id"].to_numpy(), k, confidence)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    near = stored.groupBy("block", "set").cogroup(asked.groupBy("block", "set")).applyInPandas(search, RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
