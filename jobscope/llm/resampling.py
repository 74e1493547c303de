"""Importance resampling towards a target distribution over hashed words (operator 12).

1. Bucket counts of the corpus and of the target texts: every task adds up one array of ``buckets`` counts.
2. The gains (log ratios of smoothed bucket frequencies, in thousandths) are one array of ``buckets`` numbers, the only
   thing that goes through the driver.  A text's weight is the floored mean of its words' gains, worked out by whole
   arrays; its score adds Gumbel noise drawn from a hash of its id, so that the highest scores are a sample without
   replacement in proportion to the weights.
3. The cutoff of the draw: a quantile sketch of the scores proposes a bracket [low, high]; one exact count of the rows
   above, inside and below validates it, or widens it on the side that misses.  Only the rows of the bracket are
   sorted, to find the row at which the draw ends.

``resampled`` marks the drawn rows; ``ranked`` numbers them in order as well, by a range-partitioned sort of the drawn
rows alone.  Ties of score go to the smaller id; rows that tie in both (repeated rows, null ids) are taken in the order
of the scored table, so the draw has exactly its size.

Edge cases: null and empty texts have no features, weight 0, and are never drawn (too few words); a null id counts as
'' in the hash and comes after all ids; rows that share an id share their noise, not their weight; an empty table gives
an empty result; an empty target gives every feature a gain by corpus frequency alone; long texts are cut between words
and added up as one; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import CHUNK_BYTES, id_text, map_batches, numbered, text_pieces, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

SCORED_SCHEMA = "doc_id long, n_features long, weight long"
_SCORED = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
_COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def word_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The text index and the bucket of every word.  A distinct word is hashed once a piece."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
    encoded = pc.list_flatten(parts).dictionary_encode()
    of_word = np.array([crc32(w.encode()) % buckets if w else -1 for w in encoded.dictionary.to_pylist()], np.int64)
    rows, found = pc.list_parent_indices(parts).to_numpy(), of_word[encoded.indices.to_numpy()] if len(of_word) else np.zeros(0, np.int64)
    real = found >= 0
    return rows[real].astype(np.int64), found[real]


def _slices(data: np.ndarray, limit: int) -> Iterator[pa.Array]:
    """One long text as texts of about ``limit`` bytes, cut between words (a longer word is not cut)."""
    cuts = np.flatnonzero(_SEPARATOR[data])
    lo = 0
    while lo < len(data):
        at = np.searchsorted(cuts, lo + limit)
        hi = int(cuts[at]) + 1 if at < len(cuts) else len(data)
        yield pa.array([data[lo:hi].tobytes()], pa.binary()).cast(pa.string())
        lo = hi


def _pieces(batches: Iterator[pa.RecordBatch], buckets: int, limit: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Slices of the batches with the words of their texts, in one or more parts."""
    for piece, data, _ in text_pieces(batches, limit=limit):
        whole = piece.num_rows > 1 or len(data) <= limit
        parts = [piece["text"]] if whole else _slices(data, limit)
        yield piece, (word_buckets(p, buckets) for p in parts)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, limit: int = CHUNK_BYTES) -> DataFrame:
    """Number of words in every occupied bucket over all texts (column ``text``)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, parts in _pieces(batches, buckets, limit):
            for _, found in parts:
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], schema=_COUNTS)

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_batches(texts, count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _count_array(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets)
    for row in counts.collect():  # one row a bucket at most
        out[row.bucket] = row.n
    return out


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln(smoothed target frequency / smoothed corpus frequency)) of every bucket."""
    s, t = (_count_array(bucket_counts(x, buckets), buckets) for x in (docs, target))
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_features and weight of every text."""
    buckets = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, parts in _pieces(batches, buckets, limit):
            n, total = np.zeros(piece.num_rows, np.int64), np.zeros(piece.num_rows, np.int64)
            for rows, found in parts:
                n += np.bincount(rows, minlength=len(n))
                np.add.at(total, rows, gain[found])
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.record_batch([piece["doc_id"], pa.array(n), pa.array(weight)], schema=_SCORED)

    return map_batches(id_text(docs, id_col, text_col), score, SCORED_SCHEMA)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, floored, from the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def scored(docs: DataFrame, target: DataFrame, seed: int = 2024, buckets: int = BUCKETS) -> DataFrame:
    """A written table of doc_id, n_features, weight, score, and ``place``, a number of its own for every row."""
    rows = weights(docs, gains(docs, target, buckets)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return written(rows.withColumn("place", F.monotonically_increasing_id()), "resampling")


# The order of the draw: highest score first, then smallest id (nulls last), then the place in the table.
def draw_order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]


def bracket(rows: DataFrame, n: int, draw: int, error: float = 1e-4) -> tuple[int, int, int]:
    """Scores low and high such that the ``draw``-th highest of ``n`` scores lies between them, and the rows above high.

    The sketch only proposes; rows outside are counted exactly, and a side on which the cutoff is missed is moved out.
    """
    width = 2 * error
    while True:
        at = 1 - draw / n
        # ends beyond the first and last row are open, so the loop ends
        ends = [max(at - width, 0.0), min(at + width, 1.0)]
        low, high = rows.select(F.percentile_approx("score", ends, int(1 / error)).alias("q")).first().q
        low, high = (-(1 << 62) if ends[0] == 0.0 else low), ((1 << 62) if ends[1] == 1.0 else high)
        above, inside = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < draw <= above + inside:
            return low, high, above
        width *= 4


def cutoff(rows: DataFrame, percent: int) -> tuple[int, int | None, int] | None:
    """(score, id, place) of the last drawn row; None if none is drawn."""
    n = rows.count()
    draw = percent * n // 100
    if not draw:
        return None
    low, high, above = bracket(rows, n, draw)
    inside = numbered(rows.where(F.col("score").between(low, high)).select("score", "doc_id", "place"), draw_order(), "resampling-bracket")
    last = inside.where(F.col("rank") == draw - above).first()
    return last.score, last.doc_id, last.place


def _drawn(cut: tuple[int, int | None, int], min_words: int) -> Column:
    """Whether a row stands at the cutoff or before it."""
    score, doc_id, place = cut
    same = F.col("score") == score
    if doc_id is None:
        by_id = F.col("doc_id").isNotNull() | (F.col("place") <= place)
    else:
        by_id = F.coalesce((F.col("doc_id") < doc_id) | ((F.col("doc_id") == doc_id) & (F.col("place") <= place)), F.lit(False))
    return (F.col("n_features") >= min_words) & ((F.col("score") > score) | (same & by_id))


def resampled(table: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """The scored table with ``drawn``: whether a row is among the ``percent`` highest scores of those long enough."""
    cut = cutoff(table.where(F.col("n_features") >= min_words), percent)
    return table.withColumn("drawn", F.lit(False) if cut is None else _drawn(cut, min_words))


def ranked(table: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; the rank of rows that are not drawn is null."""
    marked = resampled(table, percent, min_words)
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = numbered(marked.where("drawn").drop("drawn"), draw_order(), "resampling-drawn").select(*columns, F.col("rank").cast("long").alias("rank"))
    return marked.where("NOT drawn").select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(drawn)
