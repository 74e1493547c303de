"""Shared plumbing of the training-data operators: text batches, written tables, held-out folds."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.session import ensure_checkpoint_dir

# Bytes of text that a Python task works on at once (a single longer text is one piece of its own).
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (``spark.checkpoint.dir``): lineage ends there."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows up to which a narrow table of ids may be broadcast (some 16 bytes each).
BROADCAST_IDS = 1_000_000


def small_or_shuffled(table: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """A written table of ids, marked for broadcast if it has been counted to have ``rows`` rows at most."""
    return F.broadcast(table) if table.count() <= rows else table


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... in an order without ties: a range-partitioned sort, written once, and the sizes of
    the partitions before each (one row a partition)."""
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = rows.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    ids = F.monotonically_increasing_id()  # partition number and place within it
    dealt = written(dealt.withColumn("part", F.shiftright(ids, 33).cast("int")).withColumn("inside", ids.bitwiseAND((1 << 33) - 1)), name)
    sizes = {r.part: r.n for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, n = [], 0
    for p in sorted(sizes):
        before.append((p, n))
        n += sizes[p]
    offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
    return dealt.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("inside") + 1).drop("part", "inside", "before")


def with_row_keys(docs: DataFrame, id_col: str, key: str) -> DataFrame:
    """``docs`` with a number ``key`` of its own for every row, in the order of the ids (null first).

    It is the id itself where no row shares or lacks one.  Otherwise the rows are written, so that each has a fixed
    place, and numbered by id and place.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if ids.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty():
        return docs.withColumn(key, F.col(id_col).cast("long"))
    place = f"{key}_place"
    placed = written(docs.withColumn(place, F.monotonically_increasing_id()), "placed-rows")
    by_id = [F.asc_nulls_first("id"), F.asc(place)]
    ranks = numbered(placed.select(F.col(id_col).cast("long").alias("id"), place), by_id, "row-keys")
    return placed.join(ranks.select(place, F.col("rank").alias(key)), place).drop(place)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="jobscope-"), "jobscope.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)


def release_memory() -> None:
    """Give freed memory back to the system: workers are reused, and what one stage freed would stay with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release_memory()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (0 for a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(0))


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty) travel on, so further columns can neither clash nor cost."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def row_chunks(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes (one row at least)."""
    n, lo = len(sizes), 0
    ends = np.cumsum(sizes)
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column without nulls as its UTF-8 bytes and n+1 offsets into them."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_pieces(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches that hold at most ``limit`` bytes of text, with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        data, offsets = text_buffer(col)
        for lo, hi in row_chunks(np.diff(offsets), limit):
            a, b = offsets[lo], offsets[hi]
            yield batch.slice(lo, hi - lo), data[a:b], offsets[lo:hi + 1] - a


def row_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes in a column of texts, nulls among them: what a task makes of texts
    row by row is then bounded by the slice, not by a batch of thousands of texts."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for lo, hi in row_chunks(sizes, limit):
            yield batch.slice(lo, hi - lo)
