"""Write an intermediate result as Parquet in the cluster's checkpoint folder.

Used where one result feeds many later stages (curated monitoring tables, the
per-session time series): the plan is cut there, later stages read columnar
files with pushdown, and a lost executor only costs re-reading, not re-running
the whole lineage.  The folder is ``spark.checkpoint.dir`` (a shared path on a
cluster); see :func:`jobscope.session.ensure_checkpoint_dir`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from jobscope.plans.scan import release_cached
from jobscope.session import ensure_checkpoint_dir


def materialize(df: DataFrame, name: str, sort_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/jobscope/{name}-{uuid.uuid4().hex[:12]}"
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    out.write.mode("overwrite").parquet(path, compression=compression)
    release_cached()  # what the scans below this table cached has served
    return spark.read.parquet(path)


def scratch_path(spark, name: str) -> str:
    """A fresh folder for ``name`` under the cluster's checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/jobscope/{name}-{uuid.uuid4().hex[:12]}"
