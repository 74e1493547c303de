"""Spark session set-up shared by tests, bench and the driver entry points."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Chunk of the ordering key (recordid) used to split hot partitions of ordered
# scans; see jobscope.plans.scan.  Overridable per session.
SCAN_CHUNK_CONF = "jobscope.scan.chunk"
DEFAULT_SCAN_CHUNK = 1 << 22


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "jobscope") -> SparkSession:
    """The running session, or a new one.

    Where the cluster says a master or a number of shuffle partitions
    (``spark-submit``, spark-defaults), that holds unless it is given here; only
    without either does it run on this machine, with a few partitions."""
    running = SparkSession.getActiveSession()
    if running is not None and master is None:
        ensure_checkpoint_dir(running)
        return running
    conf = SparkConf()
    builder = SparkSession.builder.appName(app)
    master = master or os.environ.get("JOBSCOPE_MASTER")
    if master or not conf.contains("spark.master"):
        builder = builder.master(master or "local[8]")
    if shuffle_partitions or not conf.contains("spark.sql.shuffle.partitions") and not conf.contains("spark.master"):
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("JOBSCOPE_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
    )
    spark = builder.getOrCreate()
    if _context(spark) is not None:
        spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; only set one when unset (tests).

    On a cluster ``spark.checkpoint.dir`` names a shared folder; it is read
    from the session and never replaced.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if current:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    sc_dir = sc.getCheckpointDir() if sc is not None else None
    if sc_dir:
        return sc_dir
    master = (sc.master if sc is not None else spark.conf.get("spark.master", "")) or ""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster (e.g. on the "
                           "distributed file system); jobscope writes its intermediate tables there")
    # local mode only (tests, single machine): a private folder is shared by the one JVM
    local = tempfile.mkdtemp(prefix="jobscope-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    if sc is not None:
        sc.setCheckpointDir(local)
    return local


def _context(spark: SparkSession):
    """The SparkContext of a classic session (None on Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # pragma: no cover - Spark Connect
        return None


def session_id(spark: SparkSession) -> str:
    """Identifier of the running application, for per-session memoization."""
    sc = _context(spark)
    if sc is not None:
        return sc.applicationId
    return spark.conf.get("spark.app.id", None) or str(id(spark))


def file_state(spark: SparkSession, paths: list[str]) -> str:
    """What changes when the files of ``paths`` do: their newest modification, total length and number.  One small job over
    the file listing; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("modificationTime", "length")
    return str(files.agg(F.max("modificationTime"), F.sum("length"), F.count(F.lit(1))).first())


def scan_chunk(spark: SparkSession) -> int:
    try:
        return int(spark.conf.get(SCAN_CHUNK_CONF, str(DEFAULT_SCAN_CHUNK)))
    except Exception:  # pragma: no cover - connect sessions without the conf
        return DEFAULT_SCAN_CHUNK
