"""Period publication sink and source.

A period's sections are published as one long table partitioned by
``period`` (= the period's offset_start): each row is (period, user, section,
started, updated, document) where ``document`` is the section entry as JSON.
A growing period overwrites only its own partition (dynamic overwrite).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLICATION_SCHEMA = "period bigint, user string, section string, started bigint, updated bigint, entry string"


def section_rows(sections: dict[str, DataFrame], period: Column, started: Column, updated: Column) -> DataFrame:
    """Export sections (E13-E19, with a ``user`` column) -> publication rows."""
    parts = []
    for name, df in sections.items():
        fields = [c for c in df.columns if c != "user"]
        parts.append(df.select(
            period.cast("bigint").alias("period"), "user", F.lit(name).alias("section"),
            started.cast("bigint").alias("started"), updated.cast("bigint").alias("updated"),
            F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields]), {"ignoreNullFields": "false"}).alias("entry")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_period(rows: DataFrame, path: str) -> None:
    """Overwrite only the partitions of the periods present in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON lines, a folder per user and section; no document is gathered in one place."""
    documents.write.mode("overwrite").partitionBy("user", "section").text(path)


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    """The published table (partition-pruned by ``period`` filters)."""
    return spark.read.schema(PUBLICATION_SCHEMA).parquet(path)


def read_periods_stream(spark: SparkSession, path: str) -> DataFrame:
    """A18 (stream): new or renewed period files as they arrive."""
    return spark.readStream.schema(PUBLICATION_SCHEMA).parquet(path)
