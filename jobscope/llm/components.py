"""Connected components of an undirected graph given as edges, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``v, label``: for every end of an edge (``a, b``) the smallest end that is reachable.

    Each round takes the smallest label among a vertex's neighbours and then the label of that label, so the number of
    rounds grows with the logarithm of the longest path; it goes on until nothing changes.  Labels are written to the
    shared folder after each round.

    Edge cases: repeated edges, both directions of one and edges of a vertex to itself change nothing (a vertex with no
    other edge has no row); edges with a null end are left out; without edges the result is empty; only ``a`` and ``b``
    are read.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .where(F.col("a") != F.col("b")).distinct(), "edges")
    # the smallest end next to each vertex, or itself
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("n"))
                     .select("v", F.least("v", "n").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("label").alias("l")), "b") \
            .groupBy(F.col("a").alias("v")).agg(F.min("l").alias("near"))
        stepped = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("v").alias("h"), F.col("label").alias("far"))
        new = written(stepped.join(hop, F.col("label") == F.col("h"), "left")
                      .select("v", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")
