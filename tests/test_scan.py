"""ordered_scan equals plain windows, for any chunk size (hot keys split)."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from jobscope.plans.scan import ordered_scan


def _rows(n=400, seed=7):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = rnd.choice([None, 1, 1, 1, 1, 2, 3])  # key 1 is hot (more than a third of rows)
        out.append((k, rnd.choice([0, 1]), i * 3 + rnd.randint(0, 2), rnd.choice([None, rnd.randint(-5, 9)])))
    out.append((1, 0, None, 4))  # a NULL position is kept and ordered first
    return out


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 22])
def test_scan_matches_windows(spark, chunk):
    df = spark.createDataFrame(_rows(), "k int, g int, pos long, v int")
    specs = [("lag", "lag", "v"), ("lead", "lead", "v"), ("si", "sum_incl", "v"), ("se", "sum_excl", "v"),
             ("mx", "max_excl", "v"), ("fi", "first", "v"), ("ma", "max_all", "v"), ("mi", "min_all", "v")]
    got = ordered_scan(df, ["k", "g"], ["pos"], specs, chunk).orderBy(F.col("pos").asc_nulls_first()).collect()
    w = Window.partitionBy("k", "g").orderBy("pos")
    unb = Window.unboundedPreceding
    ref = df.select("*", F.lag("v").over(w).alias("lag"), F.lead("v").over(w).alias("lead"),
                    F.sum("v").over(w.rowsBetween(unb, 0)).alias("si"),
                    F.sum("v").over(w.rowsBetween(unb, -1)).alias("se"),
                    F.max("v").over(w.rowsBetween(unb, -1)).alias("mx"),
                    F.first("v").over(w.rowsBetween(unb, Window.unboundedFollowing)).alias("fi"),
                    F.max("v").over(Window.partitionBy("k", "g")).alias("ma"),
                    F.min("v").over(Window.partitionBy("k", "g")).alias("mi")) \
        .orderBy(F.col("pos").asc_nulls_first()).collect()
    assert len(got) == len(ref) == 401
    cols = [s[0] for s in specs]
    assert [tuple(r[c] for c in cols) for r in got] == [tuple(r[c] for c in cols) for r in ref]
