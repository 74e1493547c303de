"""Operator 12 against plain Python."""
import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pandas as pd
import pytest

from jobscope.llm import resampling
from jobscope.llm.queries import QUERIES

from .conftest import SF


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(rows, target, percent=10, min_words=20, buckets=10_000, seed=2024):
    """(doc_id, n_features, weight, score, rank) of rows (doc_id, text)."""
    def count(texts):
        return Counter(crc32(w.encode()) % buckets for t in texts for w in words(t))
    s, t = count(x for _, x in rows), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for i, x in rows:
        own = [gain[crc32(w.encode()) % buckets] for w in words(x)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long_enough = [r for r in out if r[1] >= min_words]
    order = sorted(long_enough, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))[:percent * len(long_enough) // 100]
    return sorted([(*r, k + 1) for k, r in enumerate(order)] + [(*r, None) for r in _less(out, order)], key=str)


def _less(rows, taken):
    left = Counter(rows)
    left.subtract(Counter(taken))
    return list(left.elements())


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark, docs):
    target = pd.read_parquet(f"{SF}/benchmark.parquet").text
    assert result(QUERIES["op12_resampling"](spark, SF)) == plain(list(zip(docs.doc_id.tolist(), docs.text)), target)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_ties_repeated_rows_and_null_ids(spark):
    """Half of all rows share an id or have none, so that scores tie where the draw ends."""
    text = "one two three four five six"
    rows = [(i, f"{text} w{i % 7}") for i in range(60)] + [(None, text)] * 40 + [(5, text)] * 40 + [(5, f"{text} w5")] * 3
    target = table(spark, [(1, "one two w3"), (2, None)])
    for percent in (1, 10, 35, 60, 100):
        got = result(resampling.ranked(resampling.scored(table(spark, rows), target), percent=percent, min_words=3))
        assert [r[:4] for r in got if r[4]] and len([r for r in got if r[4]]) == percent * len(rows) // 100
        want = plain(rows, ["one two w3"], percent, 3)
        assert sorted((r[4], r[3]) for r in got if r[4]) == sorted((r[4], r[3]) for r in want if r[4])
        assert sorted(str(r[:4]) for r in got) == sorted(str(r[:4]) for r in want)


@pytest.mark.parametrize("error", [0.3, 0.05, 1e-4])
def test_bracket_holds_the_cutoff(spark, error):
    """Whatever the sketch proposes: many equal scores, and a draw at the very ends."""
    scores = [0] * 500 + [7] * 300 + list(range(200))
    rows = spark.createDataFrame([(x,) for x in scores], "score long").repartition(5)
    for draw in (1, 2, 100, 350, 500, 999, 1000):
        low, high, above = resampling.bracket(rows, 1000, draw, error)
        last = sorted(scores, reverse=True)[draw - 1]
        assert low <= last <= high and above == sum(x > high for x in scores)


def test_long_texts_in_slices(spark):
    rows = [(1, "Straße a1 " * 400 + "x" * 500 + " end."), (2, "b"), (3, "")]
    gain = resampling.gains(table(spark, rows), table(spark, [(1, "straße")]))
    whole = resampling.weights(table(spark, rows), gain).collect()
    assert sorted(whole) == sorted(resampling.weights(table(spark, rows), gain, limit=64).collect())
    assert resampling.bucket_counts(table(spark, rows), limit=64).toPandas().n.sum() == 803


def test_edge_cases(edge, empty, spark):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = resampling.ranked(resampling.scored(edge, target))
    assert got.count() == edge.count()
    assert {(r.doc_id, r.n_features, r.weight, r["rank"]) for r in got.collect() if r.doc_id in (1, 2, 3)} == \
        {(1, 0, 0, None), (2, 0, 0, None), (3, 0, 0, None)}
    assert resampling.ranked(resampling.scored(empty, target)).count() == 0
    assert resampling.ranked(resampling.scored(edge, target.limit(0)), percent=100, min_words=0).where("rank is null").count() == 0
