"""Operator 10 against brute force."""
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobscope.llm import ann
from jobscope.llm.queries import QUERIES


def plain(ids, vectors, queries, k):
    out = {}
    for q in queries:
        v = vectors[list(ids).index(q)]
        d = np.sqrt(((vectors - v) ** 2).sum(axis=1))
        out[q] = [(i, x) for x, i in sorted((x, i) for i, x in zip(ids, d) if i != q)[:k]]
    return out


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_srs_neighbours"](spark, sf).toPandas()
    table = pd.read_parquet(f"{sf}/embeddings.parquet")
    vectors = np.stack(table.embedding.map(lambda x: np.asarray(x, float)))
    want = plain(table.vec_id.tolist(), vectors, table.vec_id[table.vec_id % 100 == 0].tolist(), 10)
    hits = 0
    for q, near in want.items():
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and q not in set(own.vec_id)
        assert own.score.is_monotonic_increasing
        at = dict(zip(table.vec_id, vectors))
        np.testing.assert_allclose(own.score, [np.sqrt(((at[q] - at[i]) ** 2).sum()) for i in own.vec_id], rtol=1e-12)
        hits += len(set(own.vec_id) & {i for i, _ in near})
    assert hits >= 0.9 * 10 * len(want)


@settings(max_examples=40, deadline=None)
@given(st.floats(0.05, 0.999), st.sampled_from([2, 4, 8, 16]))
def test_chi_square_points(p, dims):
    assert ann.chi_square_cdf(ann.chi_square_point(p, dims), dims) == pytest.approx(p, abs=1e-9)


def test_chi_square_against_draws():
    draws = (np.random.default_rng(0).standard_normal((200_000, 8)) ** 2).sum(axis=1)
    assert np.mean(draws <= ann.chi_square_point(0.9, 8)) == pytest.approx(0.9, abs=0.005)


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(ann, "LEAF", 4)
    r = np.random.default_rng(1)
    vectors = np.concatenate([np.repeat(r.standard_normal((1, 6)), 80, axis=0), r.standard_normal((120, 6))])
    ids = r.permutation(1000)[:200]
    table = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    got = ann.nearest(table, F.col("vec_id") % 10 == 0, k=5, confidence=1 - 1e-12).collect()
    want = plain(ids.tolist(), vectors, [i for i in ids.tolist() if i % 10 == 0], 5)
    mine = {q: sorted((x["rank"], x.vec_id) for x in got if x.query_id == q) for q in want}
    assert {q: [v for _, v in x] for q, x in mine.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [1.0, 2.0, 3.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, block int")
    got = [tuple(r) for r in ann.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, pytest.approx(2 ** 0.5)), (100, 1, 0, 0.0), (100, 2, 1, pytest.approx(2 ** 0.5))]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
