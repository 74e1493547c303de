"""Operator 4 against all pairs."""
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from .conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from jobscope.llm import rtree_join
from jobscope.llm.components import components
from jobscope.llm.queries import QUERIES


def shingles(text, size=4):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)]) if 0 < len(w) < size else frozenset(zip(*(w[k:] for k in range(size))))


def plain_components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_components_equal_those_of_all_pairs(spark, docs):
    got = QUERIES["op4_rtree_join"](spark, SF).toPandas().set_index("doc_id")
    sets = {i: shingles(t) for i, t in zip(docs.doc_id, docs.text)}
    assert got.n_shingles.to_dict() == {i: len(s) for i, s in sets.items()}
    assert got.component_id.to_dict() == plain_components(sets, 85)


def test_chains_and_hot_groups_of_near_copies(spark, monkeypatch):
    """Texts that each differ a little from the one before: chains, with blocks and hubs far below the group's size."""
    monkeypatch.setattr(rtree_join, "BLOCK_ROWS", 4)
    monkeypatch.setattr(rtree_join, "FAMILY_BYTES", 3000)
    monkeypatch.setattr(rtree_join, "CALL_BYTES", 5000)
    monkeypatch.setattr(rtree_join, "CALL_ROWS", 50)
    r = np.random.default_rng(5)
    rows, words = [], [f"w{i}" for i in r.integers(0, 400, 80)]
    for i in range(60):
        words = list(words)
        for at in r.integers(0, 80, r.integers(0, 3)):
            words[at] = f"w{r.integers(0, 400)}"
        rows.append((100 - i, " ".join(words)))
    rows += [(200 + i, f"short {'x' if i % 2 else 'y'}") for i in range(6)] + [(300, " ".join(words[:20])), (301, " ".join(words[:21]))]
    for percent in (85, 60):
        got = rtree_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
        assert {x.doc_id: x.component_id for x in got} == plain_components({i: shingles(t) for i, t in rows}, percent)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**9), st.sampled_from([Fraction(85, 100), Fraction(80, 100), Fraction(6, 10)]))
def test_similar_sets_meet_in_a_bucket(n, seed, t):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    lose = r.integers(0, rtree_join.differing(len(a), t) + 1)
    b = np.unique(np.concatenate([r.permutation(a)[lose:], r.integers(0, 2**63, r.integers(0, 4), dtype=np.uint64)]))
    shared = len(np.intersect1d(a, b))
    if shared >= t * (len(a) + len(b) - shared):
        assert set(rtree_join.bucket_keys(a, t)) & set(rtree_join.bucket_keys(b, t))


@pytest.mark.parametrize("cuts", [1, 2, 5])
def test_sets_that_fill_too_few_groups_meet_by_their_shingles(monkeypatch, cuts):
    monkeypatch.setattr(rtree_join, "cuts_of", lambda level, t: cuts)
    r, t, met = np.random.default_rng(cuts), Fraction(80, 100), 0
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, r.integers(20, 90), dtype=np.uint64) * np.uint64(2))
        b = np.concatenate([r.permutation(a)[r.integers(0, 12):], r.integers(0, 2**63, r.integers(0, 9), dtype=np.uint64)])
        b = np.unique(b)
        shared = len(np.intersect1d(a, b))
        if shared >= t * (len(a) + len(b) - shared):
            met += 1
            assert set(rtree_join.bucket_keys(a, t)) & set(rtree_join.bucket_keys(b, t))
    assert met > 50


@pytest.mark.parametrize("size", [1, 31, 33, 500, 3000])
def test_tree_search_equals_the_bound_on_every_point(size):
    r = np.random.default_rng(size)
    vectors = r.poisson(r.uniform(2, 6, (size, 1)), (size, rtree_join.GROUPS))
    sizes, t = vectors.sum(axis=1), Fraction(85, 100)
    tree = rtree_join.CountTree(vectors, sizes)
    for q in r.integers(0, size, 5):
        bound = np.minimum(vectors, vectors[q]).sum(axis=1)
        want = (bound * 185 >= 85 * (sizes + sizes[q])) & (100 * sizes >= 85 * sizes[q]) & (85 * sizes <= 100 * sizes[q])
        assert set(tree.search(vectors[q], int(sizes[q]), t)) == set(np.flatnonzero(want))


@pytest.mark.parametrize("rows", [2])
def test_buckets_stream_over_small_batches(spark, rows):
    texts = [(i, " ".join(f"w{k + i % 4 * (k % 23 == 0)}" for k in range(90 + i % 3))) for i in range(15)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        got = rtree_join.similar_components(spark.createDataFrame(texts, "doc_id long, text string"), 75).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {x.doc_id: x.component_id for x in got} == plain_components({i: shingles(t) for i, t in texts}, 75)


def test_components_of_a_long_path(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(0, 90)] + [(500, 501), (7, 7)], "a long, b long")).collect()
    assert {r.v: r.label for r in got} == {**{i: 0 for i in range(91)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    odd = spark.createDataFrame([(1, 2, 9), (2, 1, 9), (1, 2, 8), (None, 2, 0), (3, None, 0), (5, 5, 0)], "a long, b long, v long")
    assert {r.v: r.label for r in components(odd).collect()} == {1: 1, 2: 1}


def test_edge_cases(edge, empty):
    got = rtree_join.similar_components(edge).toPandas()
    assert len(got) == edge.count()
    by = got.dropna(subset="doc_id").drop_duplicates("doc_id").set_index("doc_id")
    assert by.component_id[6] == 5 and by.component_id[9] == 9 and by.n_shingles[[1, 2, 3]].eq(0).all()
    assert rtree_join.similar_components(empty).count() == 0
    kept = rtree_join.one_of_each(edge)
    assert kept.columns == edge.columns and 6 not in {r.doc_id for r in kept.collect()}
    assert rtree_join.one_of_each(empty).count() == 0


def test_near_copies_without_an_id(spark):
    base, other = ([f"{k}{i}" for i in range(100)] for k in ("a", "b"))
    edited = lambda words, at: " ".join(w if i != at else "edited" for i, w in enumerate(words))
    rows = [(5, " ".join(base)), (None, edited(base, 40)), (None, edited(base, 41)), (None, edited(base, 41)), (7, "alone")]
    rows += [(None, " ".join(other)), (None, edited(other, 50)), (None, "alone as well")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_shingles, r.doc_id or 0, r.component_id or 0, r.linked) for r in rtree_join.similar_components(table).collect())
    assert got == sorted([(97, 5, 5, True), *[(97, 0, 5, True)] * 3, (1, 7, 7, False), *[(97, 0, 0, True)] * 2, (1, 0, 0, False)])
    assert rtree_join.one_of_each(table).count() == len(rows)


def test_keys_of_a_class_are_dealt_once_a_task(spark):
    table = spark.createDataFrame([(i, f"copies of one text {'x ' * 30}{'and another' if i % 9 == 0 else ''}") for i in range(300)],
                                  "doc_id long, text string").repartition(3)
    got = rtree_join.key_rows(table, Fraction(85, 100), 4).groupBy("key", "fp").count().collect()
    assert len({r.fp for r in got}) == 2 and max(r["count"] for r in got) <= 3


def test_rows_that_share_an_id_go_by_their_own_text(spark):
    base = [f"word{i}" for i in range(60)]
    near = " ".join(base[:-1] + ["edited"])
    rows = [(1, " ".join(base)), (5, near), (5, "a text that stands nowhere else " * 4), (5, None), (6, near), (None, " ".join(base)), (7, None)]
    kept = rtree_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [rows[0], rows[2], rows[3], rows[5], rows[6]]))
