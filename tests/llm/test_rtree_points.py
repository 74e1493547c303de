"""Points of the Jaccard join: long texts that share little are told apart before their sets travel."""
from fractions import Fraction

import numpy as np
import pytest

from jobscope.llm import rtree_join

T = Fraction(80, 100)


def random_set(r, n):
    return np.unique(r.integers(0, 2**64, n, dtype=np.uint64))


def edited(r, h, n_lost, n_new):
    return np.unique(np.concatenate([r.permutation(h)[n_lost:], random_set(r, n_new)]))


def similarity(x, y):
    shared = len(np.intersect1d(x, y))
    return Fraction(shared, len(x) + len(y) - shared)


def test_long_sets_that_share_one_shingle_are_no_pair(spark):
    r = np.random.default_rng(1)
    common = random_set(r, 1)
    sets = [np.unique(np.concatenate([common, random_set(r, 4800)])) for _ in range(40)]
    sets += [edited(r, sets[0], 300, 300), edited(r, sets[1], 0, 1100)]
    classes = spark.createDataFrame([(i, len(h), rtree_join.packed(rtree_join.points(h))) for i, h in enumerate(sets)],
                                    "fp long, n long, point binary")
    # one bucket under a tree, and small ones without
    rows = [(0, 0, i, i) for i in range(42)] + [(1 + i, 1 + i, j, j) for i in range(10) for j in (i, i + 10, 40 + i % 2)]
    members = spark.createDataFrame(rows, "key long, low long, fp long, comp long")
    got = {(x.a, x.b) for x in rtree_join.search_pairs(members, classes, T).collect()}
    assert got == {(0, 40), (1, 41)}


@pytest.mark.parametrize("seed", range(4))
def test_no_linked_pair_is_passed_over(seed):
    """Also where the two have different numbers of groups, or counts above a byte."""
    r = np.random.default_rng(seed)
    for n in (1, 9, 127, 1000, 1020, 1030, 2040, 2050, 5000, 9000):
        a = random_set(r, n)
        if seed == 3:  # all in a few groups
            a = np.unique(a & ~np.uint64(rtree_join.MOST_GROUPS - 1))
        lose = r.integers(0, rtree_join.differing(len(a), T) // 2 + 1)
        for b in (edited(r, a, lose, lose // 2), edited(r, a, 0, rtree_join.differing(len(a), T)), edited(r, a, len(a) // 5, 0)):
            linked = similarity(a, b) >= T
            points_ = [rtree_join.packed(rtree_join.points(h)) for h in (a, b)]
            sizes = np.array([len(a), len(b)])
            for x, y in ((0, 1), (1, 0)):
                fits = rtree_join.leave_room(points_, sizes, np.array([x]), np.array([y]), T)[0]
                assert fits or not linked


def test_points_fold():
    r = np.random.default_rng(5)
    for n in (10, 1023, 1024, 4096, 200_000):
        h = random_set(r, n)
        for s in (h, h & ~np.uint64(rtree_join.MOST_GROUPS - 1)):
            width = rtree_join.width_of(len(h))
            assert rtree_join.GROUPS <= width <= rtree_join.MOST_GROUPS
            for less in (rtree_join.GROUPS, width):
                got = rtree_join.unpacked([rtree_join.packed(rtree_join.points(s))], np.array([len(s)]), less)
                assert (got == np.bincount((s & np.uint64(less - 1)).astype(np.int64), minlength=less)).all()
