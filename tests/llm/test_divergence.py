"""Operator 13 against plain Python with whole numbers of any size."""
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobscope.llm import divergence
from jobscope.llm.queries import QUERIES

from .conftest import SF


def plain(rows, min_docs=30, top=50):
    """Rows (lang, source, text)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}

        def p(n, of):
            return 1 + 10**9 * (n + 5) // (of + 5 * len(kept))
        q = {t: p(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        ps = {s: {t: p(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        for s in sources:
            pairs = [(-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - ps[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and ps[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(found)[:limit])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_query(spark, docs):
    assert result(QUERIES["op13_source_divergence"](spark, SF)) == plain(zip(docs.lang, docs.source, docs.text))


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)


@pytest.mark.parametrize("bounds", [{}, {"limit": 16, "entries": 3, "shard_entries": 4, "block_cells": 5}])
def test_small_bounds_change_nothing(spark, bounds):
    rng = np.random.default_rng(5)
    words = ["a", "B", "été", "ÉTÉ", "日本", "zeta", "don", "x\U0001f600"]
    rows = [(str(rng.choice(["en", "fr"])), f"s{rng.integers(5)}", "'t, 3 ".join(rng.choice(words, rng.integers(0, 9)))) for _ in range(120)]
    rows += [(None, None, "a a b"), ("en", None, None), ("xx", "s1", ""), ("xx", "s2", None), ("en", "s9", "")]
    for min_docs, top in ((1, 3), (8, 50), (1000, 50)):
        assert result(divergence.divergences(table(spark, rows), min_docs, top, **bounds)) == plain(rows, min_docs, top)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**15), st.integers(0, 10**15), st.integers(1, 10**9))
def test_scaled_is_exact(a, b, terms):
    count, total = min(a, b), max(a, b)
    assert int(divergence.scaled(np.array([count]), total, terms)[0]) == 1 + 10**9 * (count + 5) // (total + 5 * terms)


def test_edge_cases(edge, empty):
    rows = [(r.lang, r.source, r.text) for r in edge.select("lang", "source", "text").collect()]
    assert result(divergence.divergences(edge, 1, 4)) == plain(rows, 1, 4)
    assert result(divergence.divergences(edge, 30)) == plain(rows, 30)
    assert divergence.divergences(empty).count() == 0
