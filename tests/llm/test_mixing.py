"""Operator 3: totals meet the targets; the classifier tells the domains apart."""
import numpy as np
import pytest
from .conftest import SF
from pyspark.sql import functions as F

from jobscope.llm import mixing
from jobscope.llm.common import documents
from jobscope.llm.queries import DOMAIN_WEIGHTS, QUERIES, labelled_domains


def test_expected_tokens_meet_the_targets(spark, docs):
    got = QUERIES["op3_mixing"](spark, SF).toPandas()
    assert (got.rate >= 0).all() and len(got) == len(docs)
    for domain, weight in DOMAIN_WEIGHTS.items():
        assert (got.rate * got.tokens * got[f"p_{domain}"]).sum() / got.tokens.sum() == pytest.approx(weight, abs=1e-4)
    assert np.allclose(got[[f"p_{d}" for d in DOMAIN_WEIGHTS]].sum(axis=1), 1)
    same = got.merge(docs[["doc_id", "lang"]], on="doc_id")
    assert (same.domain == same.lang).mean() > 0.9


def projected_gradient(t, p, target, steps=60_000):
    """Plain projected gradient on the squared gaps, in the metric of the token counts, with a fixed safe step."""
    rate = np.ones(len(t))
    size = 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p).max()
    for _ in range(steps):
        rate = np.maximum(0, rate - size * (p @ ((t * rate) @ p - target)))
    return (t * rate) @ p - target


def random_table(spark, seed, spread, rows=300, k=3):
    r = np.random.default_rng(seed)
    p, t = r.dirichlet([spread] * k, rows), r.integers(1, 500, rows)
    return r, p, t, spark.createDataFrame([(int(n), [float(x) for x in row]) for n, row in zip(t, p)], "tokens long, p array<double>").cache()


@pytest.mark.parametrize("seed,spread,k", [(1, 0.05, 4), (2, 0.3, 3), (3, 1.0, 5), (4, 0.1, 2)])
def test_targets_within_reach_are_met(spark, seed, spread, k):
    r, p, t, table = random_table(spark, seed, spread, k=k)
    wanted = np.maximum(0, r.normal(0.6, 1.0, len(t))) * p[:, 0]  # some nonnegative rates reach the targets
    target = (t * wanted) @ p
    fit = mixing.fit_rates(table, target.tolist())
    rate = np.array([x.r for x in table.select(mixing.rate_column(fit.steps).alias("r")).collect()])
    gap = (t * rate) @ p - target
    assert (rate >= 0).all() and np.allclose(gap, fit.gaps, atol=1e-6 * target.sum())
    assert np.abs(gap).max() <= 1e-6 * target.sum()
    assert np.abs(projected_gradient(t, p, target)).max() <= 1e-3 * target.sum()


def test_targets_out_of_reach_are_named(spark):
    """The first domain has to vanish, and can't while others stay."""
    _, p, t, table = random_table(spark, 3, 0.6, 200)
    target = np.array([0.0, 0.7, 0.3]) * t.sum() * 1.5
    with pytest.warns(UserWarning, match="out of reach"):
        fit = mixing.fit_rates(table, target.tolist())
    rate = np.array([x.r for x in table.select(mixing.rate_column(fit.steps).alias("r")).collect()])
    assert (rate >= 0).all() and np.allclose((t * rate) @ p - target, fit.gaps, atol=1e-6 * target.sum())
    assert np.linalg.norm(fit.gaps) < 0.2 * np.linalg.norm(t @ p - target)


def test_rows_are_repeated_as_the_rates_say(spark, docs):
    d = documents(spark, SF)
    out = mixing.mixed(d, labelled_domains(spark, d, SF), DOMAIN_WEIGHTS, never_drop=True)
    assert out.columns == d.columns
    seen = out.groupBy("doc_id").count().toPandas()
    assert set(seen.doc_id) == set(docs.doc_id) and seen["count"].max() > 1
    fewer = mixing.mixed(d, labelled_domains(spark, d, SF), DOMAIN_WEIGHTS).count()
    assert 0 < fewer < out.count()


def test_edge_cases(spark, edge, empty):
    labelled = spark.createDataFrame([(5, "en"), (4, "de"), (7, "fr"), (None, "en"), (2, None)], "doc_id long, domain string")
    got = mixing.document_rates(edge, labelled, {"en": 1.0, "de": 1.0, "fr": 0.0}).toPandas()
    assert len(got) == edge.count() and got.rate.notna().all()
    none = labelled.limit(0)
    assert mixing.document_rates(edge, none, {"en": 1.0, "de": 1.0}).where(F.col("rate") < 0).count() == 0
    assert mixing.document_rates(empty, labelled, {"en": 1.0, "de": 1.0}).count() == 0
    assert mixing.mixed(empty, labelled, {"en": 1.0, "de": 1.0}).count() == 0
    assert mixing.mixed(edge, labelled, {"en": 1.0, "de": 1.0}, never_drop=True).count() >= edge.count()
