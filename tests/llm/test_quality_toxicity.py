"""Operators 5 and 9: held-out accuracy, and the parts of the models against plain formulas."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobscope.llm import gam, toxicity
from jobscope.llm.queries import QUERIES

SF_MID = "/root/testdata/sf0.01"


def auc(score, label):
    rank = pd.Series(score).rank()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def truth():
    return pd.read_parquet(f"{SF_MID}/labels.parquet")


# Some of the small table's toxic labels stand on texts without any abuse, which no scorer can tell.
@pytest.mark.parametrize("query, column, threshold, least", [("op5_gam_quality", "quality", 0.7, 0.9), ("op9_toxicity", "toxic", 0.3, 0.75)])
def test_held_out_accuracy(spark, truth, query, column, threshold, least):
    got = QUERIES[query](spark, SF_MID).toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= threshold)).all()
    held = got[got.held_out].merge(truth, on="doc_id").reset_index(drop=True)
    assert len(held) > 50 and (held.predicted == held[column]).mean() > 0.9
    assert auc(held.score, held[column]) > least


def test_scores_read_the_text_alone(spark):
    """Other ids, languages and sources give the same scores."""
    rows = spark.createDataFrame([(10**9 + i, t, "xx", "yy") for i, t in enumerate(["a fine text of words " * 9, "", "!!! *** $$$"])],
                                 "doc_id long, text string, lang string, source string")
    model = gam.fit(np.random.default_rng(0).random((300, len(gam.FEATURES))), np.arange(300) % 2)
    here = [r.score for r in gam.quality_scores(rows, model).orderBy("doc_id").collect()]
    there = [r.score for r in gam.quality_scores(rows.withColumn("doc_id", -F.col("doc_id")), model).orderBy(F.desc("doc_id")).collect()]
    assert here == there


def test_additive_model_learns_single_and_paired_effects():
    r = np.random.default_rng(1)
    x = r.random((6000, 4))
    y = ((x[:, 0] > 0.6) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(float)  # no sum of single effects says this
    model = gam.fit(x[:4000], y[:4000])
    assert ((model.score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.85
    assert model.pairs and {0, 1, 2} >= set(model.pairs[0][:2])
    # a score is the sum of table entries
    total = model.intercept + sum(t[np.searchsorted(c, x[0, j], side="right")] for j, (c, t) in enumerate(zip(model.cuts, model.tables)))
    total += sum(t[np.searchsorted(model.pair_cuts[a], x[0, a], side="right"), np.searchsorted(model.pair_cuts[b], x[0, b], side="right")]
                 for a, b, t in model.pairs)
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_label_model_finds_accuracies_and_correlations():
    r = np.random.default_rng(2)
    truth = r.random(5000) < 0.2
    right = [0.95, 0.9, 0.85, 0.8]
    votes = np.stack([np.where(r.random(5000) < a, truth, ~truth) * 2 - 1 for a in right], axis=1)
    votes = np.concatenate([votes, votes[:, 3:]], axis=1)  # the weakest voter once more
    model = toxicity.fit_label_model(votes, 0.2)
    strength = model.log_odds[:, 2] - model.log_odds[:, 0]
    assert list(np.argsort(-strength)[:3]) == [0, 1, 2]
    assert model.correlations[3, 4] > 0.9 and abs(model.correlations[0, 1]) < 0.15
    assert model.weights[3] < 0.6 < model.weights[0]
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.94


def test_planted_abuse_is_caught_and_clean_text_left(spark):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    clean = [" ".join(r.choice(words, 60)) for _ in range(300)]
    abuse = ["idiot", "moron", "scum", "worthless", "zorgled"]
    toxic = [f"{' '.join(r.choice(words, 30))} {a} {' '.join(r.choice(words, 20))} {b}"
             for a, b in r.choice(abuse, (100, 2))]
    model = toxicity.fit(clean[:200] + toxic[:70], np.array([0] * 200 + [1] * 70))
    assert (model.score(toxic[70:]) >= 0.3).mean() > 0.95 and (model.score(clean[200:]) >= 0.3).mean() < 0.05


def test_edge_cases(spark, edge, empty, edge_labels):
    model = gam.fit_quality(edge, edge_labels)
    assert gam.quality_scores(edge, model).where("score is null").count() == 0
    assert gam.quality_scores(edge, model).count() == edge.count()
    assert gam.keep_good(edge, model, 0.0).columns == edge.columns and gam.keep_good(edge, model, 0.0).count() == edge.count()
    assert gam.keep_good(edge, model, 1.1).count() == 0
    nothing = gam.fit_quality(empty, edge_labels.limit(0))
    assert {r.score for r in gam.quality_scores(edge, nothing).collect()} == {0.5}
    assert gam.quality_scores(empty, model).count() == 0 and gam.keep_good(empty, model, 0.5).count() == 0
    for docs, labelled in ((edge, edge_labels), (empty, edge_labels.limit(0)), (edge, edge_labels.limit(0))):
        toxic = toxicity.fit_toxicity(docs, labelled)
        scores = toxicity.toxicity_scores(edge, toxic).toPandas()
        assert len(scores) == edge.count() and scores.score.between(0, 1).all()
    assert toxicity.toxicity_scores(empty, toxic).count() == 0


def test_the_top_word_may_stand_anywhere():
    at = gam.FEATURES.index("top_word")
    assert gam.features(b"one two three " + b"spam " * 7)[at] == 0.7
    assert gam.features(b"spam spam one two")[at] == 0.5
