"""Mixing sources to target weights by soft membership (operator 3).

A naive Bayes classifier over hashed words, counted from a labelled table (id, domain), gives every document posterior
shares of the domains.  A document's rate is how often it is to be seen; with rates r, document tokens t and posteriors p
the expected tokens of domain k are sum(r t p_k).  Nonnegative rates that bring these totals to the targets are found
by projected gradient steps on the squared gaps, starting at rate 1: in the metric of the token counts a step moves a
document's rate by the inner product of its posteriors with one vector of K numbers and cuts it off at 0.  The vector
is the gaps scaled by the inverse of the K x K matrix sum(t p p') over the documents whose rate is above 0, so a step
that cuts off nothing new closes the gaps; where it doesn't help, a more cautious one is taken, at last the plain
gradient.  A fit ends when the worst gap is ``TOLERANCE`` of all target tokens; where targets are out of reach, when no
step helps or after ``PASSES`` passes.  The gaps that are left are returned, and above ``TOLERATED`` a warning names
them.

DataFrame functions only.  One pass over the texts writes tokens and posteriors; every gradient step is one aggregation
of that table to K sums, and the rates are a function of a document's posteriors and the list of step vectors, so no
state is shuffled or stored between steps.  The labelled sample is at most about ``SAMPLE_ROWS`` rows.

Edge cases: null and empty texts have no tokens and the prior as posteriors; a null domain or one without a target
teaches nothing; without labelled rows all posteriors are equal; a domain with a target that no text can belong to
keeps its gap; rows are rated each for itself, so rows with equal
texts get equal rates, whatever their ids, and :func:`mixed` repeats rows of one id alike if their rates are; an empty table gives an empty result;
only id and text are read for scores, and :func:`mixed` keeps all columns.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import written

BLANKS = r"[\x20\x09-\x0D]+"
BUCKETS = 4096
SAMPLE_ROWS = 8_000
SMOOTHING = 0.5
# Posteriors are softened: a text's evidence counts as that of so many words at most.
EVIDENCE_WORDS = 40
# Passes over the table of posteriors that a fit takes at most (targets within reach are met in some ten).
PASSES = 60
TOLERANCE = 1e-7
# Share of all target tokens by which a target may be missed without a word.
TOLERATED = 1e-4


def _constant(value: object, kind: str) -> Column:
    """A literal that the optimiser folds to one constant."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _let(value: Column, body) -> Column:
    """``body`` over a value that is worked out once a row."""
    return F.transform(F.array(value), body)[0]


def _buckets(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(BUCKETS)).cast("int"))


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text",
                rows: int = SAMPLE_ROWS) -> dict:
    """Log weights by domain and bucket, and log priors, from a bounded sample of ``labelled`` (id, domain)."""
    known = labelled.select(F.col(id_col).alias("l_id"), F.col("domain").cast("string").alias("domain")) \
        .where(F.col("domain").isin(domains))
    share = min(1.0, rows / max(known.count(), 1))
    sample = known.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 20)) < int(share * (1 << 20)))  # bounded: may be broadcast
    taught = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text")) \
        .join(F.broadcast(sample), F.col("d_id") == F.col("l_id"))
    counts = taught.select("domain", F.explode(_buckets(F.col("text"))).alias("b")).groupBy("domain", "b").count().collect()
    n = np.zeros((len(domains), BUCKETS))
    for r in counts:
        n[domains.index(r["domain"]), r["b"]] = r["count"]
    in_domain = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    prior = np.array([in_domain.get(d, 0) + SMOOTHING for d in domains])
    weights = np.log((n + SMOOTHING) / (n.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    return {"domains": domains, "prior": np.log(prior / prior.sum()), "weights": weights - weights.mean(axis=0)}


def _summed(buckets: Column, weights: Column) -> Column:
    return F.aggregate(buckets, F.lit(0.0), lambda a, i: a + F.get(weights, i))


def posteriors(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` (words) and ``p`` (posterior shares in the order of the model's domains)."""
    k = len(model["domains"])
    table = [_constant([round(float(x), 6) for x in w], "array<double>") for w in model["weights"]]

    def logits(s: Column) -> Column:
        share = F.least(F.lit(1.0), F.lit(float(EVIDENCE_WORDS)) / F.greatest(s["n"], F.lit(1)))
        return F.array(*[F.lit(float(model["prior"][j])) + s[f"s{j}"] * share for j in range(k)])

    def softmax(z: Column) -> Column:
        return _let(F.transform(z, lambda x: F.exp(x - F.array_max(z))), lambda e: _let(
            F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(e, lambda x: x / total)))

    sums = _let(_buckets(F.col(text_col)), lambda b: F.struct(
        F.size(b).alias("n"), *[_summed(b, table[j]).alias(f"s{j}") for j in range(k)]))
    scored = _let(sums, lambda s: F.struct(s["n"].cast("long").alias("tokens"), _let(logits(s), softmax).alias("p")))
    return docs.withColumn("scored", scored).withColumns({"tokens": F.col("scored.tokens"), "p": F.col("scored.p")}).drop("scored")


def rate_column(steps: list[list[float]]) -> Column:
    """The rate after all ``steps``, from the posteriors ``p``."""
    if not steps:
        return F.lit(1.0)
    k = len(steps[0])
    return F.aggregate(_constant(steps, "array<array<double>>"), F.lit(1.0), lambda r, g: F.greatest(
        F.lit(0.0), r - reduce(lambda a, b: a + b, [F.get("p", F.lit(j)) * F.get(g, F.lit(j)) for j in range(k)])))


@dataclass(frozen=True)
class Rates:
    """Step vectors, and by how many tokens the totals exceed the targets after them."""

    steps: list[list[float]]
    gaps: list[float]


def fit_rates(table: DataFrame, targets: list[float]) -> Rates:
    """Rates that bring the expected tokens by domain to ``targets`` (tokens), as far as they can be."""
    k = len(targets)
    target, total = np.array(targets, dtype=float), max(float(np.sum(targets)), 1.0)

    def sums(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Gaps, and sum(t p p') over the documents with a rate above 0."""
        rated = table.select("tokens", "p", rate_column(steps).alias("r"))
        share = [F.get("p", F.lit(j)) for j in range(k)]
        parts = [F.sum(F.col("r") * F.col("tokens") * share[j]) for j in range(k)]
        parts += [F.sum(F.when(F.col("r") > 0, F.col("tokens") * share[a] * share[b])) for a in range(k) for b in range(k)]
        row = np.array([x or 0.0 for x in rated.agg(*[x.alias(f"s{i}") for i, x in enumerate(parts)]).first()], dtype=float)
        return row[:k] - target, row[k:].reshape(k, k)

    steps = []
    gap, m = sums(steps)
    if not m.any():
        return Rates(steps, gap.tolist())
    size = np.trace(m)
    safe = np.eye(k) / np.linalg.eigvalsh(m).max()
    passes = 1
    while passes < PASSES and np.abs(gap).max() > TOLERANCE * total:
        # from the scaled step to the plain gradient, which always helps while anything can
        ways = [(np.linalg.inv(m + np.eye(k) * ridge * size), 0.9) for ridge in (1e-9, 1e-2)] + [(safe, 1 - 1e-6)]
        for metric, enough in ways:
            step = (metric @ gap).tolist()
            new_gap, new_m = sums([*steps, step])
            passes += 1
            if new_gap @ new_gap < enough * (gap @ gap):
                steps, gap, m = [*steps, step], new_gap, new_m
                break
        else:
            break
    if np.abs(gap).max() > TOLERATED * total:
        warnings.warn(f"targets are out of reach; gaps by domain: {gap.tolist()} of {target.tolist()} tokens", stacklevel=2)
    return Rates(steps, gap.tolist())


def token_targets(table: DataFrame, weights: list[float], never_drop: bool = False) -> list[float]:
    """Targets in tokens for weights by domain: the table's tokens shared out, or (``never_drop``) the least total at
    which no domain has to shrink."""
    k = len(weights)
    sums = table.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(j))).alias(f"s{j}") for j in range(k)]).first()
    now = np.array([x or 0.0 for x in sums], dtype=float)
    share = np.array(weights, dtype=float) / sum(weights)
    total = (now[share > 0] / share[share > 0]).max() if never_drop else now.sum()
    return [float(x) for x in total * share]


def document_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id",
                   text_col: str = "text", never_drop: bool = False) -> DataFrame:
    """``doc_id, tokens, p, domain, rate`` for every row of ``docs``; ``labelled`` has the id and ``domain``."""
    domains = sorted(weights)
    model = fit_domains(docs, labelled, domains, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = written(posteriors(rows, model).drop("text"), "posteriors")
    steps = fit_rates(table, token_targets(table, [weights[d] for d in domains], never_drop)).steps
    best = F.get(_constant(domains, "array<string>"), (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    return table.withColumn("domain", best).withColumn("rate", rate_column(steps))


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
          never_drop: bool = False) -> DataFrame:
    """``docs`` with every row repeated as its rate says: the whole part, and once more with the chance of the rest,
    drawn from a hash of the id."""
    domains = sorted(weights)
    model = fit_domains(docs, labelled, domains, id_col, text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                         F.col(text_col).alias("text"))
    # the rows are written with their posteriors: the texts are scored once, the fit reads two narrow columns
    table = written(posteriors(packed, model).drop("text"), "posteriors")
    steps = fit_rates(table.select("tokens", "p"), token_targets(table, [weights[d] for d in domains], never_drop)).steps
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 30)) / (1 << 30)
    # a rate that is a whole number but for rounding stays that number
    copies = F.greatest(F.floor(rate_column(steps) + chance + 1e-6).cast("int"), F.lit(int(never_drop)))
    return table.select("row", copies.alias("copies")).where(F.col("copies") > 0) \
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
