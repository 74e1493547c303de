"""Quality classifier: a generalised additive model with pairwise interactions (operator 5).

Every document becomes a row of surface features.  The model is a sum of lookup tables: one per feature and one per
chosen pair of features, each grown by cyclic gradient boosting of shallow trees (up to three leaves on one feature;
one cut on one feature and one on the other for a pair).  A tree on binned values is a step over the bins, so adding
it to the table is all that remains of it, and scoring is a vectorised sum of table look-ups.

The labels are learned from a bounded sample: at most about ``SAMPLE_ROWS`` labelled rows, chosen by a hash of their
id (all of them while there are fewer).  Their features, a few numbers a row, are what the driver fits on.  Scoring
covers every document and its whole text, map-only.

Edge cases: null and empty texts are scored like any other (all their features are 0); without labelled rows every
score is 0.5, with one class only it is that class's smoothed share; rows with a null label teach nothing; repeated
rows are scored each for itself; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import id_text, map_batches, text_pieces

# Bound on the labelled rows that the model is fitted on.
SAMPLE_ROWS = 20_000
MAX_BINS = 48
PAIR_BINS = 10
ROUNDS = 120
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.15
PRIOR = 5.0
SCORE_SCHEMA = "doc_id long, score double"

FEATURES = ["log_words", "log_chars", "word_length", "symbols", "bangs", "upper", "digits", "pipes", "stops", "commas",
            "non_ascii", "distinct_words", "same_next", "repeated_triples", "top_word", "marked_words", "log_lines",
            "repeated_lines", "words_a_line", "first_half_new"]


def _class_matrix() -> np.ndarray:
    """Byte value -> byte classes, in the order that :func:`features` uses them."""
    m = np.zeros((256, 9))
    for i, members in enumerate((b"#*$%&<>|^~_=+@\\{}[]", b"!", bytes(range(65, 91)), b"0123456789", b"|", b".", b",",
                                 bytes(range(128, 256)), bytes(range(97, 123)) + bytes(range(65, 91)))):
        m[list(members), i] = 1
    return m


_CLASSES = _class_matrix()
_MARKS = frozenset(b"#*$%&<>|!^~=+@")


def features(text: bytes) -> list[float]:
    """The surface features of one whole text."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    symbols, bangs, upper, digits, pipes, stops, commas, wide, letters = \
        np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    distinct = set(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = len(set(zip(words, words[1:], words[2:])))
    half = n // 2
    head = set(words[:half]) if half >= 10 else distinct
    return [np.log1p(n), np.log1p(size), (size - n) / n, symbols / size, bangs / n, upper / max(letters, 1), digits / size,
            pipes / n, stops / n, commas / n, wide / size, len(distinct) / n, sum(map(eq, words, words[1:])) / n,
            1 - triples / max(n - 2, 1) if n > 2 else 0.0, max(Counter(words).values()) / n,
            sum(w[-1] in _MARKS for w in words) / n, np.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1),
            n / max(len(lines), 1), (len(distinct) - len(head)) / max(n - half, 1) if half >= 10 else 1.0]


def feature_matrix(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return np.array([features(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], dtype=float).reshape(-1, len(FEATURES))


@dataclass
class Gam:
    """Lookup tables over binned features; a score is the logistic sum of the tables' entries."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_cuts[a], x[:, a], side="right"),
                           np.searchsorted(self.pair_cuts[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    q = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))
    return q[q > values.min()]


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PRIOR)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place (first bin of the right side) of the best single cut."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves on one binned feature, as values by bin."""
    _, at = _best_cut(g, h)
    parts = [(0, at), (at, len(g))] if at else [(0, len(g))]
    best = max(parts, key=lambda p: _best_cut(g[p[0]:p[1]], h[p[0]:p[1]])[0])
    gain, inner = _best_cut(g[best[0]:best[1]], h[best[0]:best[1]])
    if inner and gain > 0:
        parts.remove(best)
        parts += [(best[0], best[0] + inner), (best[0] + inner, best[1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + PRIOR)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut on the rows, then on the columns of each side: gain and values by cell."""
    best = (0.0, np.zeros_like(g))
    for at in range(1, g.shape[0]):
        out, gain = np.zeros_like(g), -_gain(g.sum(), h.sum())
        for a, b in ((0, at), (at, g.shape[0])):
            cg, ch = g[a:b].sum(axis=0), h[a:b].sum(axis=0)
            extra, cut = _best_cut(cg, ch)
            gain += _gain(cg.sum(), ch.sum()) + extra
            for c, d in ((0, cut), (cut, len(cg))):
                if d > c:
                    out[a:b, c:d] = cg[c:d].sum() / (ch[c:d].sum() + PRIOR)
        if gain > best[0]:
            best = (float(gain), out)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Boost the tables on feature rows ``x`` and labels ``y`` (0 or 1)."""
    if not len(y):
        return Gam()
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(intercept=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    k = x.shape[1]
    model.cuts = [_cuts(x[:, j], MAX_BINS) for j in range(k)]
    binned = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(k):  # cyclic: every feature takes its small step in turn
            if len(model.tables[j]) < 2:
                continue
            g, h = slopes()
            step = RATE * _step(np.bincount(binned[j], g, len(model.tables[j])), np.bincount(binned[j], h, len(model.tables[j])))
            model.tables[j] += step
            total += step[binned[j]]

    model.pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(k)]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]
    size = [len(c) + 1 for c in model.pair_cuts]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * size[b] + coarse[b], v, size[a] * size[b]).reshape(size[a], size[b])

    g, h = slopes()
    gains = [(_pair_tree(grid(a, b, g), grid(a, b, h))[0], a, b) for a, b in combinations(range(k), 2)
             if size[a] > 1 and size[b] > 1]
    chosen = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    tables = {p: np.zeros((size[p[0]], size[p[1]])) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for a, b in chosen:
            g, h = slopes()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))[1]
            tables[a, b] += step
            total += step[coarse[a], coarse[b]]
    model.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return model


def sampled_labels(labelled: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """About ``rows`` labelled rows at most, by a hash of the id: ``doc_id, label``."""
    known = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")) \
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    share = min(1.0, rows / max(known.count(), 1))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit_quality(docs: DataFrame, labelled: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                text_col: str = "text", rows: int = SAMPLE_ROWS) -> Gam:
    """Fit on a bounded sample of ``labelled`` (id, label); its features are all that reaches the driver."""
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_pieces(batches):
            x = feature_matrix(data, offsets)
            yield pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    sample = sampled_labels(labelled, id_col, label_col, rows)  # bounded, so it may be broadcast
    taught = id_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("label", "text")
    found = map_batches(taught, rows_of, "label double, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    y = found["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same fit, however the rows arrive
    return fit(x[order], (y[order] > 0).astype(float))


def quality_scores(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_pieces(batches):
            yield pa.record_batch([batch.column(0), pa.array(shared.value.score(feature_matrix(data, offsets)))],
                                  names=["doc_id", "score"])

    return map_batches(id_text(docs, id_col, text_col), score, SCORE_SCHEMA)


def keep_good(docs: DataFrame, model: Gam, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).fill_null("") if batch.num_rows else batch.column(at)
            for piece, data, offsets in text_pieces(iter([pa.record_batch([pa.array(range(batch.num_rows)), texts],
                                                                          names=["row", "text"])])):
                good = shared.value.score(feature_matrix(data, offsets)) >= threshold
                yield batch.take(piece.column(0).filter(pa.array(good)))

    return map_batches(docs, keep, docs.schema)


def verdicts(scores: DataFrame, held_out: Column, threshold: float) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    return scores.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
