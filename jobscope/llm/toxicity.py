"""Toxicity by weak supervision (operator 9).

Many weak voters look at a text: hand-written lexicons (by theme and language), patterns (second-person address,
shouting, repeated abuse, several themes at once) and term lists mined from the labelled rows.  Each votes toxic,
clean, or nothing.  A generative label model, fitted without the labels by expectation maximisation, estimates how
each voter votes given the unseen class; pairs of voters that agree beyond what the class explains are correlated, and
a voter's evidence is shared out among those it is correlated with.  Its posteriors are the targets of a linear
classifier over words, stems and votes, which scores every text.

Labels mine the term lists and set the share of toxic rows, from a bounded sample of at most about ``SAMPLE_ROWS``
labelled rows and ``SAMPLE_BYTES`` bytes of their texts; the label model and the classifier are fitted on those rows' votes and words.
Scoring covers every document and its whole text, map-only.

Edge cases: null and empty texts get the score of a text without any word; without labelled rows the share of toxic
rows is ``DEFAULT_SHARE`` and the lexicons and patterns vote alone on that empty sample; repeated rows are scored each
for itself; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import CHUNK_BYTES, id_text, map_batches, row_chunks
from jobscope.llm.gam import SCORE_SCHEMA, sampled_labels

# Bound on the labelled rows that voters, label model and classifier are fitted on.
SAMPLE_ROWS = 20_000
# Bound on the text of those rows; beyond it, a hash of the id thins them out.
SAMPLE_BYTES = 24_000_000
DEFAULT_SHARE = 0.1
# Words and stems of the classifier: the most frequent of the sample, that occur in so many of its documents at least.
VOCABULARY = 30_000
LEAST_DOCS = 5
# Characters of a stem (and one more).
STEM = 4
MINED_LISTS = 4
MINED_TERMS = 80
EM_ROUNDS = 60
FIT_ROUNDS = 300
RIDGE = 2.0

# Abusive terms by theme, as one would note them down for a first filter.
LEXICONS = {
    "wits": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile imbeciles fool fools "
            "brainless dimwit halfwit dunce simpleton cretin nitwit airhead blockhead numbskull retard retarded",
    "worth": "loser losers worthless pathetic useless trash garbage nobody failure waste pitiful hopeless inferior "
             "laughable lowlife deadbeat",
    "disgust": "scum scumbag disgusting filth filthy vile vermin repulsive revolting sickening gross nasty pig pigs "
               "rat rats cockroach parasite maggot slime sleazy",
    "mockery": "clown clowns joke freak freaks creep creeps weirdo crybaby coward cowards wimp buffoon jerk jerks "
               "tool dork dweeb geek brat",
    "profanity": "damn damned crap crappy bullshit shit shitty ass asshole bastard bastards bitch bitches fuck fucked "
                 "fucker fucking piss prick dick dickhead douche douchebag motherfucker wanker twat slut whore cunt",
    "hostility": "hate hateful despise loathe detest shutup kill murder strangle destroy exterminate perish",
    "spanish": "idiota idiotas imbécil imbéciles estúpido estúpida tonto tonta payaso basura asqueroso asquerosa inútil "
               "patético patética perdedor escoria mierda cabrón pendejo gilipollas puta puto",
    "french": "idiote imbécile crétin crétine stupide abruti abrutie débile connard connasse salaud salope ordure merde "
              "minable pathétique dégoûtant raté bouffon clochard enculé",
    "german": "dumm dummkopf trottel blödmann blöd vollidiot schwachkopf versager abschaum widerlich erbärmlich wertlos "
              "arschloch scheiße scheisse schwein drecksack hurensohn wichser missgeburt",
}
_WORD = re.compile(r"\w+")
_ADDRESS = re.compile(r"\b(?:you|youre|your|u|tu|vous|du|ihr|eres)\b[^\w\n]{1,3}(?:\w+[^\w\n]{1,3}){0,2}?(\w+)")


@dataclass
class Voters:
    """All voters: each says 1 (toxic), -1 (clean) or 0 (nothing) on a text."""

    lists: list[tuple[str, frozenset]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.themes = [n for n, _ in self.lists]
        self.of: dict[str, int] = {}
        for i, (_, terms) in enumerate(self.lists):
            for t in terms:
                self.of[t] = self.of.get(t, 0) | 1 << i
        self.terms = frozenset(self.of)

    @property
    def names(self) -> list[str]:
        return [*self.themes, "address", "shouting", "several themes", "several terms", "dense", "nothing found"]

    def votes(self, text: str, words: list[str], distinct: set[str]) -> list[int]:
        hits = distinct & self.terms
        if not hits:
            return [0] * (len(self.themes) + 5) + [-1]
        mask = 0
        for w in hits:
            mask |= self.of[w]
        by_list = [1 if mask >> i & 1 else 0 for i in range(len(self.themes))]
        n_hits = sum(w in hits or w[:STEM] + "-" in hits or w[:STEM + 1] + "-" in hits for w in words)
        written = sum(by_list[:len(LEXICONS)])  # the hand-written lists come first
        address = any(m.group(1) in hits for m in _ADDRESS.finditer(text.lower()))
        shouting = any(w.upper() in text for w in hits if len(w) > 2)
        return [*by_list, int(address), int(shouting), int(written >= 2), int(len(hits) >= 3),
                int(100 * n_hits >= len(words)), 0]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms_of(words: list[str]) -> set[str]:
    """Distinct words, and the stems that inflected and compound words begin with (marked by a hyphen)."""
    distinct = set(words)
    longer = [w for w in distinct if len(w) > STEM]
    return distinct.union([w[:STEM] + "-" for w in longer], [w[:STEM + 1] + "-" for w in longer])


def mine_terms(texts: list[set[str]], toxic: np.ndarray) -> list[frozenset]:
    """Words that toxic rows have far more often than others, dealt out to a few lists by strength in turn."""
    with_word: tuple[Counter, Counter] = (Counter(), Counter())
    for words, t in zip(texts, toxic):
        with_word[int(t)].update(words)
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    if not n1 or not n0:
        return []
    lift = [(np.log((c + 0.5) / (n1 + 1)) - np.log((with_word[0][w] + 0.5) / (n0 + 1)), w)
            for w, c in with_word[1].items() if c >= max(LEAST_DOCS, 0.02 * n1)]
    best = [w for g, w in sorted(lift, reverse=True)[:MINED_TERMS] if g > np.log(20)]
    return [x for i in range(MINED_LISTS) if (x := frozenset(best[i::MINED_LISTS]))]


@dataclass
class LabelModel:
    """P(class) and, by voter, P(vote | class); evidence weights from the voters' correlations."""

    share: float
    log_odds: np.ndarray  # voter x vote (-1, 0, 1)
    weights: np.ndarray
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.log(self.share / (1 - self.share)) + \
            (self.weights * np.take_along_axis(self.log_odds, votes.T + 1, axis=1).T).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(votes: np.ndarray, share: float) -> LabelModel:
    """Expectation maximisation over the votes alone; ``share`` of toxic rows is given.

    The start says that a voter is right rather than wrong; each round shares out a voter's evidence among those
    whose votes agree with its own beyond what the class explains, then estimates classes and accuracies anew.
    """
    n, k = votes.shape
    odds = np.zeros((k, 3))
    odds[:, 2], odds[:, 0] = 1.5, -1.5
    model = LabelModel(share, odds, np.ones(k), np.eye(k))
    if not n:
        return model
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(EM_ROUNDS):
        p = model.posterior(votes)
        rates = []
        for w in (1 - p, p):
            rates.append((np.einsum("i,ikv->kv", w, onehot) + 0.1) / (w.sum() + 0.3))
        mean = [r[:, 2] - r[:, 0] for r in rates]
        residual = votes - np.outer(1 - p, mean[0]) - np.outer(p, mean[1])
        scale = np.sqrt((residual ** 2).mean(axis=0)) + 1e-6
        correlation = (residual / scale).T @ (residual / scale) / n
        np.fill_diagonal(correlation, 1.0)
        weights = 1 / np.where(np.abs(correlation) > 0.1, np.abs(correlation), 0).sum(axis=1)
        model = LabelModel(share, np.log(rates[1]) - np.log(rates[0]), weights, correlation)
    return model


@dataclass
class ToxicityModel:
    voters: Voters
    labels: LabelModel
    words: dict[str, float]
    vote_weights: np.ndarray
    intercept: float

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        known = self.words.keys()
        for i, text in enumerate(texts):
            words = words_of(text)
            distinct = terms_of(words)
            out[i] += sum(self.words[w] for w in known & distinct)
            out[i] += self.vote_weights @ self.voters.votes(text, words, distinct)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_linear(rows: list[np.ndarray], width: int, target: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Logistic regression on sparse binary rows (column numbers) with soft targets, by accelerated gradient steps."""
    n = len(rows)
    w, look = np.zeros(width + 1), np.zeros(width + 1)
    if not n:
        return w
    column = np.concatenate(rows) if n else np.zeros(0, int)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    # per-coordinate steps: half the inverse of each column's curvature bound, rows having up to `most` entries
    most = np.bincount(row, minlength=n).max() + 1
    curve = np.append(np.bincount(column, minlength=width), n) * np.sqrt(most) / 4 + RIDGE
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(look[-1] + np.bincount(row, look[column], n), -30, 30)))
        gap = p - target
        slope = np.append(np.bincount(column, gap[row], width), gap.sum()) + RIDGE * np.append(look[:-1], 0)
        new = look - slope / curve
        look = new + t / (t + 3) * (new - w)
        w = new
    return w


def fit(texts: list[str], toxic: np.ndarray) -> ToxicityModel:
    """Voters, label model and classifier from texts with labels (0 or 1)."""
    distinct = [{sys.intern(w) for w in terms_of(words_of(t))} for t in texts]
    mined = mine_terms(distinct, toxic)
    voters = Voters([(n, frozenset(t.split())) for n, t in LEXICONS.items()] +
                    [(f"mined {i}", t) for i, t in enumerate(mined)])
    votes = np.array([voters.votes(t, words_of(t), d) for t, d in zip(texts, distinct)], dtype=int).reshape(-1, len(voters.names))
    share = float(np.clip((toxic.sum() + 1) / (len(toxic) + 10), 0.01, 0.99)) if len(toxic) else DEFAULT_SHARE
    label_model = fit_label_model(votes, share)
    target = label_model.posterior(votes)

    in_docs = Counter()
    for d in distinct:
        in_docs.update(d)
    common = sorted((w for w, c in in_docs.items() if c >= LEAST_DOCS), key=lambda w: (-in_docs[w], w))[:VOCABULARY]
    number = {w: i for i, w in enumerate(common)}
    k = len(voters.names)
    # one column for each word, one for each voter that votes at all (the last voter's vote is "clean")
    rows = [np.concatenate([np.fromiter((number[w] for w in d if w in number), dtype=np.int64), len(common) + np.flatnonzero(v)])
            for d, v in zip(distinct, votes)]
    w = fit_linear(rows, len(common) + k, target)
    vote_weights = w[len(common):-1].copy()
    vote_weights[-1] *= -1
    if not len(texts):
        vote_weights, w[-1] = label_model.log_odds[:, 2] * np.append(np.ones(k - 1), 1), np.log(share / (1 - share))
    return ToxicityModel(voters, label_model, {t: float(x) for t, x in zip(common, w)}, vote_weights, float(w[-1]))


def fit_toxicity(docs: DataFrame, labelled: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
                 text_col: str = "text", rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """Fit on a bounded sample of ``labelled``: about ``rows`` rows and ``text_bytes`` bytes of text at most."""
    sample = sampled_labels(labelled, id_col, label_col, rows)  # bounded, so it may be broadcast
    found = id_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
    size = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, text_bytes / max(size, 1))
    got = found.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20))) \
        .select("doc_id", "text", "label").toPandas().sort_values(["doc_id", "text", "label"])
    return fit(got["text"].tolist(), (got["label"].to_numpy(float) > 0).astype(int))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in row_chunks(np.fromiter(map(len, texts), np.int64, len(texts)), CHUNK_BYTES):
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.score(texts[lo:hi]))],
                                      names=["doc_id", "score"])

    return map_batches(id_text(docs, id_col, text_col), score, SCORE_SCHEMA)
