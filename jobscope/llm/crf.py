"""A linear-chain conditional random field over word shapes: training, and Viterbi decoding in numpy batches.

Tokens are runs of letters and digits, or single other signs; blanks only separate them.  A token's shape is a number
made of the kinds of bytes in it, its length class, whether it is hexadecimal and whether it stands right behind the
token before it.  A label's score at a token is a sum of table entries for the shapes from two before to two behind;
label pairs have a table of their own.  Sequences stand between two virtual tokens labelled ``O``.

Decoding is exact and whole: a token whose ``O`` beats every other label by more than any change of label pairs and of
the next token could make up is ``O`` on every best path, so the path falls apart there.  What stands between two such
tokens is decoded by Viterbi, many stretches of similar length at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np

# Shapes: 4096 of words, 512 of signs (byte and whether glued), one beside the text.
_SIGNS, BESIDE = 4096, 4096 + 512
N_SHAPES = BESIDE + 1
WINDOW = (-2, -1, 0, 1, 2)
_NEVER = -1e4

_KIND = np.zeros(256, np.uint8)  # bits of a word byte: lower 1, upper 2, digit 4, beyond ASCII 8; sign 0
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
# Length classes of words: 1, 2, 3, 4, 5-6, 7-8, 9-12, 13-15, 16, 17-19, 20-31, 32 and more.
_LENGTHS = np.array([2, 3, 4, 5, 7, 9, 13, 16, 17, 20, 32])


def is_blank(data: np.ndarray) -> np.ndarray:
    return _BLANK[data]


def tokens(data: np.ndarray, inner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and shape of every token of texts that begin at 0 and at the offsets ``inner``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    kind = _KIND[data]
    word, blank = kind > 0, _BLANK[data]
    inside = np.zeros(len(data) + 1, bool)  # between two bytes of one word
    inside[1:-1] = word[1:] & word[:-1]
    apart = np.zeros(len(data) + 1, bool)
    apart[0] = True
    if inner is not None:
        apart[inner] = True
    inside &= ~apart
    starts = np.flatnonzero(~blank & ~inside[:-1])
    stops = np.flatnonzero(~blank & ~inside[1:]) + 1
    if not len(starts):
        return starts, stops, starts
    # what lies between a start and the next one is the token and blanks, which have no kind and don't break hex
    kinds = np.bitwise_or.reduceat(kind, starts)
    hexa = np.logical_and.reduceat(_HEX[data] | blank, starts)
    glued = np.zeros(len(starts), np.int64)
    glued[1:] = (starts[1:] == stops[:-1]) & ~apart[starts[1:]]
    first_digit, last_digit = kind[starts] == 4, kind[stops - 1] == 4
    length = np.searchsorted(_LENGTHS, stops - starts, side="right")
    shape = (((kinds.astype(np.int64) * 16 + length) * 2 + hexa) * 2 + first_digit) * 2 + last_digit
    shape = shape * 2 + glued
    sign = kinds == 0
    shape[sign] = _SIGNS + data[starts[sign]].astype(np.int64) * 2 + glued[sign]
    return starts, stops, shape


def coarse(shape: np.ndarray) -> np.ndarray:
    """A shape without its length class: back-off for shapes that were not seen in training."""
    word = shape < _SIGNS
    kinds, rest = shape // 256, shape % 16
    return np.where(word, kinds * 16 + rest, shape)


_COARSE = coarse(np.arange(N_SHAPES))


def beside(shape: np.ndarray, step: int) -> np.ndarray:
    """Every token's neighbour ``step`` tokens on (``BESIDE`` outside the text)."""
    out = np.full(len(shape), BESIDE, shape.dtype)
    if step > 0:
        out[:-step or None] = shape[step:]
    elif step < 0:
        out[-step:] = shape[:step]
    else:
        out[:] = shape
    return out


@dataclass
class Crf:
    """Scores by window position, shape and label; scores of label pairs; labels O, B-kind, I-kind, ..."""

    kinds: tuple[str, ...]
    tables: np.ndarray  # window position x shape x label
    pairs: np.ndarray   # label x label

    def __post_init__(self) -> None:
        self.tables, self.pairs = self.tables.astype(float), np.where(allowed(len(self.kinds)), self.pairs, _NEVER)
        others = self.tables[:, :, 1:].max(axis=2)
        self._margin = self.tables[:, :, 0] - others
        inner, begin = self.tables[:, :, 2::2], self.tables[:, :, 1::2]
        self._restart = np.maximum((inner - begin).max(axis=2), 0)
        self._slack = _slack(self.pairs)

    def sure(self, shape: np.ndarray) -> np.ndarray:
        """Tokens that are O on every best path."""
        near = [beside(shape, step) for step in WINDOW]
        margin = sum(self._margin[k][x] for k, x in enumerate(near))
        restart = sum(self._restart[k][x] for k, x in enumerate(near))
        after = np.zeros(len(shape))
        after[:-1] = np.where(shape[1:] == BESIDE, 0, restart[1:])
        return (margin > self._slack + after + 1e-9) | (shape == BESIDE)

    def decode(self, shape: np.ndarray, batch: int = 1 << 16) -> np.ndarray:
        """The best labels, as numbers, of texts laid out with two ``BESIDE`` between them."""
        labels = np.zeros(len(shape), np.int8)
        unsure = ~self.sure(shape)
        need = np.flatnonzero(unsure)
        if len(need):
            scores = sum(self.tables[k][beside(shape, step)[need]] for k, step in enumerate(WINDOW))
            edge = np.diff(np.concatenate([[0], unsure.view(np.int8), [0]]))
            starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            at = np.searchsorted(need, starts)
            for rows in _similar(stops - starts, batch):
                self._viterbi(labels, scores, at[rows], starts[rows], (stops - starts)[rows])
        return labels

    def _viterbi(self, labels: np.ndarray, scores: np.ndarray, at: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Best paths of stretches that stand between tokens labelled O (longest first)."""
        n, back = len(at), []
        best = self.pairs[0] + scores[at]
        for t in range(1, int(lengths[0])):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # stretches longer than t
            ways = best[:n, :, None] + self.pairs
            came = ways.argmax(axis=1)
            back.append(came.astype(np.int8))
            best[:n] = np.take_along_axis(ways, came[:, None], axis=1)[:, 0] + scores[at[:n] + t]
        label = (best + self.pairs[:, 0]).argmax(axis=1)
        for t in range(int(lengths[0]) - 1, -1, -1):
            n = int(np.searchsorted(-lengths, -t, side="left"))
            labels[starts[:n] + t] = label[:n]
            if t:
                label[:n] = back[t - 1][np.arange(n), label[:n]]


def allowed(kinds: int) -> np.ndarray:
    """Label pairs that may follow: I-kind only behind B-kind or I-kind."""
    out = np.ones((1 + 2 * kinds, 1 + 2 * kinds), bool)
    for k in range(kinds):
        inner = 2 + 2 * k
        out[:, inner] = False
        out[[inner - 1, inner], inner] = True
    return out


def _slack(pairs: np.ndarray) -> float:
    """The most that label pairs can gain by a label other than O at a token: pairs a-y-b-c against a-O-b'-c, where b' is
    b, or B-kind instead of an I-kind that can't follow O."""
    n, most = len(pairs), 0.0
    for y, b in product(range(1, n), range(n)):
        if pairs[y, b] <= _NEVER:
            continue
        instead = b - 1 if b and b % 2 == 0 else b
        change = pairs[:, y] - np.where(pairs[:, 0] > _NEVER, pairs[:, 0], np.inf)
        follows = np.where(pairs[b] > _NEVER, pairs[b] - pairs[instead], -np.inf)
        most = max(most, change.max() + pairs[y, b] - pairs[0, instead] + max(0.0, follows.max()))
    return most


def _similar(lengths: np.ndarray, batch: int) -> Iterator[np.ndarray]:
    """Rows dealt to batches of similar length, each longest first and of about ``batch`` tokens at most."""
    order = np.argsort(-lengths, kind="stable")
    lo = 0
    while lo < len(order):
        take = max(1, batch // int(lengths[order[lo]]))
        yield order[lo:lo + take]
        lo += take


def label_spans(labels: np.ndarray, kinds: tuple[str, ...]) -> Iterator[tuple[str, int, int]]:
    """kind, first and end token of every labelled stretch."""
    at = np.flatnonzero(labels)
    for i in at[labels[at] % 2 == 1]:
        stop = i + 1
        while stop < len(labels) and labels[stop] == labels[i] + 1:
            stop += 1
        yield kinds[labels[i] // 2], int(i), stop


def gradient(nodes: np.ndarray, pairs: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of padded sequences and its derivatives by node scores (row, place, label) and by pair scores.

    Forward and backward sums are scaled to 1 at every place; places behind a sequence's end have no derivative.
    """
    n_rows, width, k = nodes.shape
    live = np.arange(width) < lengths[:, None]
    top = nodes.max(axis=2, keepdims=True)
    weight, step = np.exp(nodes - top), np.exp(pairs)
    ahead, behind, scale = np.zeros_like(nodes), np.zeros_like(nodes), np.ones((n_rows, width))
    before = np.broadcast_to(step[0], (n_rows, k))
    for t in range(width):
        on = live[:, t, None]
        now = before * weight[:, t]
        scale[:, t] = np.where(live[:, t], now.sum(axis=1), 1)
        ahead[:, t] = np.where(on, now / scale[:, t, None], ahead[:, t - 1])
        before = ahead[:, t] @ step
    end = ahead[:, -1] @ step[:, 0]
    behind[:, -1] = step[:, 0]
    for t in range(width - 2, -1, -1):
        behind[:, t] = np.where(live[:, t + 1, None], (behind[:, t + 1] * weight[:, t + 1]) @ step.T / scale[:, t + 1, None], step[:, 0])
    share = ahead * behind / end[:, None, None]
    rows, places = np.arange(n_rows)[:, None], np.arange(width)
    by_node = -share
    by_node[rows, places, labels] += 1
    by_node[~live] = 0
    first, final = labels[:, 0], labels[np.arange(n_rows), lengths - 1]
    expected, seen = np.zeros_like(pairs), np.zeros_like(pairs)
    expected[0] += share[:, 0].sum(axis=0)
    expected[:, 0] += (ahead[:, -1] * step[:, 0] / end[:, None]).sum(axis=0)
    np.add.at(seen, (np.zeros(n_rows, int), first), 1)
    np.add.at(seen, (final, np.zeros(n_rows, int)), 1)
    for t in range(1, width):
        on = live[:, t]
        arrive = weight[on, t] * behind[on, t] / (scale[on, t] * end[on])[:, None]
        expected += (ahead[on, t - 1].T @ arrive) * step
        np.add.at(seen, (labels[on, t - 1], labels[on, t]), 1)
    likelihood = (seen * pairs).sum() + nodes[rows, places, labels][live].sum() - np.log(end).sum() - (np.log(scale) + top[:, :, 0])[live].sum()
    return likelihood, by_node, seen - expected


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], kinds: tuple[str, ...], steps: int = 50, rate: float = 0.2,
        decay: float = 2e-4, pair_bound: float = 0.5) -> Crf:
    """Maximum likelihood with a quadratic penalty, by full-batch steps scaled by running squares (same data, same
    model).  ``sequences`` are shapes and label numbers.  Pair scores stay within ``pair_bound`` of 0: what a label is
    must show in the shapes around it, so that most tokens are surely O and need no search."""
    k = 1 + 2 * len(kinds)
    fine, rough = np.zeros((len(WINDOW), N_SHAPES, k)), np.zeros((len(WINDOW), N_SHAPES, k))
    pairs, mask = np.zeros((k, k)), allowed(len(kinds))
    sequences = sorted((s for s in sequences if len(s[0])), key=lambda s: -len(s[0]))
    if sequences:
        lengths = np.array([len(s) for s, _ in sequences])
        width = int(lengths[0])
        near = np.full((len(WINDOW), len(sequences), width), BESIDE)
        labels = np.zeros((len(sequences), width), np.int64)
        for i, (shape, label) in enumerate(sequences):
            labels[i, :len(label)] = label
            for w, step in enumerate(WINDOW):
                near[w, i, :len(shape)] = beside(shape, step)
        # only shapes that occur have parameters to learn
        used = [np.unique(x, return_inverse=True) for x in near]
        used_rough = [np.unique(_COARSE[x], return_inverse=True) for x in near]
        params = [pairs, *(np.zeros((len(u), k)) for u, _ in used), *(np.zeros((len(u), k)) for u, _ in used_rough)]
        at = [inverse.reshape(-1) for _, inverse in used + used_rough]
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            nodes = sum(p[i] for p, i in zip(params[1:], at)).reshape(len(sequences), width, k)
            _, node, by_pair = gradient(nodes, np.where(mask, params[0], _NEVER), labels, lengths)
            flat = node.reshape(-1, k)
            slopes = [np.where(mask, by_pair, 0)]
            for p, i in zip(params[1:], at):
                slopes.append(np.stack([np.bincount(i, flat[:, j], len(p)) for j in range(k)], axis=1))
            for p, g, m, s in zip(params, slopes, mean, square):
                g = g / len(sequences) - decay * p
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8) * (1 - 0.9 * step / steps)
            np.clip(params[0], -pair_bound, pair_bound, out=params[0])
        pairs = params[0]
        for w in range(len(WINDOW)):
            fine[w, used[w][0]] = params[1 + w]
            rough[w, used_rough[w][0]] = params[1 + len(WINDOW) + w]
    return Crf(kinds, fine + rough[:, _COARSE], pairs)
