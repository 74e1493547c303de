"""The conditional random field against enumeration of all label paths."""
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from jobscope.llm import crf

KINDS = ("a", "b")
N = 1 + 2 * len(KINDS)


def path_score(pairs, nodes, path):
    path = [0, *path, 0]
    return sum(pairs[x, y] for x, y in zip(path, path[1:])) + sum(nodes[i, y] for i, y in enumerate(path[1:-1]))


def random_field(seed, scale=2.0, pair_scale=0.7):
    rng = np.random.default_rng(seed)
    tables = np.zeros((len(crf.WINDOW), crf.N_SHAPES, N))
    tables[:, :12] = rng.normal(0, scale, (len(crf.WINDOW), 12, N))
    tables[:, :12, 0] += scale * rng.random()
    return crf.Crf(KINDS, tables, rng.normal(0, pair_scale, (N, N)))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.lists(st.integers(0, 11), min_size=1, max_size=6))
def test_decoding_finds_the_best_path(seed, shape):
    field, shape = random_field(seed), np.array(shape)
    nodes = sum(field.tables[k][crf.beside(shape, step)] for k, step in enumerate(crf.WINDOW))
    got = path_score(field.pairs, nodes, field.decode(shape).tolist())
    assert np.isclose(got, max(path_score(field.pairs, nodes, p) for p in product(range(N), repeat=len(shape))))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.lists(st.lists(st.integers(0, 11), max_size=40), min_size=1, max_size=12))
def test_sure_tokens_and_batches_change_nothing(seed, texts):
    """Texts laid out together give what each gives alone without the shortcut of sure tokens."""
    field = random_field(seed, scale=4.0, pair_scale=0.3)
    laid = np.concatenate([np.concatenate([np.array(t, int), [crf.BESIDE] * 2]) for t in texts])
    got = field.decode(laid, batch=16)
    alone = random_field(seed, scale=4.0, pair_scale=0.3)
    alone.sure = lambda shape: shape == crf.BESIDE
    want = np.concatenate([np.concatenate([alone.decode(np.array(t, int)), [0, 0]]) for t in texts])
    assert (got == want).all()


def test_gradient_against_enumeration():
    rng = np.random.default_rng(3)
    pairs = np.where(crf.allowed(len(KINDS)), rng.normal(0, 1, (N, N)), -1e4)
    lengths = np.array([4, 3, 1])
    nodes = rng.normal(0, 1.5, (3, 4, N))
    labels = np.array([[0, 1, 2, 0], [3, 4, 1, 0], [0, 0, 0, 0]])

    def likelihood(nodes, pairs):
        total = 0.0
        for row, n in enumerate(lengths):
            scores = [path_score(pairs, nodes[row], p) for p in product(range(N), repeat=int(n))]
            total += path_score(pairs, nodes[row], labels[row, :n].tolist()) - np.logaddexp.reduce(scores)
        return total

    value, by_node, by_pair = crf.gradient(nodes, pairs, labels, lengths)
    assert np.isclose(value, likelihood(nodes, pairs))
    for at in [(0, 0, 0), (0, 1, 1), (1, 2, 1), (2, 0, 3), (1, 0, 3), (0, 3, 4)]:
        up, down = nodes.copy(), nodes.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert np.isclose(by_node[at], (likelihood(up, pairs) - likelihood(down, pairs)) / 2e-5, atol=1e-5)
    for at in [(0, 0), (0, 1), (1, 2), (2, 0), (4, 4), (3, 0)]:
        up, down = pairs.copy(), pairs.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert np.isclose(by_pair[at], (likelihood(nodes, up) - likelihood(nodes, down)) / 2e-5, atol=1e-5)
    assert (by_node[2, 1:] == 0).all()


def test_tokens_and_shapes():
    raw = "Call +1 (377) 555-0271, é9 now".encode()
    starts, stops, shape = crf.tokens(np.frombuffer(raw, np.uint8))
    assert [raw[a:b].decode() for a, b in zip(starts, stops)] == ["Call", "+", "1", "(", "377", ")", "555", "-", "0271", ",", "é9", "now"]
    again = crf.tokens(np.frombuffer(b"Tall +2 (455) 123-4567", np.uint8))[2]
    assert (again == shape[:9]).all()
    # a text that begins within the buffer neither joins nor touches the one before
    joined = crf.tokens(np.frombuffer(b"abcabc", np.uint8), np.array([3]))
    assert joined[0].tolist() == [0, 3] and joined[2][0] == joined[2][1]
    assert len(crf.tokens(np.zeros(0, np.uint8))[0]) == 0 and len(crf.tokens(np.frombuffer(b" \n ", np.uint8))[0]) == 0
