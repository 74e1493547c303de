"""Operator 1 against a plain trie of dictionaries."""
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from .conftest import SF
from pyspark.sql import functions as F

from jobscope.llm import ppm
from jobscope.llm.queries import QUERIES


def held_out(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


class PlainTrie:
    def __init__(self, texts):
        self.nodes = defaultdict(Counter)
        for b in texts:
            x = bytes(ppm.ORDER) + b + b"\0"
            for j in range(ppm.ORDER, len(x)):
                for o in range(ppm.ORDER + 1):
                    self.nodes[x[j - o:j]][x[j]] += 1

    def log10(self, b):
        x, total = bytes(ppm.ORDER) + b + b"\0", 0.0
        for j in range(ppm.ORDER, len(x)):
            excluded = set()
            for o in range(ppm.ORDER, -1, -1):
                node = self.nodes.get(x[j - o:j])
                left = {s: n for s, n in (node or {}).items() if s not in excluded}
                t, q = sum(left.values()), len(left)
                if not t:
                    continue
                if x[j] in left:
                    total += math.log10(left[x[j]] / (t + q))
                    break
                total += math.log10(q / (t + q))
                excluded |= set(node)
            else:
                total -= math.log10(256 - len(excluded))
        return total


def test_scores_equal_a_plain_trie_and_unigram_model(spark, docs):
    got = QUERIES["op1_ppm"](spark, SF).toPandas().set_index("doc_id")
    low = {i: (t or "").encode().lower() for i, t in zip(docs.doc_id, docs.text)}
    train = [b for i, b in low.items() if not held_out(i)]
    words = Counter(w for b in train for w in b.split())
    words["end"] = len(train)
    n, v = sum(words.values()), len(words)
    assert set(got.index) == set(low) and (got.train_tokens == n).all()
    for i, b in low.items():
        tokens = [*b.split(), "end"]
        row = got.loc[i]
        assert (row.held_out, row.n_tokens, row.n_known) == (held_out(i), len(tokens), sum(words[w] > 0 for w in tokens))
        assert row.base_score == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel=1e-9)
    trie = PlainTrie(train)
    for i in [*range(0, 200, 17), *filter(held_out, low)]:
        assert got.loc[i].score == pytest.approx(trie.log10(low[i]), rel=1e-9)


def test_shards_and_tail_words_give_the_same_scores(spark, docs, monkeypatch):
    few = spark.createDataFrame(docs[["doc_id", "text"]].head(40))
    whole = ppm.score_texts(few, F.col("doc_id") % 3 != 0).orderBy("doc_id").toPandas()
    monkeypatch.setattr(ppm, "SHARD_ENTRIES", 6000)
    monkeypatch.setattr(ppm, "HEAD_WORDS", 20)
    parts = ppm.score_texts(few, F.col("doc_id") % 3 != 0).orderBy("doc_id").toPandas()
    np.testing.assert_allclose(parts.score, whole.score, rtol=1e-9)
    np.testing.assert_allclose(parts.base_score, whole.base_score, rtol=1e-9)
    assert parts.n_known.tolist() == whole.n_known.tolist()


def test_probabilities_of_a_context_sum_to_one():
    texts = [b"abracadabra", b"alakazam", b"abab"]
    keys, counts = [], []
    for t in texts:
        buffer, starts, stops = ppm._padded(t, np.array([0, len(t)]))
        g = ppm._grams(buffer)[ppm._within(len(buffer), starts, stops)]
        keys.append(g)
        counts.append(np.ones(len(g), np.int64))
    full = ppm._summed(np.concatenate(keys), np.concatenate(counts))
    short = ppm._summed(full[0] & np.uint64(0xFFFFFF), full[1])
    trie = ppm.Trie(ppm.build_levels(short, full))
    for context in (b"abra", b"zzzz", b"\0\0\0\0", b"xxab"):
        at = np.uint64(int.from_bytes(context, "big")) << np.uint64(8)
        p = 10 ** trie.log10(at | np.arange(256, dtype=np.uint64))
        assert p.sum() == pytest.approx(1.0)


def test_edge_cases(edge, empty):
    got = ppm.score_texts(edge, F.col("doc_id") != 8).toPandas()
    assert len(got) == edge.count() and got.n_tokens[got.doc_id.isin([1, 2, 3])].eq(1).all()
    assert got[got.doc_id == 9].score.nunique() == 1
    assert ppm.score_texts(empty, F.lit(True)).count() == 0
    untrained = ppm.score_texts(edge, F.lit(False)).where("doc_id = 4").first()
    assert untrained.score == pytest.approx(-4 * math.log10(256)) and untrained.n_known == 0
