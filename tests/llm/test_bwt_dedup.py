"""Operator 8 against a set of all strings seen."""
import hashlib
from collections import defaultdict

import numpy as np
import pytest
from .conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from jobscope.llm import bwt_dedup
from jobscope.llm.queries import QUERIES


def plain(rows, length):
    seen, out = set(), {}
    for i, b in sorted(rows):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            s = b[j:j + length]
            if s in seen:
                gone[j:j + length] = True
            seen.add(s)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=12, max_size=60).map(lambda b: bytes(b"ab\0\xff"[x % 4] for x in b)), min_size=1, max_size=7))
def test_transform_finds_the_repeated_places(contents):
    length = 12
    docs, first = np.arange(len(contents)) // 2, np.where(np.arange(len(contents)) % 2, 100, 0)
    places = np.array([len(c) - length + 1 for c in contents])
    d, p = bwt_dedup.repeated_places(contents, docs, first, places, length)
    at = defaultdict(list)
    for c, doc, f, n in zip(contents, docs, first, places):
        for k in range(n):
            at[c[k:k + length]].append((int(doc), int(f + k)))
    assert set(zip(d.tolist(), p.tolist())) == {x for v in at.values() for x in v if x != min(v)}


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=400).map(lambda b: bytes(97 + x % 3 for x in b)), st.integers(1, 4))
def test_every_place_has_one_segment_and_equal_strings_equal_offsets(raw, parts):
    offsets = np.unique(np.linspace(0, len(raw), parts + 1).astype(int))
    if len(offsets) < 2:
        return
    anchor, seg, text, first, places = bwt_dedup.segments(np.frombuffer(raw, np.uint8), offsets, 50, 16)
    owner = {}
    for a, t, f, n in zip(anchor, text, first, places):
        for k in range(n):
            s = raw[offsets[t] + f + k:][:50]
            assert (t, f + k) not in owner
            owner[t, f + k] = (int(a), s)
    assert len(owner) == sum(max(0, b - a - 49) for a, b in zip(offsets[:-1], offsets[1:]))
    anchors = defaultdict(set)
    for a, s in owner.values():
        anchors[s].add(a)
    assert all(len(x) == 1 for x in anchors.values())


def test_query_equals_plain_removal(spark, docs):
    got = QUERIES["op8_bwt_dedup"](spark, SF).toPandas().set_index("doc_id")
    for i, (n, removed, spans, kept) in plain([(i, (t or "").encode()) for i, t in zip(docs.doc_id, docs.text)], 100).items():
        assert tuple(got.loc[i]) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 4000, 200])
def test_hot_passages_split_over_buckets(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(bwt_dedup, "BUCKET_BYTES", bucket_bytes)
    r = np.random.default_rng(6)
    passage = " ".join(f"shared{k}" for k in r.integers(0, 99, 40))
    rows = [(i, " ".join([*(f"own{i}x{k}" for k in range(r.integers(3, 40))), passage[r.integers(0, 20):], *(f"z{i}y{k}" for k in range(5))])) for i in range(40)]
    rows += [(90, "ab" * 400), (91, "x" + "ab" * 300), (92, "a" * 99), (93, "a" * 99), (94, "é" * 200)]
    got = bwt_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain([(i, t.encode()) for i, t in rows], 100)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got} == want


def test_no_deal_is_above_a_bucket_however_common_its_strings(spark, monkeypatch):
    """A passage in ever new surroundings: many equal strings, which all have one deal."""
    monkeypatch.setattr(bwt_dedup, "BUCKET_BYTES", 3000)
    passage = " ".join(f"shared{k * 37 % 101}" for k in range(25)).encode()
    rows, length = [], 100
    for i in range(80):
        for a in range(0, len(passage) - 140, 40):  # what straddles its border differs
            content = b"%020d" % (i * 1000 + a) + passage[a:a + 140] + b"%021d" % (i * 7919 + a)
            rows.append((7, i, 1000 * a, len(content) - length + 1, content))
    for own in (rows, rows[:3]):
        fetched = spark.createDataFrame(own, "anchor long, doc_id long, first int, places int, content binary")
        dealt, _ = bwt_dedup.in_buckets(fetched, length)
        left = dealt.collect()
        sizes = defaultdict(int)
        for r in left:
            sizes[r.deal] += len(r.content) + 1
        assert max(sizes.values(), default=0) <= 3000
        at = defaultdict(list)
        for _, d, f, p, c in own:
            for k in range(p):
                at[c[k:k + length]].append((d, f + k))
        want = {x for v in at.values() for x in v if x != min(v)}
        got = {(r.doc_id, r.first + k) for r in bwt_dedup.transformed(fetched, length).collect() for k in range(r.places)}
        assert got == want and (own != rows or len(want) > 1000)


@pytest.mark.parametrize("rows", [1, 7])
def test_segments_stream_over_small_batches(spark, rows):
    texts = [(i, f"{'common words of a passage that several documents share ' * 4}{chr(97 + i % 3) * 90}{i % 5}") for i in range(12)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        got = bwt_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain([(i, t.encode()) for i, t in texts], 100)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got} == want


def test_edge_cases(edge, empty):
    got = bwt_dedup.remove_repeats(edge).toPandas()
    assert len(got) == edge.count()
    by = got.dropna(subset="doc_id").drop_duplicates("doc_id").set_index("doc_id")
    assert by.n_removed[6] == by.n_bytes[6] > 100 and by.n_removed[5] == 0 and by.n_removed[9] == 0
    cut = bwt_dedup.without_repeats(edge)
    assert cut.columns == edge.columns and cut.count() == edge.count()
    assert {r.doc_id: r.text for r in cut.collect()}[6] == "" and cut.where("text is null").count() == 1
    assert bwt_dedup.remove_repeats(empty).count() == 0 and bwt_dedup.without_repeats(empty).count() == 0


def in_order(rows):
    """Rows (id, text) as documents of their own, in the order of ids (null first) and of the table."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    return [(n, (rows[k][1] or "").encode()) for n, k in enumerate(order)], [rows[k][0] for k in order]


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    r = np.random.default_rng(4)
    own = lambda n: "".join(chr(97 + x) for x in r.integers(0, 26, n))
    twice, shared = own(200), own(150)
    rows = [(1, twice + twice), (1, own(400)), (None, own(300)), (None, shared + own(50)), (None, own(40) + shared), (3, own(120)), (3, None)]
    for table in (rows, rows + [(None, rows[2][1])], rows + [(1, rows[1][1]), (2, rows[1][1])]):
        df = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
        got = sorted((x.doc_id or 0, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in bwt_dedup.remove_repeats(df).collect())
        numbered, ids = in_order(table)
        want = plain(numbered, 100)
        assert got == sorted((ids[n] or 0, *want[n]) for n, _ in numbered)
        clean = sorted((x.doc_id or 0, x.text or "") for x in bwt_dedup.without_repeats(df).collect())
        assert clean == sorted((ids[n] or 0, want[n][3].decode()) for n, _ in numbered)


def test_equal_texts_without_an_id_stay_once(spark):
    text = "".join(f"piece {k} of it, " for k in range(40))
    df = spark.createDataFrame([(None, text)] * 5 + [(2, text)], "doc_id long, text string").repartition(3)
    got = [x.n_removed for x in bwt_dedup.remove_repeats(df).collect()]
    assert sorted(got) == [0] + [len(text)] * 5
