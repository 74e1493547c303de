"""Operator 11 against the patterns as given, and the field's own finds."""
import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobscope.llm import personal
from jobscope.llm.queries import QUERIES

from .conftest import SF

# the patterns as the contract words them
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 16 <= len(digits) <= 19 and sum(twice) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="ab1.@-%+ ()", max_size=40), st.text(alphabet="0123 .-+()", max_size=60),
                 st.lists(st.sampled_from(["4111111111111111", "4111 1111 1111 1111", "+1 (377) 555-0271", "a.b@c.de", "10.0.0.1", "256.1.1.1", " ", "x", "é", "@", "."]),
                          max_size=9).map("".join)))
def test_patterns(text):
    assert personal.base_spans(text) == plain(text)


@pytest.mark.parametrize("run", ["a", "1", "+1", "@", "1.", ".", "a@", "+ ", "1 ", "(", "a.b-", "%40"])
def test_long_runs_take_linear_time(run):
    t = time.time()
    personal.base_spans(run * 100_000)
    assert time.time() - t < 5


@pytest.fixture(scope="module")
def field(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return personal.fit_field(personal.labelled_windows(docs.where("doc_id % 2 = 0"), sample_docs=2000))


def test_query(spark, docs):
    got = QUERIES["op11_personal_data"](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text):
        want = plain(t or "")
        row = got.loc[i]
        assert [row[f"n_{k}"] for k in personal.KINDS] == [sum(s[0] == k for s in want) for k in personal.KINDS]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        spans = [s.split(":") for s in row.spans.split(",") if s]
        spans = [(k, int(a), int(b)) for k, a, b in spans]
        assert set(want) <= set(spans) and spans == sorted(spans, key=lambda s: (personal.KINDS.index(s[0]), s[1]))


def spans_of(text, field):
    raw = np.frombuffer(text.encode(), np.uint8)
    found = personal.field_spans(raw, np.array([0, len(raw)]), field).get(0, [])
    return found, personal.with_field(text, personal.base_spans(text), found)


def test_field_finds_held_out_spans(spark, field):
    """Alone, without the patterns, on documents that it was not trained on."""
    import pandas as pd
    texts = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").query("doc_id % 2 == 1").text.fillna("")
    seen = found = extra = 0
    for text in texts[texts.str.contains("@|[0-9]{3}")]:
        base, alone = set(personal.base_spans(text)), spans_of(text, field)[0]
        seen, found = seen + len(base), found + len(base & set(alone))
        extra += len(spans_of(text, field)[1]) - len(base)
    assert seen > 200 and found >= 0.95 * seen and extra < 0.1 * seen


def test_field_adds_what_the_patterns_miss(field):
    beside = "wh 2353820953013749 4550997810720808 thheed hand and the rest of it"
    assert personal.base_spans(beside) == []  # two numbers drawn together
    assert spans_of(beside, field)[1] == [("card", 20, 36)]  # the second one passes its check
    national = "please ring (826) 555-4081 before noon or leave it"
    assert [(k, national[a:b]) for k, a, b in spans_of(national, field)[1]] == [("phone", "(826) 555-4081")]
    assert spans_of("The version 3 of 2007 has 12 parts, 400 pages and 1,000 words.", field)[1] == []


def test_layout_changes_nothing(field, docs):
    texts = [t or "" for t in docs.text]
    raws = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    together = personal.field_spans(np.frombuffer(b"".join(raws), np.uint8), offsets, field)
    for i, raw in enumerate(raws):
        data, ends = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        alone = personal.field_spans(data, ends, field).get(0, [])
        assert together.get(i, []) == alone == personal.field_spans(data, ends, field, limit=300).get(0, [])


def test_edge_cases(edge, empty, field):
    got = personal.digests(personal.personal_spans(edge, field)).collect()
    assert len(got) == edge.count()
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == nothing and r.spans == "" and r.n_email == 0 for r in got if r.doc_id in (1, 2, 3, 4, None))
    assert personal.personal_spans(empty, field).count() == 0
    # a corpus without a span teaches a field that finds none
    none = personal.fit_field(personal.labelled_windows(edge.where("doc_id in (5, 6)")))
    assert spans_of("ring +1 (826) 555-4081 or a.b@c.de", none)[0] == []
    assert personal.fit_field(personal.labelled_windows(empty)).decode(np.array([5, 6])).tolist() == [0, 0]
