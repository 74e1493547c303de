"""The pipeline's stages one by one, each on what the one before kept."""
import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from .conftest import SF
from .test_bwt_dedup import plain
from .test_rtree_join import plain_components, shingles
from tokenizers import Tokenizer

from jobscope.llm.common import documents, written


@pytest.fixture(scope="module")
def results(spark):
    docs, out = documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
        out.append(docs.toPandas())
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup",
                                                      "mixing sources to target weights", "BPE encoding and decoding"]


def test_quality_stage_keeps_good_documents(results, docs):
    kept, truth = results[0], pd.read_parquet(f"{SF}/labels.parquet")
    assert list(kept.columns) == list(docs.columns) and set(kept.doc_id) <= set(docs.doc_id)
    good = truth[truth.quality == 1].doc_id
    assert good.isin(kept.doc_id).mean() > 0.95 and truth[truth.quality == 0].doc_id.isin(kept.doc_id).mean() < 0.3


def test_one_of_each_group_stays(results):
    before, after = results[0], results[1]
    component = plain_components({i: shingles(t, 5) for i, t in zip(before.doc_id, before.text)}, 80)
    assert set(after.doc_id) == {i for i, c in component.items() if i == c}


def test_repeated_passages_leave_the_texts(results):
    before, after = results[1], results[2].set_index("doc_id")
    for i, (_, _, _, kept) in plain([(i, t.encode()) for i, t in zip(before.doc_id, before.text)], 100).items():
        assert after.text[i] == kept.decode("utf-8", "ignore") and after.n_chars[i] == len(after.text[i])


def test_mixing_drops_no_document_and_repeats_some(results):
    before, after = results[2], results[3]
    seen = Counter(after.doc_id)
    assert set(seen) == set(before.doc_id) and max(seen.values()) > 1 and list(before.columns) == list(after.columns)


def test_encoding(results):
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    texts = dict(zip(results[3].doc_id, results[3].text))
    assert len(results[4]) == len(results[3])
    for r in results[4].itertuples():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_edge_cases(spark, edge, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (edge, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), "test-edge")
            if stage is not corpus_pipeline.encode:
                assert docs.columns == table.columns and set(columns) <= set(docs.columns), name
        docs.count()
