"""What a task holds of a batch of thousands of texts: a slice of bounded size, not all of them."""
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from jobscope.llm import bpe, bwt_dedup
from jobscope.llm.common import CHUNK_BYTES, row_slices

TEXTS = [("ab " * 40_000)[i:] for i in range(60)] + [None, "", "x" * (CHUNK_BYTES + 5)]


def test_slices_hold_all_rows_in_order_and_are_bounded():
    batch = pa.record_batch([pa.array(range(len(TEXTS))), pa.array(TEXTS, pa.string())], names=["n", "text"])
    slices = list(row_slices(iter([batch.slice(0, 0), batch.slice(1), batch]), 1))
    assert [t for s in slices for t in s.column(1).to_pylist()] == TEXTS[1:] + TEXTS
    assert all(s.num_rows == 1 or sum(len(t or "") for t in s.column(1).to_pylist()) <= CHUNK_BYTES for s in slices)


def test_cut_texts_leave_a_task_in_bounded_batches(spark, monkeypatch):
    """Before, a task of the suffix-array stage held every text of a batch four times over (executor above 3000 MB)."""
    caught = {}
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    monkeypatch.setattr(bwt_dedup, "map_batches", lambda df, fn, schema: caught.update(fn=fn))
    monkeypatch.setattr(bwt_dedup, "_keyed_spans", lambda docs, *_: (
        docs.withColumn(bwt_dedup.ROW_KEY, docs.doc_id), spark.createDataFrame([], "s_id long, s_spans array<struct<start:int,stop:int>>")))
    bwt_dedup.without_repeats(docs)
    n = len(TEXTS)
    spans = [[{"start": 0, "stop": 3}]] * n
    batch = pa.record_batch([pa.array(range(n)), pa.array(TEXTS, pa.string()), pa.array(["en"] * n), pa.array(spans)],
                            names=["doc_id", "text", "lang", "s_spans"])
    out = list(caught["fn"](iter([batch])))
    assert [t for b in out for t in b.column(1).to_pylist()] == [t and t[3:] for t in TEXTS]
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(n))
    assert all(b.num_rows == 1 or b.column(1).nbytes <= CHUNK_BYTES + 64 * n for b in out)


def test_bpe_codec_uses_the_broadcast_tables_and_keeps_few_words():
    """Before, a codec built tables of its own (14 MB) beside the broadcast ones, and its word caches held 60 MB."""
    spec = bpe.load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    words = [np.base_repr(i, 36) for i in range(36 ** 3, 36 ** 3 + 130_000)]
    tracemalloc.start()
    try:
        codec = bpe.BpeCodec(spec)
        assert tracemalloc.get_traced_memory()[0] < 1e6
        for i in range(0, len(words), 1000):
            codec.encode(" ".join(words[i:i + 1000]))
        assert tracemalloc.get_traced_memory()[1] < 25e6
    finally:
        tracemalloc.stop()
