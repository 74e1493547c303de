"""Corpus pipeline: from raw documents to token ids, one training-data operator a stage.

Each stage takes all documents that the one before kept, and its decisions take effect: rejected documents go, one
document of each near-duplicate group stays, repeated passages leave the texts, documents are repeated as their rates
say (no document is dropped by mixing), and what is left is encoded.  Between stages the documents are written as
Parquet and read again.

Edge cases: null and empty texts are scored, stay in the Jaccard join (they are like nothing), lose no bytes, are never
dropped by mixing, and encode to no tokens; texts of any length are worked on whole; of similar documents the smallest
id stays, and rows that share an id go or stay by their own texts; a row without an id is never taken for a copy in the
join, but loses the passages that it repeats; rows that repeat id and text stay side by side until the repeated passages
leave all but the first of them; an empty table passes through; further columns, whatever their names, are kept up to
the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm import bpe, bwt_dedup, gam, mixing, rtree_join
from jobscope.llm.common import documents, fold, labels, written

QUALITY_THRESHOLD = 0.7
SIMILAR_PERCENT, SHINGLE_WORDS = 80, 5
REPEAT_BYTES = 100
# Target shares of tokens by language.
MIX = {"de": 0.18, "en": 0.5, "es": 0.14, "fr": 0.18}
VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores at the threshold or above."""
    model = gam.fit_quality(docs, labels(spark, sf_dir).where(fold(F.col("doc_id"), 4) != 2))
    return gam.keep_good(docs, model, QUALITY_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of similar documents."""
    return rtree_join.one_of_each(docs, SIMILAR_PERCENT, SHINGLE_WORDS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings that also start earlier."""
    return bwt_dedup.without_repeats(docs, REPEAT_BYTES).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the expected tokens by language meet the target shares."""
    labelled = labels(spark, sf_dir).select("doc_id").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")
    return mixing.mixed(docs, labelled, MIX, never_drop=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document's ids and decoded text."""
    return bpe.digests(bpe.bpe_encode_decode(docs, public_tokenizers.path(VOCABULARY)))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("mixing sources to target weights", mix), ("BPE encoding and decoding", encode)]

# Trained models and hashes decide here; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
