"""The registered queries of the training-data operators: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm import (ann, bpe, bwt_dedup, divergence, gam, license_scan, line_rules, mixing, personal, ppm, resampling, rtree_join,
                          toxicity)
from jobscope.llm.common import documents, fold, labels
from jobscope.llm.oracles import LINE_RULES, RESAMPLING, SIMILAR_COMPONENTS, SOURCE_DIVERGENCE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# The other operators train models, compress, tokenise or approximate: tests hold them against brute force.
ORACLES: dict[str, str] = {"op2_line_rules": LINE_RULES, "op4_rtree_join": SIMILAR_COMPONENTS, "op12_resampling": RESAMPLING,
                           "op13_source_divergence": SOURCE_DIVERGENCE}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 10) == 0
    scores = ppm.score_texts(documents(spark, sf_dir), training=~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules.line_verdicts(line_rules.counted(documents(spark, sf_dir)))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        "n_removed_words")


# Target weights of the domains (languages) and the table that labels them.
DOMAIN_WEIGHTS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def labelled_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("doc_id").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rates = mixing.document_rates(docs, labelled_domains(spark, docs, sf_dir), DOMAIN_WEIGHTS)
    return rates.select("doc_id", "tokens", "domain", "rate",
                        *[F.get("p", F.lit(j)).alias(f"p_{d}") for j, d in enumerate(sorted(DOMAIN_WEIGHTS))])


@query
def op4_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rtree_join.similar_components(documents(spark, sf_dir), percent=85, words=4)
    return found.select("doc_id", "n_shingles", "component_id")


def _teaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows outside the held-out fold."""
    return labels(spark, sf_dir).where(fold(F.col("doc_id"), 4) != 2)


@query
def op5_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = gam.fit_quality(docs, _teaching(spark, sf_dir))
    return gam.verdicts(gam.quality_scores(docs, model), fold(F.col("doc_id"), 4) == 2, 0.7)


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"),
                        F.concat_ws(",", "labels").alias("labels"), "score")


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.bpe_encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


@query
def op8_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove_repeats(documents(spark, sf_dir), length=100).drop("kept")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit_toxicity(docs, _teaching(spark, sf_dir))
    return gam.verdicts(toxicity.toxicity_scores(docs, model), fold(F.col("doc_id"), 4) == 2, 0.3)


@query
def op10_srs_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = personal.fit_field(personal.labelled_windows(docs))
    return personal.digests(personal.personal_spans(docs, field))


@query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.ranked(resampling.scored(documents(spark, sf_dir), target, seed=2024, buckets=10_000), percent=10, min_words=20)


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(documents(spark, sf_dir), min_docs=30, top=50)
