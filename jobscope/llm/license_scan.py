"""Licence scan by ordered signature rules (operator 6).

Some 270 signatures (:mod:`jobscope.llm.license_rules`) are ordered by kind (wording, notice, name, mention) and place.
A text is looked at only if it holds one of the rules' stems, and by a rule only if it holds that rule's keyword.
Every match is an interval of the text; an interval that lies inside one of an equally good or better kind is
suppressed, so a licence's name inside its notice, or "general public license" inside "lesser general public license",
counts once.  DataFrame functions only: positions are running sums of the lengths between and of the matches, and
suppression is a running maximum of interval ends over intervals sorted by start, so a text with many matches costs
n log n and no pairs are formed.  Only match lengths are shuffled, never texts.

Beside that stand the base labels: places where the words of a phrase stand consecutively.

Edge cases: null and empty texts have no words, an empty label string and a score of 0; rows that repeat id and text
get equal results, rows that repeat an id with another text are scanned apart; an empty table gives an empty result;
only id and text are read.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import id_text
from jobscope.llm.license_rules import BLANK, rules

# A word: a run of characters that are no ASCII control, blank or punctuation character.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Phrases whose places are counted, by label.
BASE_PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
BASE_CONFIDENCE = 0.9
_RULE = "array<struct<rule:int,label:string,priority:int,keyword:string,pattern:string,confidence:double,stem:string>>"


def _let(value: Column, body) -> Column:
    """``body`` over a value that is worked out once a row."""
    return F.transform(F.array(value), body)[0]


def _places(words: Column, phrase: list[str]) -> Column:
    """Indexes at which the words of ``phrase`` begin (words in any ASCII case)."""
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1),
                    lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.lower(F.get(words, i + k)) == w, F.lit(False))
                                                          for k, w in enumerate(phrase)]))


def _base_columns(text: Column) -> list[Column]:
    held = F.contains(F.lower(text), F.lit("license"))
    places = F.when(held, _let(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1),
                               lambda w: F.array(*[_places(w, p) for p in BASE_PHRASES.values()])))
    return [F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), places.alias("places")]


def matches(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, start, stop, rule, label, priority, confidence`` of every match of every rule.

    ``docs`` has ``doc_id, text``; positions are characters from 0.
    """
    table = rules()
    every = F.from_json(F.lit(json.dumps(table)), _RULE)
    stems = {r["stem"] for r in table}
    stems = sorted(s for s in stems if not any(o != s and o in s for o in stems))
    held = _let(F.lower("text"), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(s)) for s in stems]))
    tried = _let(F.regexp_replace(F.lower("text"), BLANK, " "),
                 lambda t: F.filter(every, lambda r: F.contains(t, r["keyword"])))
    hits = docs.where(held) \
        .select("doc_id", F.xxhash64("text").alias("text_hash"), "text", F.explode(tried).alias("r")) \
        .select("doc_id", "text_hash", F.col("r.rule").alias("rule"),
                F.posexplode(F.arrays_zip(
                    F.transform(F.split("text", F.col("r.pattern"), -1), F.length).alias("gap"),
                    F.transform(F.regexp_extract_all("text", F.col("r.pattern"), F.lit(0)), F.length).alias("len"))).alias("i", "m")) \
        .select("doc_id", "text_hash", "rule", "i", "m.gap", "m.len").where(F.col("len").isNotNull()).distinct()
    one_rule = Window.partitionBy("doc_id", "text_hash", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(one_rule)) \
        .withColumn("start", F.col("stop") - F.col("len")).withColumn("r", every[F.col("rule")]) \
        .select("doc_id", "text_hash", "start", "stop", "rule", "r.label", "r.priority", "r.confidence")


def detections(docs: DataFrame) -> DataFrame:
    """Those :func:`matches` that stand after suppression."""
    found = matches(docs)
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("stop"), "priority", "rule") \
        .rowsBetween(Window.unboundedPreceding, -1)
    kinds = sorted({r["priority"] for r in rules()})
    reach = F.coalesce(*[F.when(F.col("priority") == k, F.max(F.when(F.col("priority") <= k, F.col("stop"))).over(before))
                         for k in kinds])
    return found.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("reach") < F.col("stop"))).drop("reach")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    detections`` (the label arrays sorted, the detections by place)."""
    texts = id_text(docs, id_col, text_col)
    spot = F.struct("start", "stop", "label", "priority", "confidence", "rule")
    by_text = detections(texts).groupBy("doc_id", "text_hash") \
        .agg(F.array_sort(F.collect_set("label")).alias("found"), F.max("confidence").alias("sure"),
             F.array_sort(F.collect_list(spot)).alias("detections"))
    rows = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), *_base_columns(F.col("text")))
    same = rows["doc_id"].eqNullSafe(by_text["doc_id"]) & (rows["text_hash"] == by_text["text_hash"])
    flat = F.coalesce(F.flatten("places"), F.array().cast("array<int>"))
    base = F.filter(F.array(*[F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label))
                              for i, label in enumerate(BASE_PHRASES)]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    return rows.join(by_text, same, "left").select(
        rows["doc_id"], "n_words", F.size(flat).cast("long").alias("n_base"),
        F.array_min(flat).cast("long").alias("first_word"), F.array_max(flat).cast("long").alias("last_word"),
        F.array_sort(base).alias("base_labels"),
        F.array_sort(F.array_union(base, F.coalesce("found", none))).alias("labels"),
        F.greatest(F.when(F.size(flat) > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0)),
                   F.coalesce("sure", F.lit(0.0))).alias("score"), "detections")
