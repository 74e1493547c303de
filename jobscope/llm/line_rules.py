"""Quality rules with cross-document line frequency (operator 2).

Lines are normalised (lower case, everything but letters as one blank) and hashed.  For each host the distinct documents
that hold a line are counted; a line in more than ``MAX_DOCS`` documents of a host is boilerplate there and is removed
from all of them.  A document that loses most of its words, or keeps too few, is depleted and rejected.  Beside that
stand surface rules on each document alone.

DataFrame functions only.  One pass over the texts writes the surface counts and line hashes; counting, joining and the
verdict work on those.  Documents are counted in two steps, by line and document, then by line, and the join of lines
with the frequent ones is salted by row, so a line that a third of all documents share is spread over many tasks,
whether these are copies of one text or not.

Edge cases: null and empty texts have no words and fail the surface rules; lines without a letter are never counted;
a null host is a host of its own; rows of one id are one document in the count, rows without an id are documents of their
own, and every row loses the words of its own lines only; an empty table gives an empty result; only id, text and host are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import written

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
# Distinct documents of a host that may hold a line; in more of them it is boilerplate.
MAX_DOCS = 20
# A document is depleted when it keeps less than this share of its words, or fewer words than that.
LEAST_SHARE = 0.4
LEAST_WORDS = 30
# Surface rules.
LEAST_BASE_WORDS = 50
MAX_REPEATED_PERCENT = 50
SALTS = 16


def _let(value: Column, body) -> Column:
    """``body`` over a value that is worked out once a row."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are sorted by hash with their places; those equal to a neighbour are repeated, and each covers three words
    less what the next one covers as well.
    """
    hashes = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))

    def covered(sorted_windows: Column) -> Column:
        twin = F.transform(sorted_windows, lambda x, j: F.when(
            (F.get(sorted_windows, j - 1)["h"] == x["h"]) | (F.get(sorted_windows, j + 1)["h"] == x["h"]), x["i"]))
        return _let(F.sort_array(F.filter(twin, lambda p: p.isNotNull())), lambda places: F.aggregate(
            F.transform(places, lambda p, j: F.coalesce(F.least(F.lit(3), F.get(places, j + 1) - p), F.lit(3))),
            F.lit(0), lambda a, b: a + b))

    return _let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        _let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)).otherwise(0))


def surface(text: Column) -> Column:
    """Struct of the counts of one whole text."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return F.struct(
        _let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.filter(F.transform(F.split(text, "\n"), lambda x: _line(x)), lambda x: x.isNotNull()).alias("lines"))


def _line(line: Column) -> Column:
    """Hash and word count of a normalised line; null without a letter."""
    return _let(F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " ")), lambda n: F.when(
        n != "", F.struct(F.xxhash64(n).alias("h"), F.size(F.split(n, " ")).alias("words"))))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The written table of counts and line hashes, a row for each row of ``docs``, with a ``place`` of its own."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    s = rows.select("doc_id", "host", F.xxhash64("text").alias("text_hash"), surface(F.col("text")).alias("s"))
    return written(s.select("doc_id", "host", "text_hash", "s.w.n_words", "s.w.word_chars", "s.n_symbols", "s.n_dup_lines",
                            "s.w.n_repeat_words", "s.lines", F.monotonically_increasing_id().alias("place")), "line-counts")


def frequent_lines(table: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``host, h, n_docs`` of the lines in more than ``max_docs`` distinct documents of a host."""
    unnamed = F.when(F.col("doc_id").isNull(), F.col("place")).alias("unnamed")
    lines = table.select("host", "doc_id", unnamed, F.explode("lines").alias("l")).select("host", "l.h", "doc_id", "unnamed")
    return lines.distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def line_verdicts(table: DataFrame, max_docs: int = MAX_DOCS, least_share: float = LEAST_SHARE,
                  least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows of ``table`` (see :func:`counted`) with ``removed`` (hashes of removed lines), ``n_removed_words``,
    ``base_failed`` and ``kept``."""
    salted = frequent_lines(table, max_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("n_docs")
    lines = table.select("host", "place", F.explode("lines").alias("l")) \
        .select("host", "place", "l.h", "l.words", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int").alias("salt"))
    lost = lines.join(salted, ["host", "h", "salt"]).groupBy("place").agg(F.sum("words").alias("words"), F.collect_set("h").alias("removed"))
    base_failed = (F.col("n_words") < LEAST_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < least_share * F.col("n_words")) | (left < least_words))
    return table.join(lost, "place", "left").drop("place", "lines") \
        .withColumn("n_removed_words", F.least("n_words", F.coalesce("words", F.lit(0)))).drop("words") \
        .withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~depleted)


def without_lines(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` with the frequent lines taken out of their texts.  Rows that are alike in id, host and text lose the same
    lines; a row that differs in one of them loses its own."""
    gone = verdicts.where(F.col("removed").isNotNull()).select("doc_id", "host", "text_hash", "removed").dropDuplicates(["doc_id", "host", "text_hash"])
    joined = docs.join(gone.withColumnsRenamed({"doc_id": "g_id", "host": "g_host", "text_hash": "g_hash", "removed": "g_removed"}),
                       docs[id_col].eqNullSafe(F.col("g_id")) & (F.coalesce(docs[host_col].cast("string"), F.lit("")) == F.col("g_host"))
                       & (F.xxhash64(docs[text_col]) == F.col("g_hash")), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x: F.coalesce(
        ~F.array_contains(F.col("g_removed"), _line(x)["h"]), F.lit(True))), "\n")
    return joined.withColumn(text_col, F.when(F.col("g_removed").isNull(), F.col(text_col)).otherwise(kept)) \
        .drop("g_id", "g_host", "g_hash", "g_removed")
