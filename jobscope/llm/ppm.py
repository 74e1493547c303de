"""Language-model scoring by prediction by partial matching over bytes (operator 1).

A trie of byte contexts up to ``ORDER`` bytes holds how often each byte followed.  A byte is predicted in the longest
context that the training texts had; a byte that never followed there costs an escape (method C: as many escapes as
distinct bytes followed) and is predicted one byte shorter, with all bytes of the longer context excluded.  At the end
stands a uniform guess among the bytes never seen at all.  A text ends with a zero byte and begins after ``ORDER`` of
them, so the code lengths are those of whole texts.  The trie is fixed after training, hence the set excluded at a
context is that of its longer one alone, and every prediction is a sum of precomputed logarithms:

    seen in the longest context:   log n - log(T + q)             (T bytes followed, q of them distinct)
    else its escape, and shorter:  log n - log(T' + q'), or the escape log q' - log(T' + q'), where T' and q' leave out
                                   the bytes of the longer context

Training counts (ORDER + 1)-grams, and words for the baseline, in one pass: map tasks emit what they gathered, Spark
sums it.  Contexts of up to two bytes are at most 2^24 entries.  The longer ones are dealt by a hash of their last three
bytes into as many shards of about ``SHARD_ENTRIES`` entries as the counts need.  One shard's counts at a time pass through
the driver to the tasks and are let go when its part of the scores is written, so what the driver and a task hold is
bounded, whatever the corpus; every position belongs to one shard, and a text's parts are summed.

The unigram baseline knows the most frequent ``HEAD_WORDS`` words in every task; all others are shuffled, as words with
their counts per text, and joined with the table of counts.

Edge cases: null is the empty text, which still ends (one token, one byte); rows that repeat id and text are scored
alike; a NUL byte in a text is the same sign as the text's end and the bytes before its beginning; without training rows every byte has a chance of 1/256 and no word is known; an empty table gives an empty
result; only id and text are read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import id_text, map_batches, text_pieces, written

ORDER = 4
SHARD_ENTRIES = 2_000_000
# Odd multiplier that spreads contexts over shards.
SPREAD = 0x9E3779B1
HEAD_WORDS = 150_000
# Words that a map task gathers before it hands them on.
FLUSH_WORDS = 400_000
_EMPTY = np.uint64(2**64 - 1)
# Kinds of counted keys, as the first byte of the key.
GRAM, WORD, END = b"\0", b"\1", b"\2"


# ---------------------------------------------------------------- bytes of a piece of texts

def _padded(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with ORDER zero bytes before and one behind each; first position and end position of each."""
    gap = bytes(ORDER + 1)
    joined = gap[:ORDER] + gap.join([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]) + gap[:1]
    starts = offsets[:-1] + np.arange(len(offsets) - 1) * (ORDER + 1) + ORDER
    return np.frombuffer(joined, np.uint8), starts, starts + np.diff(offsets)


def _grams(buffer: np.ndarray) -> np.ndarray:
    """At every position the byte and the ORDER bytes before it, the byte itself lowest (nothing before: zero)."""
    out = buffer.astype(np.uint64)
    for back in range(1, ORDER + 1):
        out[back:] |= buffer[:-back].astype(np.uint64) << np.uint64(8 * back)
    return out


def _within(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    edge = np.zeros(size + 1, np.int8)
    edge[starts] += 1
    edge[ends + 1] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


# ---------------------------------------------------------------- counting

def count_corpus(texts: DataFrame) -> DataFrame:
    """The written table ``key, n``: grams, words and ends of the training texts (``doc_id, text``)."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        keys, counts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(names: list[bytes], n: list[int]) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(names), 50_000):
                yield pa.record_batch([pa.array(names[lo:lo + 50_000], pa.binary()), pa.array(n[lo:lo + 50_000], pa.int64())],
                                      names=["key", "n"])

        for piece, data, offsets in text_pieces(batches):
            raw = data.tobytes().lower()
            for a, b in zip(offsets[:-1], offsets[1:]):
                words.update(raw[a:b].split())
            ends += piece.num_rows
            buffer, starts, stops = _padded(raw, offsets)
            parts.append(np.unique(_grams(buffer)[_within(len(buffer), starts, stops)], return_counts=True))
            if sum(len(k) for k, _ in parts) > 2_000_000:
                parts = [_summed(*map(np.concatenate, zip(*parts)))]
            if len(words) > FLUSH_WORDS:
                yield from rows([WORD + w for w in words], list(words.values()))
                words = Counter()
        if parts:
            keys, counts = _summed(*map(np.concatenate, zip(*parts)))
        packed = keys.astype(">u8").tobytes()
        yield from rows([GRAM + packed[8 * i + 7 - ORDER:8 * i + 8] for i in range(len(keys))], counts.tolist())
        yield from rows([WORD + w for w in words], list(words.values()))
        yield from rows([END], [ends])

    found = map_batches(texts, gather, "key binary, n long")
    return written(found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
                   .withColumn("kind", F.substring("key", 1, 1)), "ppm-counts")


def _gram_number(key: Column) -> Column:
    return F.conv(F.substring(F.hex(key), 3, 2 * ORDER + 2), 16, 10).cast("long")


# ---------------------------------------------------------------- the trie as tables of logarithms

class Level:
    """Counts of one order: distinct (context, byte) keys, and per context T, q and what its parent keeps."""

    def __init__(self, order: int, keys: np.ndarray, counts: np.ndarray, parent: Level | None):
        self.order, self.keys, self.counts = order, keys, counts
        context = keys >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = context[first]
        self.total = np.add.reduceat(counts, first) if len(keys) else counts
        self.distinct = np.diff(np.append(first, len(keys)))
        self.row = np.repeat(np.arange(len(first)), self.distinct)
        self.left_total, self.left_distinct = self.total, self.distinct
        if parent is not None and len(keys):
            shorter = np.uint64((1 << 8 * order) - 1)
            shared = parent.counts[np.searchsorted(parent.keys, keys & shorter)]
            at = np.searchsorted(parent.contexts, self.contexts & (shorter >> np.uint64(8)))
            self.left_total = parent.total[at] - np.add.reduceat(shared, first)
            self.left_distinct = parent.distinct[at] - self.distinct

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys tagged with the order, and log10 of their counts."""
        return self.keys | np.uint64(self.order + 1 << 56), np.log10(self.counts)

    def context_rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Tagged contexts; log10 of T + q, of the escape, of T' + q' and of the escape after exclusion."""
        t, q = self.total.astype(float), self.distinct.astype(float)
        rows = [np.log10(t + q), np.log10(q) - np.log10(t + q)]
        if self.order:
            left = (self.left_total + self.left_distinct).astype(float)
            some = left > 0
            rows.append(np.log10(np.where(some, left, 1.0)))
            # nothing is left in the shorter context: the escape from it is certain
            rows.append(np.where(some, np.log10(np.maximum(self.left_distinct, 1)) - rows[2], 0.0))
        else:
            rows += [np.zeros(len(t)), np.zeros(len(t))]
        return self.contexts | np.uint64(self.order + 1 << 56), np.array(rows).T.reshape(-1, 4)


def build_levels(short: tuple[np.ndarray, np.ndarray], full: tuple[np.ndarray, np.ndarray]) -> list[Level]:
    """All orders: ``short`` are the counts of three-byte grams, ``full`` those of (ORDER + 1)-byte grams."""
    levels: list[Level] = []
    for order in range(ORDER + 1):
        keys, counts = short if order <= 2 else full
        levels.append(Level(order, *_summed(keys & np.uint64((1 << 8 * (order + 1)) - 1), counts), levels[-1] if levels else None))
    return levels


class Lookup:
    """Open addressing over 64-bit keys, filled and probed by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY)
        self.at = np.zeros(1 << bits, np.int32)
        self.values = values
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == _EMPTY
            taken, which = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[which]
            self.keys[taken], self.at[taken] = keys[todo[won]], todo[won]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slot = todo[rest], slot[rest] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there != _EMPTY))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.at[slot[open_[hit]]]
            open_ = open_[~hit & (there != _EMPTY)]
        return out


class Trie:
    """Log10 probabilities of bytes after their contexts."""

    def __init__(self, levels: list[Level]):
        keys, logs = zip(*(level.entries() for level in levels))
        contexts, rows = zip(*(level.context_rows() for level in levels))
        top, top_rows = levels[-1], rows[-1]
        # the longest context needs no exclusion: its whole prediction is one number
        self.top = Lookup(keys[-1], logs[-1] - (top_rows[top.row, 0] if len(top.row) else 0))
        self.shorter = Lookup(np.concatenate(keys[:-1]), np.concatenate(logs[:-1]))
        self.contexts = Lookup(np.concatenate(contexts), np.concatenate(rows))
        self.unseen = -np.log10(max(256 - len(levels[0].keys), 1))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        at = self.top.find(grams | np.uint64(ORDER + 1 << 56))
        out = np.where(at >= 0, self.top.values[at] if len(self.top.values) else 0.0, 0.0)
        open_ = np.flatnonzero(at < 0)
        if len(open_):  # what repeats in a piece is worked out once
            distinct, inverse = np.unique(grams[open_], return_inverse=True)
            out[open_] = self._escaped(distinct)[inverse]
        return out

    def _context(self, grams: np.ndarray, order: int) -> np.ndarray:
        return self.contexts.find(grams >> np.uint64(8) & np.uint64((1 << 8 * order) - 1) | np.uint64(order + 1 << 56))

    def _escaped(self, grams: np.ndarray) -> np.ndarray:
        """Predictions of bytes that their longest context, if seen at all, never had."""
        out = np.zeros(len(grams))
        todo = np.arange(len(grams))
        row = self._context(grams, ORDER)
        longer = row  # row of the longer context whose bytes are excluded, or -1
        table = self.contexts.values
        out += np.where(row >= 0, table[row, 1] if len(table) else 0.0, 0.0)
        for order in range(ORDER - 1, -1, -1):
            g, lo = grams[todo], longer[todo]
            at = self.shorter.find(g & np.uint64((1 << 8 * (order + 1)) - 1) | np.uint64(order + 1 << 56))
            own = self._context(g, order)
            if not len(table):
                break
            excluded = lo >= 0
            seen = at >= 0
            base = np.where(excluded, table[lo, 2], table[own, 0])
            escape = np.where(excluded, table[lo, 3], np.where(own >= 0, table[own, 1], 0.0))
            out[todo] += np.where(seen, self.shorter.values[at] - base if len(self.shorter.values) else 0.0, escape)
            longer[todo] = own
            todo = todo[~seen]
        out[todo] += self.unseen
        return out


_TRIES: dict[tuple, Trie] = {}


# ---------------------------------------------------------------- scoring

PART_SCHEMA = ("doc_id long, text_hash long, shard int, bytes_log10 double, n_tokens long, head_sum double, head_known long, "
               "tail_tokens long, tail array<struct<word:binary,tf:int>>")


def _numbers(counts: DataFrame, key: Column) -> tuple[np.ndarray, np.ndarray]:
    got = counts.select(key.alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    return got["k"].to_numpy(np.uint64), got["n"].to_numpy(np.int64)


def _shard(key: Column, shards: int) -> Column:
    """The shard of a context's last three bytes; the same in Spark and in :func:`_own`."""
    last_three = F.shiftright(key, 8).bitwiseAND(F.lit(0xFFFFFF))
    return F.shiftright((last_three * SPREAD).bitwiseAND(F.lit(0xFFFFFFFF)), 8) % shards


def _own(grams: np.ndarray, shard: int, shards: int) -> np.ndarray:
    last_three = grams >> np.uint64(8) & np.uint64(0xFFFFFF)
    return ((last_three * np.uint64(SPREAD) & np.uint64(0xFFFFFFFF)) >> np.uint64(8)) % np.uint64(shards) == np.uint64(shard)


def _score_shard(texts: DataFrame, levels_of: tuple, shard: int, shards: int, head: dict[bytes, float] | None) -> DataFrame:
    """The written parts of every text's score: the positions of one shard of contexts, and (with ``head``) the words.
    The shard's counts are let go when its part is written."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast((levels_of, head))
    key = (context.applicationId, shard, uuid.uuid4().hex)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = shared.value
        trie = _TRIES.get(key)
        if trie is None:
            _TRIES.clear()
            trie = _TRIES[key] = Trie(build_levels(*counts))
        for piece, data, offsets in text_pieces(batches):
            raw = data.tobytes().lower()
            buffer, starts, stops = _padded(raw, offsets)
            grams = _grams(buffer)
            inside = _within(len(buffer), starts, stops)
            if shards > 1:
                inside &= _own(grams, shard, shards)
            logs = np.zeros(len(buffer) + 1)
            logs[:-1][inside] = trie.log10(grams[inside])
            bounds = np.stack([starts, stops + 1], axis=1).ravel()
            sums = np.add.reduceat(logs, bounds)[::2]
            words = [_word_part(raw[a:b], known) for a, b in zip(offsets[:-1], offsets[1:])] if known is not None else \
                [(0, 0.0, 0, 0, [])] * piece.num_rows
            n, head_sum, head_known, tail_n, tail = zip(*words)
            yield pa.record_batch(
                [piece.column(0), piece.column(2), pa.array([shard] * piece.num_rows, pa.int32()), pa.array(sums),
                 pa.array(n, pa.int64()), pa.array(head_sum, pa.float64()), pa.array(head_known, pa.int64()),
                 pa.array(tail_n, pa.int64()), pa.array(tail, pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())])))],
                names=["doc_id", "text_hash", "shard", "bytes_log10", "n_tokens", "head_sum", "head_known", "tail_tokens", "tail"])

    part = written(map_batches(texts.withColumn("text_hash", F.xxhash64("text")), parts, PART_SCHEMA), "ppm-parts")
    shared.destroy()
    return part


def _word_part(text: bytes, known: dict[bytes, float]) -> tuple:
    words = text.split()
    logs = list(map(known.get, words, repeat(0.0)))  # a known word's logarithm is above 0
    tail = Counter([w for w, x in zip(words, logs) if not x])
    rest = sum(tail.values())
    return len(words) + 1, sum(logs), len(words) - rest, rest, [{"word": w, "tf": c} for w, c in tail.items()]


def _head(words: DataFrame, most: int) -> tuple[dict[bytes, float], int]:
    """Words that occur so often that there are at most ``most`` such words: their log10(n + 0.1); least count."""
    steps = 8
    level = F.floor(F.log2("n") * steps)
    table = sorted(words.where(F.col("n") >= 2).groupBy(level.alias("l")).count().collect(), key=lambda r: -r["l"])
    total, lowest = 0, None
    for r in table:
        if total + r["count"] > most:
            break
        total, lowest = total + r["count"], r["l"]
    if lowest is None:
        return {}, 1 << 62
    found = words.where((F.col("n") >= 2) & (level >= lowest)).select(F.expr("substring(key, 2)").alias("w"), "n").toPandas()
    return {bytes(w): float(np.log10(n + 0.1)) for w, n in zip(found["w"], found["n"])}, int(lowest)


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row; ``training`` (over doc_id) says
    which rows are learned from."""
    texts = id_text(docs, id_col, text_col)
    counts = count_corpus(texts.where(training))
    grams = counts.where(F.col("kind") == F.lit(bytearray(GRAM))).select(_gram_number(F.col("key")).alias("gram"), "n")
    words = counts.where(F.col("kind") == F.lit(bytearray(WORD)))
    ends = counts.where(F.col("kind") == F.lit(bytearray(END))).agg(F.sum("n")).first()[0] or 0
    size = words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    train_tokens, distinct = (size["n"] or 0) + ends, size["v"] + (1 if ends else 0)
    spread = float(np.log10(train_tokens + 0.1 * (distinct + 1)))
    head, lowest = _head(words, HEAD_WORDS)

    shards = -(-grams.count() // SHARD_ENTRIES) or 1
    short = _numbers(grams, F.col("gram").bitwiseAND(F.lit(0xFFFFFF)))
    table = None
    for shard in range(shards):
        own = grams if shards == 1 else grams.where(_shard(F.col("gram"), shards) == shard)
        part = _score_shard(texts, (short, _numbers(own, F.col("gram"))), shard, shards, head if shard == 0 else None)
        table = part if table is None else table.unionByName(part)

    # rows that repeat id and text have equal parts: one of them stands for all
    once = table.groupBy("doc_id", "text_hash", "shard").agg(
        F.count("*").alias("copies"), *[F.max(c).alias(c) for c in
                                        ("bytes_log10", "n_tokens", "head_sum", "head_known", "tail_tokens")])
    whole = once.groupBy("doc_id", "text_hash").agg(
        F.max("copies").alias("copies"), *[F.sum(c).alias(c) for c in
                                           ("bytes_log10", "n_tokens", "head_sum", "head_known", "tail_tokens")])
    rare = words.where((F.col("n") < 2) | (F.floor(F.log2("n") * 8) < lowest)) \
        .select(F.expr("substring(key, 2)").alias("word"), F.col("n").alias("c"))
    tail = table.where(F.size("tail") > 0).select("doc_id", "text_hash", F.explode("tail").alias("t")) \
        .select("doc_id", "text_hash", "t.word", "t.tf").join(rare, "word") \
        .groupBy(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash")) \
        .agg(F.sum("tf").alias("tail_known"), F.sum(F.col("tf") * (F.log10(F.col("c") + 0.1) - F.log10(F.lit(0.1)))).alias("tail_sum"))
    joined = whole.join(tail, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_hash") == F.col("t_hash")), "left")
    known_tail = F.coalesce(F.floor(F.col("tail_known") / F.col("copies")), F.lit(0)).cast("long")
    tail_sum = F.coalesce(F.col("tail_sum") / F.col("copies"), F.lit(0.0)) + F.col("tail_tokens") * F.log10(F.lit(0.1))
    end_log = F.lit(float(np.log10(ends + 0.1)))
    return joined.select(
        "doc_id", "n_tokens", (F.col("head_known") + known_tail + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + tail_sum + end_log - F.col("n_tokens") * spread).alias("base_score"),
        F.col("bytes_log10").alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
