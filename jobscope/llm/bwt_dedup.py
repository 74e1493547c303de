"""Exact removal of repeated byte strings by bounded interval expansion on a Burrows-Wheeler transform (operator 8).

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier: in a document with a smaller id, or
earlier in the same one.  What matters is thus, for every place a string of LENGTH bytes starts, whether an equal one
starts earlier.

1.  Places are dealt by content.  Of the GRAM-byte grams of a string the one with the smallest hash (the first of equal
    ones) is its anchor; equal strings have equal anchors at equal offsets.  Neighbouring places with one anchor form a
    segment: anchor, hash of all its bytes, document, first place, number of places.
2.  Segments are sorted by anchor and content and stream by.  Of equal segments the earliest stands for all, every
    other one is a repeat in all its places.  Whole copies of documents end here.
3.  Earliest segments whose anchor has other contents too are fetched as bytes.  Buckets of such segments, a bucket
    holding all segments of its anchors and a bounded number of bytes, are concatenated; from their suffix order and
    its Burrows-Wheeler transform, intervals of equal prefixes are extended backwards, breadth first, one byte a level,
    by which every border between neighbouring suffixes gets its common prefix length, in increasing order.  The
    expansion stops at LENGTH: borders that are still open lie between equal strings.  An anchor with more bytes than
    a bucket may hold (a very common passage in ever new surroundings) is dealt again by anchors under other gram
    orders; of equal segments that this makes the earliest again stands for all.  What is still too much is settled
    place by place, by the hash of the whole string, and never enters a transform.
4.  Repeated places become spans by document, and the spans leave the texts.

Edge cases: null and empty texts, and texts shorter than LENGTH, lose nothing; every row is a document of its own, also
where rows share an id or have none: a null id counts as the smallest one, rows of one id come in the order of the
table, and the later one loses what it repeats; matches never cross documents; an empty table gives an empty result;
further columns are ignored (:func:`without_repeats` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import BROADCAST_IDS, id_text, map_batches, release_memory, row_slices, ship, text_pieces, with_row_keys, written
from jobscope.llm.shingles import mix, prefix_hash, span_hash

LENGTH = 100
GRAM = 32
# Entries (some 16 bytes each) up to which lists by document may be broadcast.
BROADCAST_ENTRIES = 2_000_000
# Bytes of segments that one transform is built over.
BUCKET_BYTES = 1 << 20
SEGMENT_SCHEMA = "kind int, anchor long, seg long, doc_id long, first int, places int"
DEALT = ("deal", "doc_id", "first", "places", "content")
DEALT_SCHEMA = "deal long, seg long, doc_id long, first int, places int, content binary"
# Times that a deal above BUCKET_BYTES is dealt again by another anchor before it is settled place by place.
REDEALS = 3
SALTS = 16
STREAM_SCHEMA = "kind int, anchor long, doc_id long, first int, places int"
REPEAT, FETCH = 0, 1


# ---------------------------------------------------------------- segments

def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring keys."""
    out, span = keys, 1
    while 2 * span <= width:
        out = np.minimum(out[:len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, salt: int = 0) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, text number, first place (in the text) and number of places of every segment.

    Each ``salt`` orders the grams in another way."""
    size = len(data)
    none = np.zeros(0, np.int64)
    if size < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    prefix = prefix_hash(data)
    at = np.arange(size - gram + 1)
    grams = mix(span_hash(prefix, at, at + gram) + np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    bits = np.uint64(int(size).bit_length())
    least = _window_least(grams >> bits << bits | at.astype(np.uint64), length - gram + 1)
    anchor = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(anchor)]
    valid = np.arange(len(anchor)) + length <= offsets[1:][text]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(valid & change)  # places of one text are valid up to its last ones
    if not len(start):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    group = np.cumsum(change) - 1
    places = np.bincount(group[valid], minlength=group[-1] + 1)[group[start]]
    whole = mix(span_hash(prefix, start, start + places + length - 1) + places.astype(np.uint64))
    return grams[anchor[start]], whole, text[start], start - offsets[text[start]], places


def segment_rows(texts: DataFrame, length: int) -> DataFrame:
    """All segments.  Of equal ones in the same piece of texts all but the earliest are repeats already; these are
    spread by place instead of anchor, so that the copies of a hot text don't meet in one task."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, offsets in text_pieces(batches):
            anchor, seg, text, first, places = segments(data, offsets, length)
            doc = piece.column(0).to_numpy()[text]
            order = np.lexsort((first, doc, seg))
            seg, doc, first = seg[order], doc[order], first[order]
            head = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else order
            head = np.repeat(head, np.diff(np.append(head, len(seg))))
            repeat = (doc != doc[head]) | (first != first[head])
            anchor = np.where(repeat, mix(doc.astype(np.uint64) ^ mix(first.astype(np.uint64))), anchor[order])
            yield pa.record_batch([pa.array(np.where(repeat, REPEAT, FETCH).astype(np.int32)), pa.array(anchor.astype(np.int64)),
                                   pa.array(seg.astype(np.int64)), pa.array(doc), pa.array(first.astype(np.int32)),
                                   pa.array(places[order].astype(np.int32))],
                                  names=["kind", "anchor", "seg", "doc_id", "first", "places"])

    return map_batches(texts, rows, SEGMENT_SCHEMA)


def sort_out(rows: DataFrame) -> DataFrame:
    """Repeats (all but the earliest of equal segments) and the segments to fetch (earliest ones of an anchor with
    several contents), from segments streaming by in order; no group is gathered."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # last row; the first segment of the present anchor while it is its only one
        for batch in batches:
            known = pa.compute.equal(batch.column(0), REPEAT)
            yield batch.filter(known).select(["kind", "anchor", "doc_id", "first", "places"])
            batch = batch.filter(pa.compute.invert(known))
            if not batch.num_rows:
                continue
            anchor, seg, doc, first, places = (batch.column(i).to_numpy() for i in range(1, 6))
            new_anchor = np.concatenate([[last is None or anchor[0] != last[0]], anchor[1:] != anchor[:-1]])
            new_seg = new_anchor | np.concatenate([[last is None or seg[0] != last[1]], seg[1:] != seg[:-1]])
            same_place = np.concatenate([[last is not None and (doc[0], first[0]) == last[2:4]],
                                         (doc[1:] == doc[:-1]) & (first[1:] == first[:-1])])
            repeat = ~new_seg & ~same_place
            # rows that repeat the earliest one (an id twice) stand next to it and are no repeats
            earliest = np.flatnonzero(new_seg)
            own = anchor[earliest]
            next_same, prev_same = np.zeros(len(own), bool), np.zeros(len(own), bool)
            next_same[:-1] = prev_same[1:] = own[1:] == own[:-1]
            if len(earliest) and not new_anchor[earliest[0]]:
                prev_same[0] = True  # a further content of the anchor that the last batch ended in
            out = earliest[next_same | prev_same]
            columns = [np.concatenate([x[repeat], x[out]]) for x in (anchor, doc, first, places)]
            kind = np.concatenate([np.full(int(repeat.sum()), REPEAT), np.full(len(out), FETCH)])
            if held is not None and len(earliest) and not new_anchor[earliest[0]]:
                columns = [np.append(c, h) for c, h in zip(columns, held)]
                kind = np.append(kind, FETCH)
            yield pa.record_batch([pa.array(kind.astype(np.int32)), pa.array(columns[0]), pa.array(columns[1]),
                                   pa.array(columns[2].astype(np.int32)), pa.array(columns[3].astype(np.int32))],
                                  names=["kind", "anchor", "doc_id", "first", "places"])
            if len(earliest):
                e = earliest[-1]
                alone = not (prev_same[-1] or next_same[-1])
                held = (anchor[e], doc[e], first[e], places[e]) if alone else None
            last = (anchor[-1], seg[-1], doc[-1], first[-1])

    order = ["kind", "anchor", "seg", "doc_id", "first"]
    return map_batches(rows.repartition("anchor").sortWithinPartitions(*order), stream, STREAM_SCHEMA)


# ---------------------------------------------------------------- the transform

def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by ranking spans of spans; symbols fit 9 bits.

    Ties stand in any order: intervals of shorter prefixes hold them whole."""
    n, span = len(symbols), 7
    times, bits = (3, np.uint64(21)) if n < 1 << 21 else (2, np.uint64(32))
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(span, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(span):
        key = key << np.uint64(9) | padded[k:k + n]
    while True:
        order = np.argsort(key)
        if span >= depth:
            return order
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]]))  # 0: behind the end
        key = rank
        for k in range(1, times):
            key = key << bits
            key[:max(n - k * span, 0)] |= rank[k * span:]
        span *= times


def open_borders(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes before and at each place of ``order`` share ``length`` symbols or more.

    Intervals of the order that share a prefix are extended backwards over the transform, breadth first.  A prefix's
    interval ends in a border; the first level that reaches a border is its common prefix length, and only intervals
    that reached a new border are extended further.  Symbol 0 separates segments and is never prepended.
    """
    n = len(symbols)
    before = symbols[order - 1]
    before[order == 0] = 0
    steps = np.empty(n, np.int64)
    steps[np.argsort(before, kind="stable")] = np.arange(n)  # where the suffix one symbol longer stands
    open_ = np.ones(n + 1, bool)
    open_[[0, n]] = False
    # level 0: one interval for each symbol
    head = symbols[order]
    low = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    high = np.append(low[1:], n)
    open_[low] = False
    owner = np.zeros(n, np.int64)
    for _ in range(1, length):
        if not len(low):
            break
        width = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        interval = np.repeat(np.arange(len(low)), width)
        some = before[at] != 0
        to = steps[at[some]]
        owner[to] = interval[some]
        to.sort()
        # a new interval is a run of one symbol and one old interval
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1] + 1) | (owner[to[1:]] != owner[to[:-1]]) | (head[to[1:]] != head[to[:-1]])
        low = to[new]
        high = to[np.append(np.flatnonzero(new)[1:] - 1, len(to) - 1)] + 1 if len(to) else low
        fresh = open_[high]
        low, high = low[fresh], high[fresh]
        open_[high] = False
    return open_[:n]


def repeated_places(contents: list[bytes], docs: np.ndarray, first: np.ndarray, places: np.ndarray, length: int = LENGTH
                    ) -> tuple[np.ndarray, np.ndarray]:
    """Documents and places of the strings that also start earlier, among the segments given with their bytes."""
    joined = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    sizes = np.array([len(c) for c in contents])
    start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = joined.astype(np.int16) + np.int16(1)
    symbols[start + sizes] = 0
    order = suffix_order(symbols, length)
    same = open_borders(symbols, order, length)
    # places that a segment owns, with document and place of each
    where = np.repeat(start - np.concatenate([[0], np.cumsum(places)[:-1]]), places) + np.arange(places.sum())
    number = np.full(len(symbols), -1)
    number[where] = np.arange(len(where))
    doc = np.repeat(docs, places)
    place = where - np.repeat(start, places) + np.repeat(first, places)
    string = np.cumsum(~same)  # equal strings have equal numbers
    owned = number[order]
    mine = owned >= 0
    owned, string = owned[mine], string[mine]
    by = np.lexsort((place[owned], doc[owned], string))
    owned, string = owned[by], string[by]
    later = np.concatenate([[False], string[1:] == string[:-1]])
    d, p = doc[owned], place[owned]
    group = np.flatnonzero(~later)
    head = np.repeat(group, np.diff(np.append(group, len(owned))))
    later &= (d != d[head]) | (p != p[head])  # the same place twice (rows that repeat an id) is no repeat
    return d[later], p[later]


def runs(doc: np.ndarray, first: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring and overlapping ranges of places of one document as one."""
    by = np.lexsort((first, doc))
    doc, first, last = doc[by], first[by], first[by] + places[by]
    if not len(doc):
        return doc, first, places
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    # a running maximum of ends by document, by lifting every document above the one before
    lift = np.cumsum(new_doc) * (int(last.max()) + 1)
    reach = np.maximum.accumulate(last + lift)
    new = new_doc | np.concatenate([[True], first[1:] + lift[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    ends = reach[np.append(at[1:] - 1, len(doc) - 1)] - lift[at]
    return doc[at], first[at], ends - first[at]


def settled(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The earliest of the written ``rows`` with equal ``deal, seg``, and ``doc_id, first, places`` of all other places.

    The earliest ones are aggregated before they are dealt, and joined back broadcast or salted: no group is gathered."""
    own = [c for c in rows.columns if c not in ("deal", "seg")]
    kept = written(rows.groupBy("deal", "seg").agg(F.min(F.struct("doc_id", "first", *[c for c in own if c not in ("doc_id", "first")])).alias("e"),
                                                   F.count("*").alias("n")).select("deal", "seg", "e.*", "n"), name)
    several = kept.where(F.col("n") > 1).select("deal", "seg", F.col("doc_id").alias("e_id"), F.col("first").alias("e_first"))
    rows = rows.select("deal", "seg", "doc_id", "first", "places")
    if several.count() <= BROADCAST_IDS // 4:
        joined = rows.join(F.broadcast(several), ["deal", "seg"])
    else:
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "first"), F.lit(SALTS)).cast("int")).join(
            several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["deal", "seg", "salt"])
    # the same place twice (rows that repeat an id) is no repeat
    others = joined.where((F.col("doc_id") != F.col("e_id")) | (F.col("first") != F.col("e_first")))
    return kept.select("deal", "seg", *own), others.select("doc_id", "first", "places")


def in_buckets(fetched: DataFrame, length: int) -> tuple[DataFrame, DataFrame | None]:
    """The fetched segments (``anchor, doc_id, first, places, content``) with their ``bucket``, and the repeats that
    were found on the way to them."""
    ship(fetched.sparkSession)

    def redealt(salt: int):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece, data, offsets in text_pieces(batches, "content"):
                anchor, seg, text, first, places = segments(data, offsets, length, salt=salt)
                raw = data.tobytes()
                start = offsets[:-1][text] + first
                old, doc, at = (piece.column(i).to_numpy() for i in range(3))
                yield pa.record_batch(
                    [pa.array((mix(old[text].astype(np.uint64)) ^ anchor).astype(np.int64)), pa.array(seg.astype(np.int64)),
                     pa.array(doc[text]), pa.array((at[text] + first).astype(np.int32)), pa.array(places.astype(np.int32)),
                     pa.array([raw[a:a + n + length - 1] for a, n in zip(start, places)], pa.binary())],
                    names=["deal", "seg", "doc_id", "first", "places", "content"])
        return deal

    # segments of a deal too large for a bucket are dealt again by further anchors, at last settled place by place
    parts, repeats, rows = [], [], fetched.select(F.col("anchor").alias("deal"), "doc_id", "first", "places", "content")
    total = 0
    for salt in range(1, REDEALS + 2):
        per_deal = written(rows.groupBy("deal").agg(F.sum(F.octet_length("content") + 1).alias("bytes")), "deals")
        hot = per_deal.where(F.col("bytes") > BUCKET_BYTES).select("deal")
        n_hot = hot.count()
        total += per_deal.where(F.col("bytes") <= BUCKET_BYTES).agg(F.sum("bytes")).first()[0] or 0
        if not n_hot:
            parts.append(rows.select(*DEALT))
            break
        hot = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot
        parts.append(rows.join(hot, "deal", "left_anti").select(*DEALT))
        warm = rows.join(hot, "deal", "left_semi").select(*DEALT)
        if salt <= REDEALS:
            rows, again = settled(written(map_batches(warm, redealt(salt), DEALT_SCHEMA), "dealt-again"), "dealt-once")
        else:
            # equal strings have equal deals, so all places of a string are here
            single = written(warm.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).select(
                "deal", F.xxhash64(F.expr(f"substring(content, k + 1, {length})")).alias("seg"), "doc_id",
                (F.col("first") + F.col("k")).alias("first"), F.lit(1).alias("places")), "places")
            again = settled(single, "places-once")[1]
        repeats.append(again)
    buckets = max(1, -(-2 * total // BUCKET_BYTES))
    rows = reduce(DataFrame.unionByName, parts).withColumn("bucket", F.pmod(F.xxhash64("deal"), F.lit(buckets)))
    return rows, reduce(DataFrame.unionByName, repeats) if repeats else None


def transformed(fetched: DataFrame, length: int) -> DataFrame:
    """``doc_id, first, places``: repeats among the fetched segments (``anchor, doc_id, first, places, content``)."""
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        doc, place = repeated_places(rows["content"].tolist(), rows["doc_id"].to_numpy(np.int64), rows["first"].to_numpy(np.int64),
                                     rows["places"].to_numpy(np.int64), length)
        doc, first, places = runs(doc, place, np.ones(len(doc), np.int64))
        release_memory()  # the transform's arrays
        return pd.DataFrame({"doc_id": doc, "first": first.astype(np.int32), "places": places.astype(np.int32)})

    rows, repeats = in_buckets(fetched, length)
    found = rows.groupBy("bucket").applyInPandas(search, "doc_id long, first int, places int")
    return found if repeats is None else found.unionByName(repeats)


# ---------------------------------------------------------------- spans

def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, spans`` (``start, stop`` in bytes, in order, apart) of the bytes to remove, for documents with any."""
    sorted_out = written(sort_out(segment_rows(texts, length)), "segments")
    wanted = written(sorted_out.where(F.col("kind") == FETCH).select("anchor", "doc_id", "first", "places").distinct()
                     .groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "first", "places")).alias("segs")), "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, offsets in text_pieces(batches):
            raw = data.tobytes()
            out: list[tuple] = []
            for doc, lo, hi, segs in zip(piece.column(0).to_pylist(), offsets[:-1], offsets[1:], piece.column(2).to_pylist()):
                for s in segs:
                    stop = lo + s["first"] + s["places"] + length - 1
                    if stop <= hi:
                        out.append((s["anchor"], doc, s["first"], s["places"], raw[lo + s["first"]:stop]))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                                  names=["anchor", "doc_id", "first", "places", "content"])

    joined = texts.join(_narrow(wanted), "doc_id").select("doc_id", "text", "segs")
    fetched = written(map_batches(joined, fetch, "anchor long, doc_id long, first int, places int, content binary"), "contents")
    repeats = sorted_out.where(F.col("kind") == REPEAT).select("doc_id", "first", "places") \
        .unionByName(transformed(fetched, length))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for places in batch.column(1).to_pylist():
                first, n = (np.array([p[k] for p in places], np.int64) for k in ("first", "places"))
                _, first, n = runs(np.zeros(len(first), np.int64), first, n + (length - 1))
                spans.append([{"start": int(a), "stop": int(a + k)} for a, k in zip(first, n)])
            yield pa.record_batch([batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                                  names=["doc_id", "spans"])

    by_doc = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("first", "places")).alias("places"))
    return written(map_batches(by_doc, merge, "doc_id long, spans array<struct<start:int,stop:int>>"), "spans")


def _narrow(lists: DataFrame) -> DataFrame:
    """A table of one list a document, marked for broadcast if all lists together have few entries."""
    column = lists.columns[1]
    entries = lists.agg(F.sum(F.size(column))).first()[0] or 0
    return F.broadcast(lists) if entries <= BROADCAST_ENTRIES else lists


def _cut(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left, bytes removed, spans that lie in the text."""
    if not spans:
        return raw, 0, 0
    parts, at, n = [], 0, 0
    for s in spans:
        if s["start"] >= len(raw):
            break
        parts.append(raw[at:s["start"]])
        at, n = min(s["stop"], len(raw)), n + 1
    kept = b"".join(parts) + raw[at:]
    return kept, len(raw) - len(kept), n


ROW_KEY = "repeat_row_key"


def _keyed_spans(docs: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a key for every row, and the spans by key."""
    keyed = with_row_keys(docs, id_col, ROW_KEY)
    spans = _narrow(repeated_spans(id_text(keyed, ROW_KEY, text_col), length))
    return keyed, spans.withColumnsRenamed({"doc_id": "s_id", "spans": "s_spans"})


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that are left) for every row."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, offsets in text_pieces(batches):
            raw = data.tobytes()
            sizes = np.diff(offsets)
            kept, removed, n = zip(*(_cut(raw[a:b], s) for a, b, s in zip(offsets[:-1], offsets[1:], piece.column(2).to_pylist())))
            yield pa.record_batch([piece.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()),
                                   pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed, spans = _keyed_spans(narrow, "doc_id", "text", length)
    return map_batches(keyed.join(spans, F.col(ROW_KEY) == F.col("s_id"), "left").select("doc_id", "text", "s_spans"), cut,
                       "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes taken out of their texts; what a cut leaves of a character goes with it."""
    names = docs.columns
    at = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_slices(batches, at):
            texts = [t if t is None or not s else _cut(t.encode(), s)[0].decode("utf-8", "ignore")
                     for t, s in zip(rows.column(at).to_pylist(), rows.column(len(names)).to_pylist())]
            columns = [pa.array(texts, pa.string()) if i == at else rows.column(i) for i in range(len(names))]
            yield pa.record_batch(columns, names=names)

    keyed, spans = _keyed_spans(docs, id_col, text_col, length)
    joined = keyed.join(spans, F.col(ROW_KEY) == F.col("s_id"), "left").select(*[keyed[c] for c in names], "s_spans")
    return map_batches(joined, cut, docs.schema)
