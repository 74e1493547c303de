"""N-gram Jaccard join over a count-vector R-tree (operator 4).

A document's set of word shingles is hashed into ``GROUPS`` groups, or more for a large set (:func:`width_of`); the counts
by group are its point, which folds to one with fewer groups.  Two sets share
at most sum(min(a_g, b_g)) shingles, and for a whole node of an R-tree over points at most sum(min(a_g, high_g)), with
``high`` the upper corner of its box; a pair or node below the overlap that the similarity asks for is passed over, and
what survives is verified on the sets themselves.

A tree over all points of a large table prunes little (counts of long texts crowd around their mean), so the points are
first dealt to buckets by finer groups of the same kind, exactly.  Sets with similarity t or more differ in at most
d = (1 - t) / t * n shingles, hence in at most d of the groups into which the hash range is cut; of the first d + 1
groups that hold anything, one is equal in both.  Each set is dealt to the buckets named by those d + 1 groups' whole
contents: any pair that links meets in a bucket, while texts that merely share a passage hardly ever do.  (A set that
fills d groups or fewer, which the number of groups makes very rare, is dealt by its first d + 1 shingles as well; all
groups that a linked pair fills can differ only if both sets are of this kind.)  The number of groups follows from the
size; a set takes part at its own size's level and, near its upper end, at the next.

1.  Equal sets are one class (their fingerprint); only classes go on.
2.  Buckets with two classes or more are kept.  Every member whose point leaves room for it is verified against the class
    of its buckets that shares most buckets with others, and links give a first division into components.  Large groups of near copies, which are edited
    from one text, are joined here, in linear work.
3.  Buckets that still hold several components are searched with the R-tree, in pairs of blocks of bounded size, for
    pairs of different components; those that pass the bound in all their groups too are verified.  With their links
    the components are final.

Every link between different components is looked at, so no link is lost; links inside a component needn't be listed.
Hashes have 64 bits: different sets or group contents count as equal with a chance of 2^-64 a pair.

Edge cases: null texts and texts without words have the empty set, and link with nothing; a text with fewer words than
a shingle has its whole sequence as one; rows that repeat an id are rows of their own, each in the component
of its own text; a row without an id is compared like any other, but names no component (null where no member has an id) and is
never taken out by :func:`one_of_each`; ties don't arise (the smallest id names a component); an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import id_text, map_batches, ship, small_or_shuffled, text_pieces, written
from jobscope.llm.components import components
from jobscope.llm.shingles import mix, shingle_hashes

GROUPS = 128
# A point has more groups, up to so many, while a group would hold GROUP_SHINGLES shingles or more on average: with many in
# each, the counts of any two sets overlap.
MOST_GROUPS = 1 << 13
GROUP_SHINGLES = 8
LEAF = 32
# Pairs whose bounds are worked out at once, at GROUPS groups.
BOUND_PAIRS = 1 << 15
# Smallest size whose sets are cut into groups; smaller sets are dealt by single shingles.
LEAST_CUT = 16
LEVEL_RATIO = 1.5
BLOCK_ROWS = 1024
# Rows of buckets that one call searches, about.
CALL_ROWS = 1 << 15
# Bytes of points that one call searches, and of sets (8 a shingle) that one call verifies, about, and those of a block of a family.
CALL_BYTES = 16 << 20
FAMILY_BYTES = 2 << 20
# Classes up to which a task remembers those whose buckets it has dealt.
SEEN_CLASSES = 1 << 19
SALTS = 16
CLASS_SCHEMA = "doc_id long, n long, fp long, text_hash long, point binary"
KEY_SCHEMA = "key long, fp long"
SET_SCHEMA = "fp long, h binary"


# ---------------------------------------------------------------- buckets

def differing(n: int, t: Fraction) -> int:
    """Shingles in which a set of ``n`` can differ at most from one with similarity ``t`` to it."""
    return int((1 - t) / t * n)


@lru_cache(maxsize=1 << 16)
def level_of(n: int) -> int:
    """0 below LEAST_CUT, else the number of the size class."""
    if n < LEAST_CUT:
        return 0
    level = int(np.log(n / LEAST_CUT) / np.log(LEVEL_RATIO)) + 1
    while level_start(level) > n:
        level -= 1
    while level_start(level + 1) <= n:
        level += 1
    return level


def level_start(level: int) -> int:
    return 1 if level == 0 else int(np.ceil(LEAST_CUT * LEVEL_RATIO ** (level - 1)))


@lru_cache(maxsize=1 << 12)
def cuts_of(level: int, t: Fraction) -> int:
    """Groups into which sets of a level are cut: with a wide margin more of them hold something than may differ.
    0: the shingles themselves are the groups."""
    if level == 0:
        return 0
    ends = (level_start(level), level_start(level + 1) - 1)
    cuts = int(1.3 * (differing(ends[1] + 1, t) + 1)) + 6
    while any(cuts * (1 - np.exp(-n / cuts)) < 1.15 * (differing(n, t) + 1) + 4 for n in ends):
        cuts = int(cuts * 1.25) + 1
        if cuts > 4 * ends[1]:
            return 0
    return cuts


def bucket_keys(h: np.ndarray, t: Fraction) -> np.ndarray:
    """Bucket names of the sorted set ``h`` of hashes."""
    n = len(h)
    need = differing(n, t) + 1
    own = level_of(n)
    out = []
    for level in range(own, level_of(int(n / t)) + 1):  # its own level and those of larger partners
        tag = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        cuts = cuts_of(level, t)
        if not cuts:
            out.append(mix(h[:need] + tag))
            continue
        group = (h >> np.uint64(32)) * np.uint64(cuts) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        contents = np.add.reduceat(h, first)[:need]
        out.append(mix(mix(contents + group[first[:need]] * np.uint64(0xD1B54A32D192ED03)) + tag))
        if len(first) < need:  # so few that all may differ: then a partner has no more, and both are dealt by shingles too
            out.append(mix(h[:need] + ~tag))
    return np.concatenate(out)


def class_rows(texts: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, fp, text_hash, point``: size and fingerprint of every text's set (null for the empty set), the hash of
    the text, which tells rows of one id apart, and the set's counts by group."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, offsets in text_pieces(batches):
            sets = _sets(data, offsets, words)
            yield pa.record_batch([piece.column(0), pa.array([len(h) for h in sets], pa.int64()),
                                   pa.array([fingerprint(h) for h in sets], pa.int64()), piece.column(2),
                                   pa.array([packed(points(h)) if len(h) else None for h in sets], pa.binary())],
                                  names=["doc_id", "n", "fp", "text_hash", "point"])

    return map_batches(texts.withColumn("text_hash", F.xxhash64("text")), rows, CLASS_SCHEMA)


def key_rows(texts: DataFrame, t: Fraction, words: int) -> DataFrame:
    """``key, fp``: every class's buckets, once a task: copies of a text don't meet in the tasks of its keys.  They are
    worked out where they are dealt, and never written."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data, offsets in text_pieces(batches):
            if len(seen) > SEEN_CLASSES:  # what is then dealt twice changes nothing
                seen.clear()
            own = {fp: h for h in _sets(data, offsets, words) if (fp := fingerprint(h)) is not None and fp not in seen}
            seen.update(own)
            keys = [bucket_keys(h, t).astype(np.int64) for h in own.values()]
            fps = np.repeat(np.array(list(own), np.int64), [len(k) for k in keys])
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), pa.array(fps)], names=["key", "fp"])

    return map_batches(texts, rows, KEY_SCHEMA)


def fingerprint(h: np.ndarray) -> int | None:
    """A number for the set of hashes, equal for equal sets; none for the empty set."""
    return int(mix(h.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h))).astype(np.int64)[0]) if len(h) else None


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    lower = np.frombuffer(data.tobytes().lower(), np.uint8)
    hashes, first = shingle_hashes(lower, offsets, words)
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]


def shared_buckets(keyed: DataFrame) -> DataFrame:
    """``key, fp, low``: members of the buckets that hold two classes or more, with the bucket's lowest class.

    Sorted streams: a bucket's rows pass by, none is gathered.
    """
    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_fp, low = None, None, 0  # the bucket that the previous batch ended in
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            new = np.concatenate([[key[0] != last_key], key[1:] != key[:-1]])
            once = new | np.concatenate([[fp[0] != last_fp], fp[1:] != fp[:-1]])  # copies of a class stand side by side
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            lows = np.where(start >= 0, fp[np.maximum(start, 0)], low)
            second = once & (fp != lows)
            yield pa.record_batch([pa.array(key[second]), pa.array(fp[second]), pa.array(lows[second])], names=["key", "fp", "low"])
            last_key, last_fp, low = key[-1], fp[-1], lows[-1]

    return map_batches(keyed.repartition("key").sortWithinPartitions("key", "fp"), later, "key long, fp long, low long")


# ---------------------------------------------------------------- points and their tree

def width_of(n: int) -> int:
    """Groups of the point of a set of ``n``: GROUPS times a power of two."""
    width = GROUPS
    while n >= GROUP_SHINGLES * width and width < MOST_GROUPS:
        width *= 2
    return width


def points(h: np.ndarray) -> np.ndarray:
    width = width_of(len(h))
    return np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width)


def packed(point: np.ndarray) -> bytes:
    """A byte a count, or four where one is above 255."""
    return point.astype("u1" if point.max() < 256 else "<i4").tobytes()


def unpacked(points_: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
    """Points of sets of these sizes, folded to ``width`` groups; each has as many or a multiple."""
    if all(len(p) == GROUPS == width for p in points_):
        return np.frombuffer(b"".join(points_), "u1").reshape(-1, GROUPS).astype(np.int32)
    out = np.empty((len(points_), width), np.int32)
    for k, (p, n) in enumerate(zip(points_, sizes.tolist())):
        out[k] = np.frombuffer(p, "u1" if len(p) == width_of(n) else "<i4").reshape(-1, width).sum(axis=0)
    return out


def leave_room(points_: list[bytes], n: np.ndarray, left: np.ndarray, right: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether the points (``left`` and ``right`` are places in ``points_``) leave room for a similarity of ``t``, in all the
    groups that both have."""
    num, den = t.numerator, t.numerator + t.denominator  # overlap >= t / (1 + t) * (sum of sizes)
    fits = np.minimum(n[left], n[right]) * t.denominator >= np.maximum(n[left], n[right]) * t.numerator
    widths = np.array([width_of(x) for x in n.tolist()], np.int64)
    width_of_both = np.minimum(widths[left], widths[right])
    for width in np.unique(width_of_both[fits]).tolist():
        own = np.flatnonzero(fits & (width_of_both == width))
        step = BOUND_PAIRS * GROUPS // width
        for at in (own[k:k + step] for k in range(0, len(own), step)):
            ends, place = np.unique(np.concatenate([left[at], right[at]]), return_inverse=True)
            counts = unpacked([points_[e] for e in ends.tolist()], n[ends], width)
            shared = np.minimum(counts[place[:len(at)]], counts[place[len(at):]]).sum(axis=1, dtype=np.int64)
            fits[at] = shared * den >= num * (n[left[at]] + n[right[at]])
    return fits


class CountTree:
    """A packed R-tree over count vectors: leaves of LEAF points, tiled along the widest sides, and boxes above."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.arange(len(vectors))
        if len(vectors):
            self.order = np.concatenate(list(self._tile(vectors, self.order)))
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        high, least, most = self.vectors, self.sizes, self.sizes
        while len(high) > 1:
            edge = np.arange(0, len(high), LEAF)
            high = np.maximum.reduceat(high, edge, axis=0)
            least, most = np.minimum.reduceat(least, edge), np.maximum.reduceat(most, edge)
            self.levels.append((high, least, most))

    def _tile(self, vectors: np.ndarray, own: np.ndarray) -> Iterator[np.ndarray]:
        if len(own) <= LEAF:
            yield own
            return
        v = vectors[own]
        own = own[np.argsort(v[:, int(np.argmax(v.max(axis=0) - v.min(axis=0)))], kind="stable")]
        half = -(-len(own) // (2 * LEAF)) * LEAF
        yield from self._tile(vectors, own[:half])
        yield from self._tile(vectors, own[half:])

    def search(self, vector: np.ndarray, size: int, t: Fraction) -> np.ndarray:
        """Points whose bounded overlap reaches what similarity ``t`` asks for."""
        num, den = t.numerator, t.numerator + t.denominator  # overlap >= t / (1 + t) * (sum of sizes)
        nodes = np.zeros(1, np.int64) if self.levels else np.arange(len(self.vectors))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most = self.levels[depth]
            bound = np.minimum(high[nodes], vector).sum(axis=1, dtype=np.int64)
            fits = (bound * den >= num * (size + least[nodes])) & (most[nodes] * t.denominator >= size * t.numerator) & \
                (least[nodes] * t.numerator <= size * t.denominator)
            below = len(self.levels[depth - 1][0]) if depth else len(self.vectors)
            nodes = (nodes[fits][:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        bound = np.minimum(self.vectors[nodes], vector).sum(axis=1, dtype=np.int64)
        s = self.sizes[nodes]
        fits = (bound * den >= num * (size + s)) & (s * t.denominator >= size * t.numerator) & (s * t.numerator <= size * t.denominator)
        return self.order[nodes[fits]]


def _leaf_pairs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of neighbours-in-order within the runs of equal ``group`` numbers."""
    size = np.bincount(group)[group] if len(group) else group
    place = np.arange(len(group)) - np.searchsorted(group, group)
    behind = size - 1 - place
    left = np.repeat(np.arange(len(group)), behind)
    step = np.arange(len(left)) - np.repeat(np.cumsum(behind) - behind, behind)
    return left, left + 1 + step


def pairs_of_buckets(rows: pd.DataFrame, ends: pd.DataFrame, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes (``ends``: ``fp, n, point``) of different components that some bucket (``key, i, j``) brings together
    and the bound lets through.  A bucket that fits one leaf has no tree above it: its points are compared as they are."""
    rows = rows.sort_values(["key", "i", "j"], kind="stable")
    ends = ends.sort_values("fp", kind="stable")
    fp, n, points_ = ends["fp"].to_numpy(np.int64), ends["n"].to_numpy(np.int64), ends["point"].tolist()
    end = np.searchsorted(fp, rows["fp"].to_numpy(np.int64))  # classes are named by their places from here on
    key, i, j, block, comp = (rows[c].to_numpy(np.int64) for c in ("key", "i", "j", "block", "comp"))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    group = np.cumsum(new) - 1
    size = np.bincount(group)[group]
    small = np.flatnonzero((size <= LEAF) & (i == j))
    left, right = (small[x] for x in _leaf_pairs(group[small]))
    fits = comp[left] != comp[right]
    a, b = [np.minimum(end[left], end[right])[fits]], [np.maximum(end[left], end[right])[fits]]
    first = np.flatnonzero(new)
    counts = None
    for lo, hi in zip(first, np.append(first[1:], len(rows))):
        if hi - lo <= LEAF and i[lo] == j[lo]:
            continue
        own = np.arange(lo, hi)
        ours, theirs = own[block[own] == i[lo]], own[block[own] == j[lo]]
        if not len(ours) or not len(theirs):
            continue
        if counts is None:
            counts = unpacked(points_, n, GROUPS)
        tree = CountTree(counts[end[theirs]], n[end[theirs]])
        for x in ours:
            at = theirs[tree.search(counts[end[x]], int(n[end[x]]), t)]
            at = at[comp[at] != comp[x]]
            if i[lo] == j[lo]:
                at = at[end[at] > end[x]]
            a.append(np.minimum(end[at], end[x]))
            b.append(np.maximum(end[at], end[x]))
    a, b = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    fits = leave_room(points_, n, a, b, t)
    return fp[a[fits]], fp[b[fits]]


def search_pairs(members: DataFrame, classes: DataFrame, t: Fraction) -> DataFrame:
    """``a, b``: pairs of members (``key, low, fp, comp``; ``classes`` has ``n, point`` by ``fp``) of one bucket, of different components, that the bound
    lets through.  Buckets with the same lowest class have most of their members in common and are searched in one call,
    which finds a pair once however many of them bring it together; above BLOCK_ROWS members a call is cut into blocks,
    and every pair of blocks is searched by itself.  Small calls share a task."""
    ship(members.sparkSession)
    size = members.groupBy("low").agg(F.ceil(F.count_distinct("fp") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = written(
        _salted(members, size, "low", "fp").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        .select("key", "low", "i", "j", "block", "fp", "comp"), "members")
    # a class's point travels once to each call that needs it, not with each of its buckets
    need = written(dealt.select("low", "i", "j", "fp").distinct().join(classes.select("fp", F.octet_length("point").alias("bytes")), "fp"),
                   "needed-points")
    calls = max(-(-dealt.count() // CALL_ROWS), -(-(need.agg(F.sum("bytes")).first()[0] or 0) // CALL_BYTES), 1)
    call = F.pmod(F.xxhash64("low", "i", "j"), F.lit(calls)).alias("call")
    sent = need.select(call, "fp").distinct().join(classes.select("fp", "n", "point"), "fp").select("call", "fp", "n", "point")

    def search(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        a, b = pairs_of_buckets(rows, ends, t)
        part = (mix(b.astype(np.uint64)) % np.uint64(SALTS)).astype(np.int32)
        order = np.lexsort((b, part, a))
        a, b, part = a[order], b[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])])) if len(a) else np.zeros(0, np.int64)
        return pd.DataFrame({"a": a[first], "part": part[first],
                             "others": pd.Series([x.tolist() for x in np.split(b, first[1:])] if len(first) else [], dtype=object)})

    # a class's partners travel as SALTS rows a call at most; calls that share a pair agree on it before it is listed
    return dealt.select(call, "key", "i", "j", "block", "fp", "comp").groupBy("call").cogroup(sent.groupBy("call")) \
        .applyInPandas(search, "a long, part int, others array<long>") \
        .groupBy("a", "part").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others")) \
        .select("a", F.explode("others").alias("b"))


def _salted(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``facts`` (one row a key), a key's rows dealt to SALTS tasks by their column ``by``."""
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [key, "salt"]).drop("salt")


def bounded(pairs: DataFrame, classes: DataFrame, t: Fraction) -> DataFrame:
    """Those ``pairs`` (``family, a, b``) whose counts by group leave room for a similarity of ``t``: a check of a number for
    some shingles, before any set is sent.  Many pairs may have one ``a``."""
    ends = classes.select("fp", "n", "point")
    with_b = pairs.join(ends.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb")), "b")
    with_a = _salted(with_b, ends.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
                     .join(pairs.select("a").distinct(), "a", "left_semi"), "a", "b")

    def room(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left = np.arange(batch.num_rows)
            fits = leave_room(batch["pa"].to_pylist() + batch["pb"].to_pylist(),
                              np.concatenate([batch["na"].to_numpy(), batch["nb"].to_numpy()]).astype(np.int64), left, left + batch.num_rows, t)
            yield batch.select(["family", "a", "b"]).filter(pa.array(fits))

    return map_batches(with_a.select("family", "a", "b", "na", "nb", "pa", "pb"), room, "family long, a long, b long")


def set_rows(texts: DataFrame, words: int) -> DataFrame:
    """``fp, h``: the whole set (sorted 64-bit hashes) of each text (``fp, text``) with that fingerprint."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, offsets in text_pieces(batches):
            # an id may have another text in another row
            sets = [(fp, h) for fp, h in zip(piece.column(0).to_pylist(), _sets(data, offsets, words)) if fp == fingerprint(h)]
            yield pa.record_batch([pa.array([fp for fp, _ in sets], pa.int64()),
                                   pa.array([h.astype("<u8").tobytes() for _, h in sets], pa.binary())], names=["fp", "h"])

    return map_batches(texts, rows, SET_SCHEMA)


def sets_of(texts: DataFrame, holders: DataFrame, words: int) -> DataFrame:
    """Sets of the classes in ``holders`` (``fp, doc_id, text_hash``: a document of each, by its text where no member has an
    id), from the texts: they are never written."""
    holders = written(holders.select("fp", "doc_id", "text_hash"), "holders")
    found = texts.join(small_or_shuffled(holders.where(F.col("doc_id").isNotNull()).select("fp", "doc_id")), "doc_id").select("fp", "text")
    unnamed = holders.where(F.col("doc_id").isNull()).select("fp", "text_hash")
    if not unnamed.isEmpty():
        once = texts.where(F.col("doc_id").isNull()).select(F.xxhash64("text").alias("text_hash"), "text").dropDuplicates(["text_hash"])
        found = found.union(once.join(small_or_shuffled(unnamed), "text_hash").select("fp", "text"))
    return set_rows(found, words)


def verified(pairs: DataFrame, texts: DataFrame, holders: DataFrame, words: int, t: Fraction) -> DataFrame:
    """Those ``pairs`` (``family, a, b``) whose sets have a similarity of ``t`` or more, as ``a, b``.

    The pairs of a family are verified together.  A set travels once to each call that needs it, not once a pair;
    families whose sets have more than FAMILY_BYTES are cut into blocks, and small ones share a call of about CALL_BYTES.
    """
    ship(pairs.sparkSession)
    pairs = written(pairs, "pairs")
    sizes = holders.select("fp", (F.col("n") * 8).alias("bytes"))
    ends = pairs.select("family", F.col("a").alias("fp")).union(pairs.select("family", F.col("b").alias("fp"))).distinct()
    blocks = ends.join(sizes, "fp").groupBy("family").agg(F.ceil(F.sum("bytes") / FAMILY_BYTES).cast("int").alias("blocks"))
    block_a, block_b = (F.pmod(F.xxhash64(c), F.col("blocks")) for c in ("a", "b"))
    dealt = written(_salted(pairs, blocks, "family", "b").select("a", "b", F.xxhash64(
        "family", F.least(block_a, block_b), F.greatest(block_a, block_b)).alias("place")), "dealt-pairs")
    need = dealt.select("place", F.col("a").alias("fp")).union(dealt.select("place", F.col("b").alias("fp"))).distinct()
    need = written(need.join(sizes, "fp"), "needed-sets")
    calls = -(-(need.agg(F.sum("bytes")).first()[0] or 0) // CALL_BYTES) or 1
    call = F.pmod(F.xxhash64("place"), F.lit(calls)).alias("call")
    sets = sets_of(texts, holders.join(need.select("fp").distinct(), "fp", "left_semi"), words)
    sent = sets.join(small_or_shuffled(written(need.select("fp", call).distinct(), "set-calls")), "fp").select("call", "fp", "h")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        own = {fp: np.frombuffer(h.as_buffer(), "<u8") for fp, h in zip(right["fp"].to_pylist(), right["h"])}
        good = []
        for x, y in zip(left["a"].to_pylist(), left["b"].to_pylist()):
            both = np.concatenate([own[x], own[y]])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            good.append(shared * t.denominator >= t.numerator * (len(both) - shared))
        return left.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return dealt.select(call, "a", "b").groupBy("call").cogroup(sent.groupBy("call")).applyInArrow(check, "a long, b long")


# ---------------------------------------------------------------- the join

def similar_components(docs: DataFrame, percent: int = 85, words: int = 4, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, linked, text_hash`` for every row: the smallest id reachable by links (sets of
    shingles of ``words`` words with a Jaccard similarity of ``percent`` / 100 or more), whether it has another member,
    and the hash of its text."""
    t = Fraction(percent, 100)
    texts = id_text(docs, id_col, text_col)
    classes = written(class_rows(texts, words), "classes")
    later = written(shared_buckets(key_rows(texts, t, words)), "buckets")
    buckets = later.union(later.select("key", F.col("low").alias("fp"), "low").distinct())

    # one document of each class in a shared bucket holds its set
    holders = written(classes.join(buckets.select("fp").distinct(), "fp", "left_semi")
                      .groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"),
                                         F.any_value("n").alias("n"), F.any_value("point").alias("point")), "holders")

    # each member against one other class: that of its buckets' members which shares most buckets.  What others
    # are edited from shares more with each of them than they share among themselves.
    shared = buckets.groupBy("fp").agg(F.count("*").alias("shared"))
    known = buckets.select("key", "fp").join(shared, "fp")
    hub = known.groupBy("key").agg(F.max(F.struct("shared", "fp")).alias("hub"))
    stars = known.join(hub, "key").where(F.col("fp") != F.col("hub.fp")) \
        .groupBy(F.col("fp").alias("b")).agg(F.max("hub").alias("hub")) \
        .select(F.col("hub.fp").alias("a"), "b", F.col("hub.fp").alias("family"))
    links = written(verified(bounded(stars, holders, t), texts, holders, words, t), "links")
    first = components(links)

    # buckets that still hold several components
    placed = buckets.join(first.withColumnRenamed("v", "fp"), "fp", "left") \
        .select("key", "low", "fp", F.coalesce("label", "fp").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where(F.col("c0") != F.col("c1"))
    members = placed.join(mixed.select("key"), "key", "left_semi")
    pairs = search_pairs(members, holders, t).select(F.col("a").alias("family"), "a", "b")
    more = written(verified(pairs, texts, holders, words, t), "links")
    # the new links join whole components: only those are labelled again
    one = first.select(F.col("v").alias("end"), "label")
    joined = more.join(one, F.col("a") == F.col("end"), "left").select("b", F.coalesce("label", "a").alias("a")) \
        .join(one, F.col("b") == F.col("end"), "left").select("a", F.coalesce("label", "b").alias("b"))
    final = components(joined).select(F.col("v").alias("label"), F.col("label").alias("last"))

    labelled = classes.select("doc_id", "n", "fp", "text_hash").join(first.withColumnRenamed("v", "fp"), "fp", "left") \
        .withColumn("label", F.coalesce("label", "fp")).join(final, "label", "left").withColumn("label", F.coalesce("last", "label")) \
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).drop("last")
    smallest = labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members")) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return labelled.join(smallest, ["label", "salt"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.coalesce("members", F.lit(1)) > 1).alias("linked"), "text_hash")


def one_of_each(docs: DataFrame, percent: int = 85, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have a smaller id in their component.  A row is named by id and text: where rows
    share an id, each goes or stays by its own text."""
    found = similar_components(docs, percent, words, id_col, text_col)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    text_hash = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(small_or_shuffled(written(gone.distinct(), "gone")),
                     (docs[id_col].cast("long") == F.col("gone_id")) & (text_hash == F.col("gone_hash")), "left_anti")
