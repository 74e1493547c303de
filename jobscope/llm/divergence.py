"""Source divergence audit: how the sources of a language differ in their words (operator 13).

1. An Arrow compute pipeline in ``mapInArrow`` (``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode`` and hash
   ``group_by``) turns every task's texts into partial counts: occurrences and documents of each (lang, source, term).
   A task merges its partial counts while they are small and hands them on when they are not.
2. Spark deals the partial counts by (lang, term), sums them and keeps the terms of enough documents of the language.
   The kept counts are written once; totals by group and by language come from there.
3. The kept counts are dealt to shards of a language by a hash of the term, so that all sources' counts of a term
   meet.  A shard is an array of sources x terms, worked on a block of terms at a time: it yields a partial sum of
   |p - q| for every pair of sources and its own best terms of every source.  The partial sums are added up, the best
   terms ranked.

All arithmetic is exact: probabilities are scaled to billionths and floored by long division, so that no product
leaves 64 bits.

Edge cases: null text, lang and source count as ''; a text without terms still gives its group; repeated rows and
rows that share an id or have none are documents each; a language without kept terms has pairs of value 0 and no
terms; a language of one source has no pairs; an empty table gives an empty result; long texts are cut between terms
and their pieces counted as one document; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import CHUNK_BYTES, map_batches, ship, text_pieces, written

SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
PRIOR = 5
# Entries of a task's merged counts beyond which they are handed on.
TASK_ENTRIES = 400_000
# Kept (source, term) counts to a shard, on average, and cells of the array that a shard works on at once.
SHARD_ENTRIES = 200_000
BLOCK_CELLS = 1 << 21

PARTIAL_SCHEMA = "lang string, source string, term string, n long, docs long"
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_KEYS = ["lang", "source", "term"]
_IS_SEPARATOR = np.ones(256, bool)
_IS_SEPARATOR[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _term_counts(texts: pa.Array) -> pa.Table:
    """Occurrences of every term in every text: columns row, term, n."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
    flat = pa.table({"row": pc.list_parent_indices(parts), "term": pc.list_flatten(parts).dictionary_encode()})
    flat = flat.combine_chunks()
    codes = pc.cast(flat["term"].chunk(0).indices if flat.num_rows else pa.array([], pa.int32()), pa.int64())
    words = flat["term"].chunk(0).dictionary if flat.num_rows else pa.array([], texts.type)
    found = pa.table({"row": flat["row"], "code": codes}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    out = pa.table({"row": found["row"], "term": pc.take(words, found["code"]), "n": found["count_all"]})
    return out.filter(pc.not_equal(out["term"], ""))


def _cut_between_terms(raw: np.ndarray, limit: int) -> Iterator[bytes]:
    """Pieces of one text of about ``limit`` bytes that begin and end between terms (a longer term is not cut)."""
    cuts = np.flatnonzero(_IS_SEPARATOR[raw])
    lo = 0
    while lo < len(raw):
        at = np.searchsorted(cuts, lo + limit)
        hi = int(cuts[at]) + 1 if at < len(cuts) else len(raw)
        yield raw[lo:hi].tobytes()
        lo = hi


def _add_up(table: pa.Table, keys: list[str], sums: list[str]) -> pa.Table:
    out = table.group_by(keys, use_threads=False).aggregate([(s, "sum") for s in sums])
    return out.select([*keys, *(f"{s}_sum" for s in sums)]).rename_columns([*keys, *sums])


def _partial_counts(limit: int, entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, floor = [], 0, 0
        for piece, data, offsets in text_pieces(batches, limit=limit):
            rows = pa.table({"lang": piece["lang"], "source": piece["source"]})
            if piece.num_rows == 1 and len(data) > limit:
                found = pa.concat_tables(_term_counts(pa.array([x], pa.binary()).cast(pa.string())) for x in _cut_between_terms(data, limit))
                found = _add_up(found, ["row", "term"], ["n"])
            else:
                found = _term_counts(piece["text"])
            of_rows = rows.take(found["row"])
            held.append(_add_up(pa.table({**{k: of_rows[k] for k in ("lang", "source")}, "term": found["term"], "n": found["n"],
                                          "docs": pa.repeat(pa.scalar(1, pa.int64()), found.num_rows)}), _KEYS, ["n", "docs"]))
            # every group appears, with the empty term, whether it has terms or not
            held.append(_add_up(pa.table({"lang": rows["lang"], "source": rows["source"], "term": pa.repeat("", len(rows)),
                                          "n": pa.repeat(pa.scalar(0, pa.int64()), len(rows)),
                                          "docs": pa.repeat(pa.scalar(1, pa.int64()), len(rows))}), _KEYS, ["n", "docs"]))
            size += held[-1].num_rows + held[-2].num_rows
            if size > floor + entries:
                held = [_add_up(pa.concat_tables(held), _KEYS, ["n", "docs"])]
                size = floor = held[0].num_rows
                if size > entries:
                    yield from held[0].cast(_PARTIAL).to_batches(max_chunksize=50_000)
                    held, size, floor = [], 0, 0
        if held:
            yield from _add_up(pa.concat_tables(held), _KEYS, ["n", "docs"]).cast(_PARTIAL).to_batches(max_chunksize=50_000)
    return run


def partial_counts(docs: DataFrame, limit: int = CHUNK_BYTES, entries: int = TASK_ENTRIES) -> DataFrame:
    """Partial counts of (lang, source, term); the empty term carries the documents of a group."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return map_batches(texts, _partial_counts(limit, entries), PARTIAL_SCHEMA)


def kept_counts(docs: DataFrame, min_docs: int = 30, **bounds: int) -> DataFrame:
    """Summed counts of the terms that stand in ``min_docs`` documents of their language, and one row a group ('')."""
    dealt = partial_counts(docs, **bounds).repartition("lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = Window.partitionBy("lang", "term")
    return summed.withColumn("lang_docs", F.sum("docs").over(of_lang)) \
        .where((F.col("term") == "") | (F.col("lang_docs") >= min_docs)).drop("lang_docs")


def scaled(counts: np.ndarray, total: int | np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), three decimal digits at a time."""
    below = np.asarray(total, np.int64) + PRIOR * terms
    whole, rest = np.divmod(np.asarray(counts, np.int64) + PRIOR, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return whole + 1


def _shard(top: int, block_cells: int) -> Callable[[pa.Table], pa.Table]:
    """A shard's partial sums of every pair of sources (item a later source) and its best terms of every source."""
    def run(table: pa.Table) -> pa.Table:
        heads = table.filter(pc.equal(table["term"], "")).sort_by("source")
        rows = table.filter(pc.not_equal(table["term"], ""))
        lang, n_terms, lang_total = heads["lang"][0].as_py(), heads["lang_terms"][0].as_py(), heads["lang_total"][0].as_py()
        names, totals = heads["source"].to_pylist(), heads["n"].to_numpy()
        of_source = pc.index_in(rows["source"], value_set=heads["source"].combine_chunks()).to_numpy()
        encoded = rows["term"].combine_chunks().dictionary_encode()
        terms = encoded.dictionary.to_numpy(zero_copy_only=False)
        codes, counts = encoded.indices.to_numpy(), rows["n"].to_numpy()
        order = np.argsort(codes, kind="stable")
        of_source, codes, counts = of_source[order], codes[order], counts[order]
        width = max(1, block_cells // max(len(names), 1))
        pair_sums = np.zeros((len(names), len(names)), np.int64)
        best: list[list[tuple[int, bytes, str]]] = [[] for _ in names]
        for lo in range(0, len(terms), width):
            hi = min(lo + width, len(terms))
            a, b = np.searchsorted(codes, [lo, hi])
            block = np.zeros((len(names), hi - lo), np.int64)
            block[of_source[a:b], codes[a:b] - lo] = counts[a:b]
            p = scaled(block, totals[:, None], n_terms)
            q = scaled(block.sum(axis=0), lang_total, n_terms)
            for i in range(len(names) - 1):
                pair_sums[i, i + 1:] += np.abs(p[i + 1:] - p[i]).sum(axis=1)
            for i in range(len(names)):
                over = np.where(block[i] > 0, p[i] - q, 0)
                at = np.flatnonzero(over > 0)
                if len(at) > top:
                    least = np.partition(over[at], len(at) - top)[len(at) - top]
                    at = at[over[at] >= least]
                found = best[i] + [(-int(over[j]), terms[lo + j].encode(), terms[lo + j]) for j in at]
                best[i] = sorted(found)[:top]
        i, j = np.triu_indices(len(names), 1)
        out = [(names[x], "pair", names[y], v) for x, y, v in zip(i, j, pair_sums[i, j].tolist())] + \
              [(names[x], "term", term, -value) for x, found in enumerate(best) for value, _, term in found]
        source, part, item, value = zip(*out) if out else ((), (), (), ())
        return pa.table({"lang": pa.repeat(lang, len(out)), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()),
                         "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})
    return run


def divergences(docs: DataFrame, min_docs: int = 30, top: int = 50, shard_entries: int = SHARD_ENTRIES,
                block_cells: int = BLOCK_CELLS, **bounds: int) -> DataFrame:
    """lang, source, part, item, value, rank: every group's distance from the language's other sources (``pair``) and
    its ``top`` terms that are more frequent than in the whole language (``term``)."""
    ship(docs.sparkSession)
    kept = written(kept_counts(docs, min_docs, **bounds), "divergence")
    term_rows = kept.where(F.col("term") != "")
    by_term = term_rows.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.count("*").alias("entries"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = by_term.groupBy("lang").agg(F.count("*").alias("lang_terms"), F.sum("n").alias("lang_total"), F.sum("entries").alias("entries"))
    shards = langs.withColumn("shards", F.ceil(F.col("entries") / shard_entries).cast("int"))
    heads = groups.join(shards, "lang") \
        .select("lang", "source", F.lit("").alias("term"), "n", "lang_terms", "lang_total", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    dealt = term_rows.join(shards.select("lang", "shards"), "lang") \
        .select("lang", "source", "term", "n", F.lit(None).cast("long").alias("lang_terms"), F.lit(None).cast("long").alias("lang_total"),
                F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    # dealt by shard: a partitioning by language alone, as the join may leave it, would put a language into one task
    found = heads.unionByName(dealt).repartition("lang", "shard").groupBy("lang", "shard") \
        .applyInArrow(_shard(top, block_cells), "lang string, source string, part string, item string, value long")
    found = written(found, "divergence-shards")
    # every ordered pair of a language's sources, with value 0 where the language keeps no terms
    halves = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = halves.unionByName(halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item") \
        .join(sums, ["lang", "source", "item"], "left") \
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return pairs.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(ranked)) \
        .where((F.col("part") == "pair") | (F.col("rank") <= top))
