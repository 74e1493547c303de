"""BPE encoding and decoding with a contiguous rank array (operator 7).

A word starts as its single byte symbols.  Beside the parts stands one contiguous array with the rank of every
adjacent pair (and the merged symbol, in the low bits of the same number); the smallest rank is found by scanning it,
that boundary is deleted and only the two neighbouring ranks are refreshed.  Words are short, so scanning a small array beats any heap; words above ``SCAN_LIMIT`` symbols
(where rescanning would cost the square of their length) take the same merges in the same order from a heap.

The vocabulary file is read on the driver, at a path that is a parameter, and broadcast as the tables that the codec
looks up, which tasks use as they are: their size is fixed by the vocabulary, never by the documents.

Edge cases: null and empty texts have no tokens and decode to the empty text; repeated rows are encoded each for
itself; an empty table gives an empty result; only the id and text columns are read, so further columns never clash.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import id_text, map_batches, row_slices

NO_MERGE = 1 << 62
# Symbols up to which a word is merged by scanning the rank array.
SCAN_LIMIT = 256
# Entries of either generation of a task's word cache: a full one replaces the older (results don't depend on it).
CACHE_WORDS = 60_000
CACHED_CHARS = 48
# Control characters that str.split() takes for white space and the tokenizer doesn't.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")

SCHEMA = "doc_id long, ids binary, decoded string"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(shifted)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What the codec needs of a ``tokenizers`` BPE file with an end-of-word suffix."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    alphabet, bits = byte_alphabet(), max(vocab.values()).bit_length()
    # left id and right id -> rank and merged id, each two in one number
    pairs = {vocab[a] << bits | vocab[b]: rank << bits | vocab[a + b] for rank, (a, b) in enumerate(merges)}
    return {"bits": bits, "pairs": pairs, "inner": [vocab[c] for c in alphabet], "final": [vocab[c + suffix] for c in alphabet],
            "tokens": {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}, "pattern": splits[0], "added": added}


class BpeCodec:
    """Encodes texts to ids and ids to text, as the vocabulary's own tokenizer does without special tokens."""

    def __init__(self, spec: dict):
        self.bits, self.pairs, self.tokens = spec["bits"], spec["pairs"], spec["tokens"]
        self.inner, self.final, self.added = spec["inner"], spec["final"], spec["added"]
        self.piece = regex.compile(spec["pattern"])
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") \
            if self.added else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]]
        return self._scan(parts) if len(parts) <= SCAN_LIMIT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        get, bits, mask = self.pairs.get, self.bits, (1 << self.bits) - 1
        found = [get(a << bits | b, NO_MERGE) for a, b in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best == NO_MERGE:
                break
            at = found.index(best)
            parts[at] = best & mask
            del parts[at + 1], found[at]
            if at:
                found[at - 1] = get(parts[at - 1] << bits | parts[at], NO_MERGE)
            if at < len(found):
                found[at] = get(parts[at] << bits | parts[at + 1], NO_MERGE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        get, bits, mask, n = self.pairs.get, self.bits, (1 << self.bits) - 1, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(hit, i, pair) for i, pair in enumerate(a << bits | b for a, b in zip(parts, parts[1:])) if (hit := get(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            best, i, pair = heapq.heappop(queue)
            j = right[i]
            if parts[i] < 0 or j < 0 or parts[i] << bits | parts[j] != pair:
                continue
            parts[i], parts[j] = best & mask, -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (hit := get(pair := parts[a] << bits | parts[b])) is not None:
                    heapq.heappush(queue, (hit, a, pair))
        return [p for p in parts if p >= 0]

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= CACHED_CHARS:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.young.get(piece)
        if ids is None:
            ids = self._keep(piece, self.old.get(piece) or np.array(self.merge(piece.encode()), dtype="<u4").tobytes())
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if ids := self.old.get(chunk):
            return self._keep(chunk, ids)
        pieces = self.piece.findall(chunk)
        if len(pieces) == 1:
            return self._piece(pieces[0])
        return self._keep(chunk, b"".join(map(self._piece, pieces)))

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form at word ends
        text = text.lower()
        if _NOT_SPACE.search(text):
            return b"".join(map(self._piece, self.piece.findall(text)))
        new, out, known = self._chunk, [], self.young
        for chunk in text.split():  # no piece of the pattern spans white space
            ids = known.get(chunk)
            if ids is None:
                ids, known = new(chunk), self.young
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or "<|" not in text and not self.cut.search(text):
            return self._plain(text)
        return b"".join(np.array([self.added[part]], "<u4").tobytes() if part in self.added else self._plain(part)
                        for part in self.cut.split(text) if part)

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with one space between them (the vocabulary names no decoder)."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def bpe_encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit integers) ``, decoded`` for every row of ``docs``.

    Map-only: no shuffle, and a lost executor's partitions are simply encoded again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec(shared.value)  # gone with its word caches when the task ends
        for rows in row_slices(batches, 1):
            ids = [codec.encode(t) for t in rows.column(1).to_pylist()]
            yield pa.record_batch([rows.column(0), pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.string())],
                                  names=["doc_id", "ids", "decoded"])

    return map_batches(id_text(docs, id_col, text_col), encode, SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    """Token count and SHA-256 of ids and decoded text."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
