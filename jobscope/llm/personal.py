"""Personal data: patterns, and a conditional random field that finds what they miss (operator 11).

The patterns (``base_spans``) find e-mail addresses, IP addresses, card and phone numbers, leftmost and non-overlapping
for each kind; a match that fails its check is dropped without a second try, and so are numbers that a neighbour has
been drawn into, and written forms that no pattern knows.

The field (``jobscope.llm.crf``) is trained from a small labelled table of texts with spans.  ``labelled_windows``
derives such a table from a bounded sample of the documents: the patterns label windows around their spans, each once as
it stands and once in another written form (``other_forms``), and windows without spans teach what is none.  Spans that
the field finds anywhere are added if they overlap no pattern's span and pass the check of their kind (``passes``).

Sample bounds (documented parameters): ``SAMPLE_DOCS`` documents on average, chosen by a hash of their id, and
``WINDOWS`` windows of them.  Finding covers every document and its whole text, map-only.

Edge cases: null and empty texts have no spans; a corpus without any span gives a field that finds none; repeated rows
and rows that share an id are searched each for itself; an empty table gives an empty result; long runs of digits or
address letters take linear time; a long text is tokenised in slices that end at blanks; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm import crf
from jobscope.llm.common import CHUNK_BYTES, id_text, map_batches, text_pieces, written

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 4_000
WINDOWS = 1_200
# Characters of context to both sides of a labelled span.
CONTEXT = 60

Span = tuple[str, int, int]

# The patterns of the kinds, written so that no run of characters is scanned twice: a run that fails from its first
# character fails from all of them.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        twice = int(d) * (1 + i % 2)
        total += twice - 9 * (twice > 9)
    return total % 10 == 0


def _in_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind as listed, then start (code points, end exclusive)."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_in_byte, m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NO_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def passes(kind: str, found: str) -> bool:
    """Whether a span of the field can be of its kind."""
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", found)
    if kind == "phone":
        return 8 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", found)) and not found.isdigit()
    if kind == "ip":
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(map(_in_byte, parts)) and not re.search("[A-Za-z]", found)
    return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[A-Za-z0-9-]+)+", found))


def other_forms(kind: str, found: str) -> list[str]:
    """The same datum in forms that the patterns don't know."""
    digits = re.sub("[^0-9]", "", found)
    if kind == "email":
        return [found.replace("@", " [at] "), found.replace("@", " (at) ")]
    if kind == "card":
        return [".".join(digits[i:i + 4] for i in range(0, len(digits), 4)), " - ".join(digits[i:i + 4] for i in range(0, len(digits), 4))]
    if kind == "phone" and len(digits) >= 10:
        local = digits[-10:]
        return [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}"]
    return []


# ---- the labelled table

LABELLED_SCHEMA = "text string, spans array<struct<kind:string,start:long,stop:long>>, dice long"


def _windows(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of_text(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
        for kind, a, b in spans:
            lo, hi = max(0, a - CONTEXT), min(len(text), b + CONTEXT)
            inside = [(k, x - lo, y - lo) for k, x, y in spans if lo <= x and y <= hi]
            yield text[lo:hi], inside
            if len(inside) == 1:
                for form in other_forms(kind, text[a:b]):
                    yield text[lo:a] + form + text[b:hi], [(kind, a - lo, a - lo + len(form))]
        # a plain window, from where the hash of the text says
        if text:
            lo = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "big") % len(text)
            if not any(a < lo + 2 * CONTEXT and lo < b for _, a, b in spans):
                yield text[lo:lo + 2 * CONTEXT], []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                # kinds may overlap (a card number within an address): the longer one is learned
                spans: list[Span] = []
                for s in sorted(base_spans(text), key=lambda s: s[1] - s[2]):
                    if all(s[2] <= a or b <= s[1] for _, a, b in spans):
                        spans.append(s)
                for window, inside in of_text(text, sorted(spans, key=lambda s: s[1])):
                    dice = int.from_bytes(hashlib.blake2b(f"{seed}:{window}".encode(), digest_size=8).digest(), "big", signed=True)
                    rows.append({"text": window, "spans": [{"kind": k, "start": a, "stop": b} for k, a, b in inside], "dice": dice})
            spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("text", pa.string()), ("spans", spans_type), ("dice", pa.int64())]))
    return run


def labelled_windows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, windows: int = WINDOWS, seed: int = 2024,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A labelled table of ``windows`` windows at most: text and its spans; a third of them without any."""
    texts = id_text(docs, id_col, text_col)
    share = min(1.0, sample_docs / max(docs.count(), 1))
    chosen = texts.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("text")
    found = written(map_batches(chosen, _windows(seed), LABELLED_SCHEMA).dropDuplicates(["text"]), "personal-windows")
    by_kind = F.coalesce(F.get("spans", F.lit(0))["kind"], F.lit(""))
    parts = [found.where(by_kind == kind).orderBy("dice").limit(windows // 6 if kind else windows // 3) for kind in (*KINDS, "")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("text", "spans")


def _sequence(text: str, spans: list, kinds: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and label numbers of a labelled text."""
    raw = text.encode()
    starts, _, shape = crf.tokens(np.frombuffer(raw, np.uint8))
    labels = np.zeros(len(starts), np.int64)
    for kind, a, b in spans:
        lo, hi = len(text[:a].encode()), len(text[:b].encode())
        inside = np.flatnonzero((starts >= lo) & (starts < hi))
        if kind in kinds and len(inside):
            labels[inside] = 2 + 2 * kinds.index(kind)
            labels[inside[0]] -= 1
    return shape, labels


def fit_field(labelled: DataFrame, kinds: tuple[str, ...] = KINDS, **settings: float) -> crf.Crf:
    """The field of a small labelled table (text, spans of kind, start, stop in code points); it is fitted on the driver."""
    rows = sorted(((r.text or "", [(s.kind, s.start, s.stop) for s in r.spans or []]) for r in labelled.select("text", "spans").collect()))
    return crf.fit([_sequence(text, spans, kinds) for text, spans in rows], kinds, **settings)


# ---- finding

def _tokens(data: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a piece of texts; a longer text in slices that end at a blank (a longer run without blanks is one)."""
    if len(data) <= limit or len(offsets) > 2:
        return crf.tokens(data, offsets[1:-1])
    blanks = np.flatnonzero(crf.is_blank(data))
    parts, lo = [], 0
    while lo < len(data):
        at = np.searchsorted(blanks, lo + limit)
        hi = int(blanks[at]) + 1 if at < len(blanks) else len(data)
        starts, stops, shape = crf.tokens(data[lo:hi])
        parts.append((starts + lo, stops + lo, shape))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*parts))


def field_spans(data: np.ndarray, offsets: np.ndarray, field: crf.Crf, limit: int = CHUNK_BYTES) -> dict[int, list[Span]]:
    """Spans that the field finds in a piece of texts: text number -> spans in code points, by start."""
    starts, stops, shape = _tokens(data, offsets, limit)
    of_text = np.searchsorted(offsets, starts, side="right") - 1
    place = np.arange(len(shape)) + 2 * of_text  # two tokens of distance between texts
    laid = np.full(len(shape) + 2 * len(offsets), crf.BESIDE)
    laid[place] = shape
    token_at = np.zeros(len(laid), np.int64)
    token_at[place] = np.arange(len(shape))
    out: dict[int, list[Span]] = {}
    before = (-1, 0, 0)  # text, byte and code point up to which has been counted
    for kind, a, b in crf.label_spans(field.decode(laid), field.kinds):
        a, b = int(token_at[a]), int(token_at[b - 1])
        row = int(of_text[a])
        if row != before[0]:
            before = (row, int(offsets[row]), 0)
        ends = []
        for x in (int(starts[a]), int(stops[b])):
            before = (row, x, before[2] + len(data[before[1]:x].tobytes().decode()))
            ends.append(before[2])
        out.setdefault(row, []).append((kind, ends[0], ends[1]))
    return out


def with_field(text: str, base: list[Span], found: list[Span]) -> list[Span]:
    """The patterns' spans, and the field's that overlap none of them and pass their check, by kind, then start."""
    covered = sorted((a, b) for _, a, b in base)
    extra, i, reach = [], 0, 0
    for kind, a, b in found:
        while i < len(covered) and covered[i][0] < b:
            reach = max(reach, covered[i][1])
            i += 1
        if reach <= a and passes(kind, text[a:b]):
            extra.append((kind, a, b))
    return sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1])) if extra else base


SPANS_SCHEMA = ("doc_id long, base array<struct<kind:string,start:long,stop:long>>, "
                "spans array<struct<kind:string,start:long,stop:long>>")
_SPAN_LIST = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
_SPANS = pa.schema([("doc_id", pa.int64()), ("base", _SPAN_LIST), ("spans", _SPAN_LIST)])


def personal_spans(docs: DataFrame, field: crf.Crf, id_col: str = "doc_id", text_col: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, the patterns' spans, and all spans of every document (code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, offsets in text_pieces(batches, limit=limit):
            found = field_spans(data, offsets, shared.value, limit)
            texts = piece["text"].to_pylist()
            base = [base_spans(t) for t in texts]
            spans = [with_field(t, b, found[i]) if i in found else b for i, (t, b) in enumerate(zip(texts, base))]
            yield pa.record_batch([piece["doc_id"], *(pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in row] for row in rows], _SPAN_LIST)
                                                      for rows in (base, spans))], schema=_SPANS)

    return map_batches(id_text(docs, id_col, text_col), run, SPANS_SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind and the spans as text: kind:start:end, comma-joined."""
    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
