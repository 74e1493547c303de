"""Word and shingle hashes of many texts at once, by whole-array arithmetic over their bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240517)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_RNG.integers(1, 2**62)) * 4 + 1  # odd, so that it has an inverse modulo 2^64
_UNSTEP = pow(_STEP, -1, 2**64)
_ORDER = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2^64 for i below n, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    filled = 1
    while filled < n:
        take = min(filled, n - filled)
        out[filled:filled + take] = out[:take] * np.uint64(pow(base, filled, 2**64))
        filled += take
    return out


_TABLES: dict[str, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _TABLES.get(str(base))
    if have is None or len(have) < n:
        have = _TABLES[str(base)] = _powers(base, max(n, 1 << 20))
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums of scrambled bytes times powers: the hash of data[a:b] is (h[b] - h[a]) * unstep ** a."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_STEP, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, equal for equal bytes wherever they stand."""
    return (prefix[stops] - prefix[starts]) * powers(_UNSTEP, len(prefix))[starts]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word (run without ASCII white space), and where each text's words begin (n + 1)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    blank = _IS_BLANK[data]
    before, behind = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], behind[:-1] = blank[:-1], blank[1:]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = True
    behind[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(~blank & before)
    stops = np.flatnonzero(~blank & behind) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every text's shingles of ``size`` words, and where each text's begin (n + 1).

    A text with fewer words, but some, has its whole sequence as one shingle.
    """
    starts, stops, first = words_of(data, offsets)
    h = mix(span_hash(prefix_hash(data), starts, stops) + (stops - starts).astype(np.uint64))
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_first = np.concatenate([[0], np.cumsum(counts)])
    # shingle j of a text begins at its word j
    begin = np.repeat(first[:-1], counts) + np.arange(out_first[-1]) - np.repeat(out_first[:-1], counts)
    width = np.repeat(np.minimum(n, size), counts)
    total = width.astype(np.uint64)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    for k in range(size):
        total += np.where(k < width, padded[begin + k] * _ORDER[k], np.uint64(0))
    return mix(total), out_first
