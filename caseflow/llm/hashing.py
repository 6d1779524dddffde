"""Word and shingle hashes of many texts at once, on the bytes of an Arrow column.

Words are runs of bytes outside ``space, \\t \\n \\v \\f \\r`` (so UTF-8 safe). A word's
64-bit hash is a polynomial over random byte values, read off running sums, then
mixed; windows of words combine word hashes the same way. Equal words always
have equal hashes; different ones share a hash with odds of about 2^-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 20  # bytes hashed at a time
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _values(fold: bool) -> np.ndarray:
    v = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) << U(1) | U(1)
    if fold:
        v[65:91] = v[97:123]
    return v


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    p = _POWERS.get(base)
    if p is None or len(p) < n:
        size = max(CHUNK + 1, n)
        p = np.full(size, U(base), np.uint64)
        p[0] = 1
        _POWERS[base] = p = np.multiply.accumulate(p)
    return p


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by one blank (null: empty), and where each begins."""
    t = pc.fill_null(texts, "").cast(pa.large_string())
    t = pc.binary_join_element_wise(t, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    offsets = np.frombuffer(t.buffers()[1], np.int64, len(t) + 1, t.offset * 8)
    data = np.frombuffer(t.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, first word of each text plus the number of words)."""
    data, offsets = _joined(texts)
    blank = np.empty(len(data) + 1, bool)
    blank[0] = True
    blank[1:] = _BLANK[data]
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = turn[::2], turn[1::2]
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts in order, first word of each text plus the total).

    ``fold``: A-Z hash like a-z.
    """
    data, starts, ends, first = word_spans(texts)
    values, out, k = _values(fold), np.empty(len(starts), np.uint64), 0
    while k < len(starts):  # a chunk ends with a word, so memory is bounded by CHUNK or one word
        at = starts[k]
        to = max(k + 1, int(np.searchsorted(ends, at + CHUNK, side="right")))
        size = int(ends[to - 1] - at)
        run = np.empty(size + 1, np.uint64)
        run[0] = 0
        np.cumsum(values[data[at:at + size]] * _powers(_BASE, size)[:size], out=run[1:])
        s, e = starts[k:to] - at, ends[k:to] - at
        out[k:to] = (run[e] - run[s]) * _powers(_INVERSE, size + 1)[s]
        k = to
    return mix(out), first


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; windows cross text ends, so callers mask those."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    size = len(words) - n + 1
    h = np.zeros(size, np.uint64)
    for j in range(n):
        h *= U(_BASE)
        h += words[j:j + size]
    return mix(h)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each slice holds at most ``most`` bytes of text, or one row."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(size), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, to - at)
            at = to
