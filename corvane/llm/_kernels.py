"""Vectorised byte kernels shared by the operators: numpy over Arrow string buffers.

Texts are handled as UTF-8 bytes end to end.  A *chunk* is a run of whole documents of about
``CHUNK`` bytes (one longer document makes a chunk of its own), so memory follows the chunk and
not the Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19

#: The white space of the word contract, and A-Z to a-z.
_WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(_WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1, _MIX2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_SEQ = U(0x9FB21C651E98DF25)
_ABSENT = U(0x1B873593CC9E2D51)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h *= _MIX1
    h ^= h >> U(33)
    h *= _MIX2
    h ^= h >> U(33)
    return h


_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, CHUNK + (1 << 16))
        row = np.full(size, base, U)
        row[0] = 1
        have = np.multiply.accumulate(row)
        if size <= 4 * CHUNK:
            _powers[kind] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Runs [i, j) of documents of at most ``limit`` bytes together, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and one past the last) of the words in ``data``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = IS_SPACE[data]
    word = ~gap
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    before[-1], before[:-1] = True, gap[1:]
    ends = np.flatnonzero(word & (before | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]], from one running sum for all spans."""
    if not len(starts):
        return np.zeros(0, U)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power("base", _BASE, len(data)), out=total[1:])
    value = (total[ends] - total[starts]) * _power("inverse", _BASE_INV, len(data))[starts]
    return mix(value + (ends - starts).astype(U) * _SEQ)


def shingle_hashes(word: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each document (fewer words: the whole sequence as one),
    repeats included, and where each document's hashes begin."""
    n = np.diff(first)
    each = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    out = np.concatenate([[0], np.cumsum(each)])
    at = np.repeat(first[:-1] - out[:-1], each) + np.arange(out[-1])
    last = np.repeat(first[1:], each)
    h = np.zeros(len(at), U)
    for k in range(width):
        i = at + k
        there = i < last
        h = (h ^ np.where(there, word[np.where(there, i, 0)] if len(word) else U(0), _ABSENT)) * _SEQ
        h ^= h >> U(29)
    return mix(h), out


def document_shingles(data: np.ndarray, offsets: np.ndarray, width: int):
    """Yields (document number, sorted distinct shingle hashes) over lower-cased whole texts."""
    for i, j in chunks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        part, rel = LOWER[data[lo:hi]], offsets[i : j + 1] - lo
        starts, ends, first = words(part, rel)
        hashes, at = shingle_hashes(span_hashes(part, starts, ends), first, width)
        for k in range(j - i):
            one = hashes[at[k] : at[k + 1]]
            yield i + k, np.unique(one) if len(one) else one
