"""Vectorised text kernels shared by the corpus operators.

Everything here works on whole Arrow string columns with numpy, a few megabytes
at a time, so the cost is a handful of passes over the bytes and never a Python
call per word.

Words are maximal runs of ASCII letters, digits and bytes above 0x7f of the
lower-cased text; every other ASCII byte separates.  ``words()`` is the plain
Python statement of the same rule, used by brute-force tests and by the few
places that need the words themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the temporaries to some 40 times this.
SLICE_BYTES = 1 << 20

_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.empty(0, dtype=np.uint64)
_inverse = np.empty(0, dtype=np.uint64)


def words(text: str) -> list[str]:
    """Lower-cased words of one text, by the rule of this module."""
    return _WORD.findall(pc.utf8_lower(pa.scalar(text)).as_py())


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]).cumprod(dtype=np.uint64)
            _inverse = np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]).cumprod(dtype=np.uint64)
    return _powers, _inverse


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for every span; equal bytes hash equal wherever they stand."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    powers, inverse = _tables(len(codes) + 1)
    total = np.empty(len(codes) + 1, dtype=np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[codes] * powers[: len(codes)], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h)


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[0::2], edge[1::2]


def as_large(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array without nulls (null becomes the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a large_string array, offsets from 0."""
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = 0) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each; a longer text is a range of its own."""
    _, offsets = buffers(column)
    limit = limit or SLICE_BYTES
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def _cut(data: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of a long text that end at separators, so that no word is cut."""
    i, n = 0, len(data)
    while i < n:
        j = min(n, i + SLICE_BYTES)
        if j < n:
            gap = np.flatnonzero(~is_word[data[i:j]])
            while not len(gap) and j < n:  # one word longer than a slice
                j = min(n, j + SLICE_BYTES)
                gap = np.flatnonzero(~is_word[data[i:j]])
            if j < n:
                j = i + int(gap[-1]) + 1
        yield i, j
        i = j


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the n+1 offsets of the texts in them."""
    data, offsets = buffers(pc.utf8_lower(column))
    hashes, counts = [], np.zeros(len(column), dtype=np.int64)
    if len(data) <= 2 * SLICE_BYTES:
        mask = _IS_WORD[data]
        # a boundary between texts separates: handled by splitting spans at offsets
        starts, ends = _split(mask, offsets)
        hashes.append(span_hashes(data, starts, ends))
        counts = np.diff(np.searchsorted(starts, offsets))
    else:
        for row in range(len(column)):
            own = data[offsets[row] : offsets[row + 1]]
            for i, j in _cut(own, _IS_WORD):
                starts, ends = spans(_IS_WORD[own[i:j]])
                hashes.append(span_hashes(own[i:j], starts, ends))
                counts[row] += len(starts)
    out = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
    return out, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _split(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of True, cut where a new text begins."""
    starts, ends = spans(mask)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))] if len(mask) else inner[:0]
    if len(inner):
        inner = np.unique(inner)
        both = inner[mask[inner] & mask[inner - 1]]
        if len(both):
            starts = np.sort(np.concatenate([starts, both]))
            ends = np.sort(np.concatenate([ends, both]))
    return starts, ends


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words inside one text and their offsets.

    A text of fewer words (but at least one) gives one shingle of all of them.
    """
    n = np.diff(offsets)
    short = (n > 0) & (n < width)
    counts = np.where(short, 1, np.maximum(n - width + 1, 0))
    out_at = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(n)), counts)
    first = offsets[:-1][row] + (np.arange(out_at[-1]) - out_at[:-1][row])
    size = np.where(short, n, width)[row] if short.any() else None
    with np.errstate(over="ignore"):
        h = np.zeros(len(first), dtype=np.uint64)
        for k in range(width):
            at = first + k
            if size is None:
                h = (h + hashes[at]) * _BASE
            else:
                use = k < size
                h = np.where(use, (h + hashes[np.minimum(at, max(len(hashes) - 1, 0))]) * _BASE, h)
    return mix(h), out_at


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every row (ragged), and the new offsets. Values are cut to 44 bits."""
    n = len(offsets) - 1
    if n <= 0 or not len(values):
        return values[:0].astype(np.uint64), np.zeros(n + 1, dtype=np.int64)
    if n == 1:
        own = np.unique(values & np.uint64((1 << 44) - 1))
        return own, np.array([0, len(own)], dtype=np.int64)
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets))
    low = np.uint64((1 << 44) - 1)
    if n >= 1 << 20:
        raise ValueError("too many rows in one piece")
    key = (row << np.uint64(44)) | (values & low)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    at = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(44))
    return key & low, at
