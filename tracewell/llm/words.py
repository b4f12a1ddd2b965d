"""Words, word hashes and n-grams of whole columns of texts, with numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; in UTF-8
this is the pattern ``[^\\x20\\x09-\\x0D]+``. Texts are scanned in chunks of
rows, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
HASH_BLOCK = 1 << 17
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (int(salt) + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * HASH_BLOCK)
        one = np.ones(size, np.uint64)
        one[1:] = np.uint64(_BASE)
        _powers = np.multiply.accumulate(one)
        one[1:] = np.uint64(pow(_BASE, -1, 2**64))
        _inverses = np.multiply.accumulate(one)
    return _powers, _inverses


@dataclass
class Chunk:
    """Some rows of a text column and their words."""

    row: int  # the first row
    data: np.ndarray  # the rows' bytes, one after another
    edges: np.ndarray  # row i has bytes edges[i]:edges[i + 1]
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    first: np.ndarray  # row i has words first[i]:first[i + 1]

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind, width = np.int64, 8
    else:
        kind, width = np.int32, 4
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, kind, len(column) + 1, column.offset * width).astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return edges, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def pieces(edges: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each, one row at least."""
    i, rows = 0, len(edges) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + most, "right")) - 1)
        j = min(j, rows)
        yield i, j
        i = j


def scan(column: pa.Array, lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    edges, data = buffers(column)
    for i, j in pieces(edges, most):
        part, own = data[edges[i] : edges[j]], edges[i : j + 1] - edges[i]
        if lower:
            part = _LOWER[part]
        word = ~_WHITE[part]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        inner = own[(own < len(part))]
        begin[inner] = word[inner]
        inner = own[own > 0] - 1
        end[inner] = word[inner]
        starts = np.flatnonzero(begin)
        yield Chunk(i, part, own, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, own))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges in ascending order, by prefix sums of a polynomial.

    A hash depends on the range's bytes alone, so the sums are taken over
    blocks of ranges, which keeps them small; a long range is summed block by
    block.
    """
    out, i = np.empty(len(starts), np.uint64), 0
    powers, _ = _tables(HASH_BLOCK)
    while i < len(starts):
        if ends[i] - starts[i] > HASH_BLOCK:
            total = 0
            for a in range(int(starts[i]), int(ends[i]), HASH_BLOCK):
                part = data[a : min(a + HASH_BLOCK, int(ends[i]))]
                total += pow(_BASE, a - int(starts[i]), 2**64) * int((_VALUES[part] * powers[: len(part)]).sum())
            out[i] = total % 2**64
            i += 1
            continue
        long_ = np.flatnonzero(ends[i : i + HASH_BLOCK] - starts[i : i + HASH_BLOCK] > HASH_BLOCK)
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + HASH_BLOCK)))
        j = min(j, i + int(long_[0])) if len(long_) else j
        at, part = starts[i], data[starts[i] : ends[i:j].max()]
        powers, inverses = _tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * powers[: len(part)], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - at] - sums[starts[i:j] - at]) * inverses[starts[i:j] - at]
        i = j
    return mix(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, at every start; those over a row's end too."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + size]
    return mix(out, n)


def grams_within(first: np.ndarray, n: int) -> np.ndarray:
    """Which starts have n words of their own row before them."""
    size = max(0, int(first[-1]) - n + 1)
    ends = np.repeat(first[1:], np.diff(first))[:size]
    return np.arange(size) + n <= ends


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the number of values of each row."""
    edges = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=edges[1:])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values))


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 ... (sizes[0] of them), first[1] ..."""
    upto = np.cumsum(sizes)
    return np.repeat(first - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    size, have = len(x) - w + 1, 1
    if size <= 0:
        return x[:0]
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:size], x[w - have : w - have + size])
