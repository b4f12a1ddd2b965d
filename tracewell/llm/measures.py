"""Counts over texts and over their lines, whole columns at a time."""

from __future__ import annotations

import numpy as np

from tracewell.llm import words as W


def byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[list(chars)] = 1
    return table


SYMBOLS = byte_class(b"#*$%&|<>")
UPPER = byte_class(bytes(range(65, 91)))
DIGITS = byte_class(b"0123456789")
SHOUTS = byte_class(b"!?")
POINTS = byte_class(b".,;:")
#: 1 at the first byte of each code point.
CODE_POINTS = np.array([0 if b & 0xC0 == 0x80 else 1 for b in range(256)], np.int32)


class Counter:
    """Sums of a byte class between positions of a chunk."""

    def __init__(self, chunk: W.Chunk, table: np.ndarray, only: np.ndarray | None = None):
        marks = table[chunk.data]
        self.total = np.zeros(len(marks) + 1, np.int32 if len(marks) < 1 << 31 else np.int64)
        np.cumsum(marks if only is None else marks * only, out=self.total[1:])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.total[b] - self.total[a]


def within_words(chunk: W.Chunk) -> np.ndarray:
    """1 for bytes of words."""
    edge = np.zeros(len(chunk.data) + 1, np.int8)
    edge[chunk.starts] += 1
    edge[chunk.ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8)


def line_spans(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines of each row, and the first line of each row and one past the last."""
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.sort(np.concatenate([chunk.edges[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, chunk.edges[1:]]))
    return starts, ends, np.searchsorted(breaks, chunk.edges) + np.arange(chunk.rows + 1)


def again(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values equal an earlier one of their row, and which occur twice or more in their row."""
    keys = W.mix(keys ^ W.mix(rows.astype(np.uint64), 7))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    later, many = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same[:-1]
    many[order] = same[:-1] | same[1:]
    return later, many


def repeated_words(chunk: W.Chunk, hashed: np.ndarray, n: int = 3) -> np.ndarray:
    """Which words lie in an n-word window that its row has twice or more."""
    good = np.flatnonzero(W.grams_within(chunk.first, n))
    _, many = again(W.gram_hashes(hashed, n)[good], chunk.row_of_word()[good])
    cover = np.zeros(len(hashed) + 1, np.int32)
    hit = good[many]
    cover[hit] += 1
    np.subtract.at(cover, hit + n, 1)
    return np.cumsum(cover[:-1]) > 0


def per_group(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups: group i has flags[first[i]:first[i + 1]]."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
