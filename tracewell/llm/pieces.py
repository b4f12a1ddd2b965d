"""SentencePiece encoding and decoding by streaming Viterbi.

The ids of a text are the path of pieces with the largest sum of the model's
own scores. Scores are held for a window of the longest piece only, and
whenever all paths that survive pass one boundary, what lies before it is
committed. The vocabulary has no piece with a word mark after another
character, so each run of word marks starts at such a boundary: what lies
between two of them is a unit. The distinct units of a chunk of rows are
encoded side by side, one position of all of them at a time; a long unit is
streamed by itself, each position visited once. Characters without a piece
become byte pieces.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words as W

MARK = "▁"
#: Bytes of text whose equal units are encoded once.
CHUNK_BYTES = 1 << 20
#: Units of more bytes are streamed; shorter ones are encoded side by side.
LANE = 128
#: Bytes of a streamed unit whose pieces are looked up at once.
STEP = 1 << 14
#: Bytes of a character by its first byte; 0 inside one.
_WIDTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, np.int64)


class Model:
    """Pieces of a SentencePiece model file as a tree over their bytes, a word mark being a space."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        spell, score = [b""] * (size + 1), np.zeros(size)
        self.byte_id = np.zeros(256, np.int32)
        plain = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                spell[i] = bytes([int(piece[1:-1], 16)])
                self.byte_id[spell[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                spell[i], score[i] = piece.replace(MARK, " ").encode(), model.get_score(i)
                plain[spell[i]] = i
        self.words_apart = not any(b" " in p.lstrip(b" ") or (p.startswith(b"  ") and p.strip(b" ")) for p in plain)
        real = score[score > -1e6]
        self.byte_score = float(real.min()) - 10
        self.score = score
        self.longest = max(4, *map(len, plain))
        inner = {p[:k] for p in plain for k in range(len(p))}
        node = {p: n for n, p in enumerate([*sorted(inner, key=len), *(p for p in plain if p not in inner)])}
        self.next = np.zeros((len(inner), 256), np.uint16 if len(node) < 1 << 16 else np.int32)
        for p, n in node.items():
            if p:
                self.next[node[p[:-1]], p[-1]] = n
        self.piece = np.array([plain.get(p, -1) for p in node], np.int32)
        self.spell = np.frombuffer(b"".join(spell), np.uint8)
        self.spell_size = np.array([len(x) for x in spell])
        self.spell_at = np.cumsum(self.spell_size) - self.spell_size

    def matches(self, data: np.ndarray, room: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: positions and ids (-1: as bytes) of the pieces in ``data``; one at i is no longer than room[i]."""
        found = {}
        at = np.flatnonzero(room > 0)
        state = np.zeros(len(at), np.int64)
        alone = np.zeros(len(data), bool)
        width = _WIDTH[data]
        for n in range(1, self.longest + 1):
            fits = room[at] >= n
            at = at[fits]
            state = self.next[state[fits], data[at + n - 1]]
            known = state > 0
            at, state = at[known], state[known]
            ids = self.piece[state]
            own = ids >= 0
            found[n] = at[own], ids[own]
            if n <= 4:
                alone[at[own & (width[at] == n)]] = True
            more = state < len(self.next)
            at, state = at[more], state[more]
        for n in range(1, 5):
            raw = np.flatnonzero((width == n) & ~alone & (room >= n))
            found[n] = np.concatenate([found[n][0], raw]), np.concatenate([found[n][1], np.full(len(raw), -1, np.int32)])
        return found

    def scores(self, ids: np.ndarray, n: int) -> np.ndarray:
        return np.where(ids >= 0, self.score[ids], n * self.byte_score)

    def lanes(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short units that lie one after another in ``data``, and each one's number of ids.

        Of equal paths, the one whose last differing piece is longest.
        """
        start = np.cumsum(size) - size
        lane = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(data)) - start[lane]
        best = np.full(len(data) + len(size), -np.inf)  # a unit has one boundary more than bytes
        best[start + np.arange(len(size))] = 0
        step, chosen = np.zeros(len(best), np.int64), np.zeros(len(best), np.int32)
        ends = []
        for n, (at, ids) in self.matches(data, size[lane] - inside).items():
            order = np.argsort((inside[at] + n).astype(np.uint16), kind="stable")
            at, ids = at[order], ids[order]
            edge = np.searchsorted(inside[at] + n, np.arange(LANE + 2))
            ends.append((n, at + lane[at], ids, self.scores(ids, n), edge))
        for end in range(1, int(size.max(initial=0)) + 1):
            for n, at, ids, score, edge in reversed(ends):  # the longest first: others must exceed it
                s = slice(edge[end], edge[end + 1])
                if s.start < s.stop:
                    own, to = best[at[s]] + score[s], at[s] + n
                    better = own > best[to]
                    to = to[better]
                    best[to], step[to], chosen[to] = own[better], n, ids[s][better]
        out, first = np.zeros(len(data), np.int32), np.zeros(len(data), bool)
        which = np.arange(len(size))
        at, stop = start + size + which, start + which
        while len(at):
            n, ids = step[at], chosen[at]
            at = at - n
            byte = at - which
            first[byte], out[byte] = True, ids
            raw = ids < 0
            for k in range(4):
                b = byte[raw & (n > k)] + k
                first[b], out[b] = True, self.byte_id[data[b]]
            open_ = at > stop
            at, stop, which = at[open_], stop[open_], which[open_]
        return out[first], np.bincount(lane[first], minlength=len(size))

    def stream(self, data: np.ndarray) -> array:
        """Ids of one unit of any length, the same path as in ``lanes``.

        ``best`` holds the scores of the open window. Each boundary knows the
        boundaries reached from it; one that leads nowhere is dropped, and
        while the root has one successor, the piece between is committed.
        """
        out = array("i")
        best, back, after = {0: 0.0}, {0: (-1, 0)}, {0: set()}
        root, n = 0, len(data)
        for a in range(0, n, STEP):
            part = data[a : a + STEP + self.longest]
            found = self.matches(part, len(part) - np.arange(len(part)))
            at = np.concatenate([x for x, _ in found.values()])
            length = np.repeat(list(found), [len(x) for x, _ in found.values()])
            ids = np.concatenate([x for _, x in found.values()])
            own = np.flatnonzero(at < STEP)
            own = own[np.lexsort((length[own], at[own]))]
            at, length, ids = at[own] + a, length[own], ids[own]
            edges = zip(at.tolist(), length.tolist(), ids.tolist(), self.scores(ids, length).tolist(), strict=True)
            i = -1
            for now, size, piece, score in [*edges, (-2, 0, 0, 0.0)]:
                if now != i:
                    if i in after and not after[i] and i < n:  # no better path goes on from here
                        self._drop(i, back, after)
                    while root <= i and len(after[root]) == 1:
                        (to,) = after.pop(root)
                        self._emit(out, data, root, to, back[to][1])
                        del back[root]
                        root = to
                    i = now
                    mine = best.pop(i, None)
                if mine is None:
                    continue
                to, score = i + size, mine + score
                if score > best.get(to, float("-inf")):
                    if to in back:
                        before = back[to][0]
                        after[before].discard(to)
                        if before < i and not after[before]:
                            self._drop(before, back, after)
                    best[to], back[to] = score, (i, piece)
                    after.setdefault(to, set())
                    after[i].add(to)
        return out

    @staticmethod
    def _drop(i: int, back: dict, after: dict) -> None:
        """Forgets a boundary that no path goes on from, and those that led to it alone."""
        while i >= 0 and not after[i]:
            before = back.pop(i)[0]
            del after[i]
            if before < 0:
                return
            after[before].discard(i)
            i = before

    def _emit(self, out: array, data: np.ndarray, a: int, b: int, piece: int) -> None:
        if piece >= 0:
            out.append(piece)
        else:
            out.extend(self.byte_id[data[a:b]].tolist())

    def units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after another and each one's number of ids; equal units are encoded once."""
        _, first, same = np.unique(W.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        a, size = starts[first], (ends - starts)[first]
        short = np.flatnonzero(size <= LANE)
        at = np.arange(size[short].sum()) + np.repeat(a[short] - (np.cumsum(size[short]) - size[short]), size[short])
        ids, n = self.lanes(data[at], size[short])
        count = np.zeros(len(first), np.int64)
        count[short] = n
        long_ = np.flatnonzero(size > LANE)
        streamed = [np.array(self.stream(data[x : x + m]), np.int32) for x, m in zip(a[long_], size[long_], strict=True)]
        count[long_] = [len(x) for x in streamed]
        begin = np.zeros(len(first), np.int64)
        begin[short] = np.cumsum(n) - n
        begin[long_] = len(ids) + np.cumsum(count[long_]) - count[long_]
        ids = np.concatenate([ids, *streamed])
        each = count[same]
        total = np.cumsum(each)
        return ids[np.repeat(begin[same] - (total - each), each) + np.arange(total[-1] if len(total) else 0)], each

    def encode(self, chunk_data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of bytes and each row's number of ids. A space is put before a row, as the model expects; empty rows have none."""
        if not self.words_apart:
            raise ValueError("pieces of this model cross words")
        full = np.diff(edges) > 0
        row = edges[:-1][full] + np.arange(full.sum())
        data = np.full(int(edges[-1]) + len(row), 0x20, np.uint8)
        text = np.ones(len(data), bool)
        text[row] = False
        data[text] = chunk_data
        space = data == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[row] = True
        starts = np.flatnonzero(start)
        ids, each = self.units(data, starts, np.append(starts[1:], len(data)))
        total = np.concatenate([[0], np.cumsum(each)])
        count = np.zeros(len(full), np.int64)
        count[full] = np.diff(total[np.append(np.searchsorted(starts, row), len(starts))])
        return ids, count

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each row of ids, without the space put before it; unknown ids are empty."""
        ids = np.where((ids >= 0) & (ids < len(self.spell_size) - 1), ids, len(self.spell_size) - 1)
        size = self.spell_size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.spell[np.repeat(self.spell_at[ids] - total[:-1], size) + np.arange(total[-1])]
        edges = total[np.concatenate([[0], np.cumsum(counts)])]
        lead = edges[:-1][edges[1:] > edges[:-1]]
        lead = lead[data[lead] == 0x20]
        edges = edges - np.searchsorted(lead, edges)
        data = np.delete(data, lead).tobytes()
        raw = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(data)])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no text
            return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.string())


@cache
def model_at(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, ids array<int>) for each row of ``docs`` (doc_id, text).

    Null and empty texts have no ids. Rows are independent: repeated rows and
    null ids stay as they are, and an empty table gives an empty result.
    ``path`` is a file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in batches:
            edges, data = W.buffers(batch.column(1))
            for i, j in W.pieces(edges, CHUNK_BYTES):
                ids, count = model.encode(data[edges[i] : edges[j]], edges[i : j + 1] - edges[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), W.lists(ids, count)], names=["doc_id", "text", "ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, text, ids) with ids_crc32 (little-endian 32-bit ids) and the decoded text; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in batches:
            column = batch.column(2)
            count = np.array(column.value_lengths().fill_null(0), np.int64)
            ids = np.asarray(column.flatten().fill_null(-1)).astype(np.int32)
            raw, edges = ids.tobytes(), 4 * np.concatenate([[0], np.cumsum(count)])
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            for i, j in W.pieces(edges):
                text = model.decode(ids[edges[i] // 4 : edges[j] // 4], count[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(count[i:j]), pa.array(crc[i:j], pa.int64()), text], names=["doc_id", "text", "n_ids", "ids_crc32", "decoded"])

    return encoded.select("doc_id", "text", "ids").mapInArrow(run, "doc_id long, text string, n_ids long, ids_crc32 long, decoded string")
