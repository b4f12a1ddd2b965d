"""A quality classifier: a linear-chain conditional random field over lines.

Each line is good or bad; its features are counts of its own and of the lines
beside it. Training takes a bounded sample of labelled documents, whose lines
have their document's label. A document's score is the mean of its lines'
marginal probabilities of good, from forward-backward, weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import measures as M
from tracewell.llm import words as W

#: Labelled documents for training, at most; chosen by a hash of the id.
MAX_TRAIN_DOCS, MAX_TRAIN_BYTES = 3_000, 1 << 20
#: Rounds of training and the weight of its penalty.
ROUNDS, PENALTY = 200, 1e-3
THRESHOLD = 0.3
#: The score of a text without a line that has a word.
EMPTY_SCORE = 0.0
#: Own features (columns of ``line_features``) that count for the lines beside too.
BESIDE = [2, 3, 5, 8, 10]
#: The feature that is always 1.
BIAS = 12


@dataclass
class Lines:
    """Lines with a word, of some rows: features, lengths in code points, and the first line of each row."""

    x: np.ndarray
    length: np.ndarray
    first: np.ndarray


def line_features(chunk: W.Chunk) -> Lines:
    start, end, first = M.line_spans(chunk)
    row = np.repeat(np.arange(chunk.rows), np.diff(first))
    word_a, word_b = np.searchsorted(chunk.starts, start), np.searchsorted(chunk.starts, end)
    keep = word_b > word_a
    start, end, row, word_a, word_b = start[keep], end[keep], row[keep], word_a[keep], word_b[keep]
    hashed = W.span_hashes(chunk.data, chunk.starts, chunk.ends)
    letters = M.Counter(chunk, M.CODE_POINTS)
    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    over_words = lambda flags: (t := total(flags))[word_b] - t[word_a]
    n = word_b - word_a
    chars = np.maximum(1, over_words(letters.between(chunk.starts, chunk.ends)))
    length = np.maximum(1, letters.between(start, end))
    later, _ = M.again(W.span_hashes(chunk.data, start, end), row)
    count = lambda table: M.Counter(chunk, table).between(start, end)
    last = chunk.data[chunk.ends[word_b - 1] - 1] if len(n) else np.zeros(0, np.uint8)
    head = chunk.data[chunk.starts[word_a]] if len(n) else np.zeros(0, np.uint8)
    own = np.stack([
        np.log1p(n), chars / n / 10, np.minimum(2, count(M.SYMBOLS) / n), count(M.UPPER) / chars, count(M.DIGITS) / chars, np.minimum(2, count(M.SHOUTS) / n), count(M.POINTS) / n,
        M.POINTS[last], later, over_words(letters.between(chunk.starts, chunk.ends) <= 3) / n, over_words(M.repeated_words(chunk, hashed)) / n, M.UPPER[head], np.ones(len(n)),
    ], axis=1).astype(np.float64)
    beside = own[:, BESIDE]
    same = row[1:] == row[:-1]
    before, after = np.zeros_like(beside), np.zeros_like(beside)
    before[1:][same] = beside[:-1][same]
    after[:-1][same] = beside[1:][same]
    return Lines(np.concatenate([own, before, after], axis=1), length, np.searchsorted(row, np.arange(chunk.rows + 1)))


@dataclass
class Crf:
    """Weights of "good" against "bad", and of the pairs (bad, bad), (bad, good), (good, bad), (good, good)."""

    weight: np.ndarray
    pair: np.ndarray

    def chains(self, u: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log-odds of "good" at each line (its own ``u`` in forward only), all rows side by side."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        begin, size = first[:-1][order], size[order]
        t00, t01, t10, t11 = self.pair
        ahead, behind = u.copy(), np.zeros_like(u)
        for t in range(1, int(size[0]) if len(size) else 0):
            at = begin[: int(np.searchsorted(-size, -t, "left"))] + t
            r = ahead[at - 1]
            ahead[at] = u[at] + np.logaddexp(t01, r + t11) - np.logaddexp(t00, r + t10)
        stop = begin + size - 1
        for t in range(1, int(size[0]) if len(size) else 0):
            at = stop[: int(np.searchsorted(-size, -t, "left"))] - t
            s = behind[at + 1] + u[at + 1]
            behind[at] = np.logaddexp(t10, s + t11) - np.logaddexp(t00, s + t01)
        return ahead, behind, begin, size

    def marginals(self, lines: Lines) -> np.ndarray:
        """P(good) of each line."""
        ahead, behind, _, _ = self.chains(lines.x @ self.weight, lines.first)
        return 1 / (1 + np.exp(-np.clip(ahead + behind, -60, 60)))


def train(lines: Lines, good: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> Crf:
    """Maximum likelihood with a squared penalty, by Adam; ``good`` is each line's label.

    Every document counts alike, however many lines it has, and documents of
    both labels have the same weight together.
    """
    size = np.diff(lines.first)
    if not len(good):
        return Crf(np.zeros(lines.x.shape[1]), np.zeros(4))
    mean, scale = lines.x.mean(axis=0), np.maximum(1e-3, lines.x.std(axis=0))
    mean[BIAS], scale[BIAS] = 0, 1
    x = Lines((lines.x - mean) / scale, lines.length, lines.first)
    each = np.repeat(1 / np.maximum(1, size), size)
    total = np.bincount(good, each, 2)
    each /= np.maximum(1e-9, total)[good] * 2
    inner = np.ones(len(good), bool)
    inner[x.first[:-1][size > 0]] = False
    inner = np.flatnonzero(inner)  # lines with a line before them
    seen = np.bincount(2 * good[inner - 1] + good[inner], each[inner], 4)
    crf = Crf(np.zeros(x.x.shape[1]), np.zeros(4))
    m, v = np.zeros(len(crf.weight) + 4), np.zeros(len(crf.weight) + 4)
    for k in range(1, rounds + 1):
        u = x.x @ crf.weight
        ahead, behind, _, _ = crf.chains(u, x.first)
        p = 1 / (1 + np.exp(-np.clip(ahead + behind, -60, 60)))
        a, b = ahead[inner - 1], (behind + u)[inner]
        joint = np.stack([np.zeros_like(a) + crf.pair[0], b + crf.pair[1], a + crf.pair[2], a + b + crf.pair[3]])
        joint = np.exp(joint - joint.max(axis=0))
        pairs = (joint / joint.sum(axis=0)) @ each[inner]
        slope = np.concatenate([x.x.T @ (each * (good - p)), seen - pairs]) - penalty * np.concatenate([crf.weight, crf.pair])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        crf = Crf(crf.weight + step[:-4], crf.pair + step[-4:])
    weight = crf.weight / scale
    weight[BIAS] -= (weight * mean).sum()
    return Crf(weight, crf.pair)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_DOCS) -> Crf:
    """A field from at most ``most`` labelled documents, none with crc32(doc_id as text) divisible by 5.

    An id with labels of both kinds, a null id and a quality other than 0 and
    1 teach nothing; repeated labels count once. Of rows that repeat an id,
    the one with the smallest text teaches; texts of over MAX_TRAIN_BYTES
    and empty ones don't, so what comes to the driver is bounded. Without
    labels or documents all weights are 0.
    """
    labels = labels.filter("quality in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")
    some = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.octet_length("text") <= MAX_TRAIN_BYTES).join(F.broadcast(some), "doc_id")
    rows = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select(F.xxhash64("doc_id").alias("place"), "doc_id", "text", "quality").toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    parts, good, base, first = [], [], 0, [0]
    for batch in rows.combine_chunks().to_batches():
        quality = np.asarray(batch.column("quality"))
        for chunk in W.scan(batch.column("text")):
            lines = line_features(chunk)
            parts.append(lines)
            good.append(np.repeat(quality[chunk.row : chunk.row + chunk.rows], np.diff(lines.first)))
            first.extend((lines.first[1:] + base).tolist())
            base += int(lines.first[-1])
    if not parts:
        return Crf(np.zeros(13 + 2 * len(BESIDE)), np.zeros(4))
    lines = Lines(np.concatenate([p.x for p in parts]), np.concatenate([p.length for p in parts]), np.array(first))
    return train(lines, np.concatenate(good).astype(np.int64))


def score(docs: DataFrame, crf: Crf, carry: bool = True) -> DataFrame:
    """(row, score, predicted, n_lines) for each row of ``docs`` (doc_id, text and others).

    row is the input row with all its columns, or with ``carry`` false its
    doc_id alone. Texts without a word (null ones too) have EMPTY_SCORE. Rows
    are scored one by one, whole: repeated rows and null ids stay. Without
    labels all weights are 0 and every line counts one half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.scan(batch.column(0)):
                lines = line_features(chunk)
                weight = M.per_group(lines.length, lines.first)
                p = np.concatenate([[0.0], np.cumsum(crf.marginals(lines) * lines.length)])
                total = p[lines.first[1:]] - p[lines.first[:-1]]
                out = np.where(weight > 0, np.clip(total / np.maximum(1, weight), 0, 1), EMPTY_SCORE)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(chunk.row, chunk.rows), pa.array(out), pa.array(np.diff(lines.first), pa.int64())], names=["row", "score", "n_lines"])

    docs = docs.select(F.col("text").cast("string").alias("text"), (F.struct("*") if carry else F.struct("doc_id")).alias("row"))
    out = docs.mapInArrow(run, T.StructType([docs.schema["row"], *T.StructType.fromDDL("score double, n_lines long")]))
    return out.select("row", "score", F.expr(f"int(score >= {THRESHOLD})").alias("predicted"), "n_lines")
