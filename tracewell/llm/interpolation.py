"""Language-model scores by deleted interpolation.

A word's probability mixes the maximum-likelihood estimates of its bigram and
its unigram with a uniform share; the weights depend on how often the context
was seen (buckets of powers of two) and are learned by expectation
maximisation on counts of training documents that were held out of the
estimates. Each round of it is one aggregate in Spark over those counts; the
driver gets a sum for each bucket.

Counts are exchanged in packed form: a batch of documents sends each distinct
gram's hash once, with its number, to the partition of that hash, and gets the
corpus counts back in the same order. Every row of the exchange is one block
of numbers for one batch and one hash partition, so nothing is hot and no
vocabulary goes through the driver or a broadcast.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words as W
from tracewell.llm.store import save

#: Roles of documents: in the estimates; for the weights; scored only.
MAIN, DEV, HELD = 0, 1, 2
#: Tokens of a batch, about.
BATCH_TOKENS = 500_000
#: Hash partitions: one for so many bytes of text.
PARTITION_TEXT = 8 << 20
#: Rounds of EM, at most; it ends when no weight moves by more than this.
ROUNDS, STILL = 30, 5e-4
#: Buckets of context counts: 0, and one for each power of two.
BUCKETS = 65
END, START = np.uint64(0x1D8AF07C5E3B9642), np.uint64(0x7A60E1C94F25D38B)

BATCHES = "batch long, role int, doc_ids array<long>, sizes array<int>, vocabulary binary, codes binary"
BLOCKS = "part int, batch long, kind int, grams binary"
COUNTS = "batch long, role int, kind int, part int, counts binary, words long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
CELLS = "bucket int, bi double, uni double, n long"


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def expand(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def squeeze_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit values by their differences, byte by byte: the upper bytes are mostly 0."""
    return squeeze(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def expand_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(expand(data, np.uint8).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def batches_of(docs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, role, text) to BATCHES, each of one role; a token is a code of the batch's own vocabulary."""
    open_: dict[int, list] = {MAIN: [], DEV: [], HELD: []}
    number = TaskContext.get().partitionId() << 32

    def close(role: int) -> pa.RecordBatch:
        nonlocal number
        ids, sizes, tokens = (np.concatenate(x) for x in zip(*open_[role], strict=True))
        open_[role] = []
        vocabulary, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small codes
        code = np.empty(len(order), np.uint32)
        code[order] = np.arange(len(order), dtype=np.uint32)
        number += 1
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([role], pa.int32()), W.lists(ids, np.array([len(ids)])), W.lists(sizes.astype(np.int32), np.array([len(sizes)])), pa.array([vocabulary[order].tobytes()], pa.binary()), pa.array([squeeze(code[inverse])], pa.binary())], names=["batch", "role", "doc_ids", "sizes", "vocabulary", "codes"])

    for batch in docs:
        ids, roles = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for chunk in W.scan(batch.column(2), lower=True):
            hashed = W.span_hashes(chunk.data, chunk.starts, chunk.ends)
            tokens = np.insert(hashed, chunk.first[1:], END)
            sizes = chunk.counts + 1
            own = roles[chunk.row : chunk.row + chunk.rows]
            of_token = np.repeat(own, sizes)
            for role in open_:
                if (own == role).any():
                    open_[role].append((ids[chunk.row : chunk.row + chunk.rows][own == role], sizes[own == role], tokens[of_token == role]))
                    if sum(len(x[2]) for x in open_[role]) >= BATCH_TOKENS:
                        yield close(role)
    for role in open_:
        if open_[role]:
            yield close(role)


class Tokens:
    """One batch: tokens as codes, and its distinct bigrams."""

    def __init__(self, sizes: np.ndarray, vocabulary: bytes, codes: bytes):
        self.vocabulary = np.frombuffer(vocabulary, np.uint64)
        self.codes = expand(codes, np.uint32)
        first = np.cumsum(sizes) - sizes
        before = np.empty(len(self.codes), np.uint64)
        before[1:] = self.codes[:-1] + np.uint64(1)
        before[first] = 0  # the start of a document
        self.context = before.astype(np.int64) - 1
        self.pairs, self.pair = np.unique(before << np.uint64(32) | self.codes, return_inverse=True)

    def unigrams(self) -> np.ndarray:
        """Hashes of the words, and of the start as a context."""
        return np.append(self.vocabulary, START)

    def bigrams(self) -> np.ndarray:
        words = np.concatenate([[START], self.vocabulary])
        left, right = self.pairs >> np.uint64(32), self.pairs & np.uint64(2**32 - 1)
        return W.mix(words[left.astype(np.int64)] * np.uint64(0xD6E8FEB86659FD93) + self.vocabulary[right.astype(np.int64)], 2)

    def numbers(self, kind: int) -> np.ndarray:
        """How often each gram of a kind occurs in the batch."""
        if kind == 2:
            return np.bincount(self.pair, minlength=len(self.pairs))
        return np.append(np.bincount(self.codes, minlength=len(self.vocabulary)), (self.context < 0).sum())

    def grams(self, kind: int) -> np.ndarray:
        return self.bigrams() if kind == 2 else self.unigrams()


def order_of(grams: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams in ascending order, dealt to partitions by ranges: their order, and where each partition begins in it."""
    order = np.argsort(grams)
    part = ((grams[order] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return order, np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def send(parts: int):
    """BATCHES to BLOCKS: the grams of each batch, with their numbers in training documents."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                tokens = Tokens(np.array(row["sizes"]), row["vocabulary"], row["codes"])
                for kind in (1, 2):
                    grams, numbers = tokens.grams(kind), tokens.numbers(kind).astype(np.uint32)
                    order, edge = order_of(grams, parts)
                    out = []
                    for p, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
                        if b > a:
                            own = squeeze_sorted(grams[order[a:b]])
                            out.append((p, row["batch"], kind, struct.pack("<III", row["role"], b - a, len(own)) + own + squeeze(numbers[order[a:b]])))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["part", "batch", "kind", "grams"])

    return run


def add_up(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BLOCKS of whole partitions to COUNTS in the order of the grams sent: [main, all training]; words is the number of a partition's words in training, once."""
    held: dict[tuple[int, int], list] = {}
    for batch in rows:
        for part, own, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault((part, kind), []).append((own, data))
    for part, kind in list(held):
        blocks = [(own, *struct.unpack_from("<III", data), data) for own, data in held.pop((part, kind))]
        grams, inverse = np.unique(np.concatenate([expand_sorted(data[12 : 12 + size], n) for _, _, n, size, data in blocks]), return_inverse=True)
        numbers = np.concatenate([expand(data[12 + size :], np.uint32) for *_, size, data in blocks])
        lengths = [b[2] for b in blocks]
        role = np.repeat([b[1] for b in blocks], lengths)
        main = np.bincount(inverse, numbers * (role == MAIN), len(grams)).astype(np.uint64)
        both = np.bincount(inverse, numbers * (role != HELD), len(grams)).astype(np.uint64)
        words = [int((both[grams != START] > 0).sum()) if kind == 1 else 0] + [0] * (len(blocks) - 1)
        out = [(b[0], b[1], kind, part, squeeze(np.stack([main[inverse[e - n : e]], both[inverse[e - n : e]]])), w) for b, n, e, w in zip(blocks, lengths, np.cumsum(lengths), words, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()))], names=["batch", "role", "kind", "part", "counts", "words"])


def counted(row: dict, parts: int) -> tuple[Tokens, dict[int, np.ndarray]]:
    """A batch with the corpus counts of its grams, by kind: rows main and all training."""
    tokens, found = Tokens(np.array(row["sizes"]), row["vocabulary"], row["codes"]), {}
    for kind in (1, 2):
        grams = tokens.grams(kind)
        order, edge = order_of(grams, parts)
        found[kind] = np.zeros((2, len(grams)), np.int64)
        for block in row["blocks"]:
            if block["kind"] == kind:
                a, b = edge[block["part"]], edge[block["part"] + 1]
                found[kind][:, order[a:b]] = expand(block["counts"], np.uint64).reshape(2, -1)
    return tokens, found


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the binary logarithm of their number."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def estimates(tokens: Tokens, found: dict[int, np.ndarray], which: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: the bucket of its context, and the bigram's and unigram's estimates."""
    uni, bi = found[1][which], found[2][which]
    context = uni[np.where(tokens.context < 0, len(tokens.vocabulary), tokens.context)]
    return bucket_of(context), bi[tokens.pair] / np.maximum(context, 1), uni[tokens.codes] / max(total, 1)


def cells(parts: int, total: int):
    """mapInArrow over held-out batches: how often each (bucket, estimates) occurs in each."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                bucket, bi, uni = estimates(*counted(row, parts), 0, total)
                order = np.lexsort((uni, bi, bucket))
                bucket, bi, uni = bucket[order], bi[order], uni[order]
                at = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (bi[1:] != bi[:-1]) | (uni[1:] != uni[:-1])]))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array(bi[at]), pa.array(uni[at]), pa.array(np.diff(np.append(at, len(order))))], names=["bucket", "bi", "uni", "n"])

    return run


def learn_weights(cell: DataFrame, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """EM over all of ``cell`` (CELLS): a row (bigram, unigram, uniform) for each bucket.

    A bucket without held-out tokens has the weights of the one below.
    """
    weights = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    seen: set[int] = set()
    for _ in range(rounds):
        now = cell.sparkSession.createDataFrame([(b, *map(float, w)) for b, w in enumerate(weights)], "bucket int, a double, b double, c double")
        share = cell.join(F.broadcast(now), "bucket").select("bucket", "n", F.expr("a * bi").alias("x"), F.expr("b * uni").alias("y"), F.expr(f"c * {uniform!r}D").alias("z"))
        sums = share.groupBy("bucket").agg(*(F.sum(F.expr(f"n * {k} / (x + y + z)")).alias(k) for k in "xyz"), F.sum("n").alias("n")).collect()
        moved = 0.0
        for r in sums:
            old, own = weights[r["bucket"]].copy(), np.maximum(np.array([r["x"], r["y"], r["z"]]) / r["n"], [0.0, 1e-6, 1e-6])
            weights[r["bucket"]] = own / own.sum()
            moved = max(moved, float(np.abs(weights[r["bucket"]] - old).max()))
        seen |= {r["bucket"] for r in sums}
        if moved <= STILL:
            break
    for b in range(2, BUCKETS):
        if b not in seen:
            weights[b] = weights[b - 1]
    return weights


def score(docs: DataFrame) -> DataFrame:
    """SCORES, one row per row of ``docs`` (doc_id, text).

    Words are lower-cased (A-Z); each text ends with one end token. Documents
    whose crc32(doc_id as text) leaves 1 by 5 are scored only; of the others,
    those that leave 2 teach the weights before they join the counts. base_score
    is the smoothed unigram's, score the mixture's, both log10 of the whole
    text. Null texts are empty; null ids are training documents; repeated rows
    count and are scored each. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    role = F.expr(f"case coalesce(crc32(cast(doc_id as string)) % 5, 0) when 1 then {HELD} when 2 then {DEV} else {MAIN} end")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, size // PARTITION_TEXT)
    docs = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), role.cast("int").alias("role"), "text")
    table = save(docs.mapInArrow(batches_of, BATCHES), "batches")
    blocks = save(table.mapInArrow(send(parts), BLOCKS).repartition(parts, "part").mapInArrow(add_up, COUNTS), "counts")

    sums = table.groupBy("role").agg(F.sum(F.expr("aggregate(sizes, 0L, (s, x) -> s + x)")).alias("n"), F.count("*").alias("batches")).collect()
    total, batches = {r["role"]: r["n"] for r in sums}, {r["role"]: r["batches"] for r in sums}
    main, train = total.get(MAIN, 0), total.get(MAIN, 0) + total.get(DEV, 0)
    distinct = blocks.agg(F.sum("words")).first()[0] or 0
    uniform = 1 / (distinct + 1)

    def with_counts(own: DataFrame, counts: DataFrame, n: int) -> DataFrame:
        """Each batch with its counts; about one batch a task."""
        back = counts.select("batch", "kind", "part", "counts").repartition(max(1, n), "batch").groupBy("batch").agg(F.collect_list(F.struct("kind", "part", "counts")).alias("blocks"))
        return own.repartition(max(1, n), "batch").join(back, "batch").select(*table.columns, "blocks")

    dev = F.col("role") == DEV
    cell = save(with_counts(table.filter(dev), blocks.filter(dev), batches.get(DEV, 0)).mapInArrow(cells(parts, main), CELLS), "cells")
    weights = learn_weights(cell, uniform)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                tokens, counts = counted(row, parts)
                bucket, bi, uni = estimates(tokens, counts, 1, train)
                w = weights[bucket]
                mixed = np.log10(w[:, 0] * bi + w[:, 1] * uni + w[:, 2] * uniform)
                seen = counts[1][1][tokens.codes]
                base = np.log10((seen + 0.5) / (train + 0.5 * (distinct + 1)))
                first = np.cumsum(row["sizes"]) - row["sizes"]
                ids = [None if x == -(2**63) else x for x in row["doc_ids"]]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([row["role"] == HELD] * n), pa.array(row["sizes"], pa.int64()), pa.array(np.add.reduceat(seen > 0, first, dtype=np.int64)), pa.array([train] * n, pa.int64()), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(mixed, first))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_counts(table, blocks, sum(batches.values())).mapInArrow(run, SCORES)
