"""Repeated 20-word windows, found by super-k-mer partitioning.

Every window of ``width`` words has a minimiser: the smallest hash among its
m-word grams. Consecutive windows with one minimiser travel together, as one
string of words, to the partition of that minimiser; equal windows have equal
minimisers, so each partition can sort its windows and count them exactly.
Hashes only bring equal windows next to each other; their words are compared.

What goes from one chunk of rows to one bucket is a single compressed block.
A window that a task has already met (earlier) is settled there and doesn't
travel, so a passage that very many documents share reaches its partition
once for each task and not once for each document. A first pass counts the
windows of each bucket; those of buckets with very many (where a third of all
documents share a header, the windows across its edge differ, but have one
minimiser) are dealt one by one, by a hash of the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import words as W
from tracewell.llm.store import save

WIDTH, GRAM = 20, 3
#: Bytes of text that a bucket of windows should hold.
BUCKET_BYTES = 12 << 20
#: Bytes of text whose windows for one bucket travel as one block.
CHUNK_BYTES = 2 << 20
#: Windows that a task remembers, to settle later copies at once; beyond that they travel.
MAX_REMEMBERED = 60_000

#: A bucket is hot with so many times the mean number of windows, and at least so many.
HOT_SHARE, HOT_WINDOWS = 8, 1_000_000

BLOCKS = "bucket int, rows int, numbers binary, words binary"
REMOVED = "k long, fp long, start long, n long"


def canonical(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by one space each: bytes, and starts and ends of words."""
    length = chunk.ends - chunk.starts
    ends = np.cumsum(length + 1) - 1
    gap = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, bool)
    gap[ends] = True
    inside = np.zeros(len(chunk.data) + 1, np.int8)
    inside[chunk.starts] += 1
    inside[chunk.ends] -= 1
    out = np.full(len(gap), 0x20, np.uint8)
    out[~gap] = chunk.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)] if len(ends) else 0
    return out, ends - length, ends


def runs_of(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First indexes and lengths of runs of true values; a run also ends before each break."""
    start = mask.copy()
    start[1:] &= ~mask[:-1] | breaks[1:]
    first = np.flatnonzero(start)
    stop = mask.copy()
    stop[:-1] &= ~mask[1:] | breaks[1:]
    return first, np.flatnonzero(stop) + 1 - first


def equal_groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of values that occur twice or more, value by value and in order, and a flag at each value's first."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = sorted_[1:] == sorted_[:-1]
    many = same[:-1] | same[1:]
    return order[many], ~same[:-1][many]


def pack(bucket: int, numbers: np.ndarray, words: list[bytes] | None) -> tuple:
    """A row of BLOCKS: columns k, fp, start, n of runs of windows, and their words."""
    squeeze = zstandard.ZstdCompressor(level=5).compress
    return bucket, numbers.shape[1], squeeze(np.ascontiguousarray(numbers).view(np.uint8).reshape(4, -1, 8).swapaxes(1, 2).tobytes()), None if words is None else squeeze(b"\n".join(words))


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def unpack(rows: int, numbers: bytes) -> np.ndarray:
    """Columns k, fp, start, n of a block; their bytes travel by place, as the upper ones are mostly equal."""
    return np.ascontiguousarray(np.frombuffer(expand(numbers), np.uint8).reshape(4, 8, rows).swapaxes(1, 2)).view(np.int64).reshape(4, rows)


class SuperKmers:
    """Runs of windows of one minimiser, of chunks of rows. Windows of ``hot`` buckets are runs of their own in one of ``extra`` more buckets."""

    def __init__(self, width: int, gram: int, buckets: int, hot: Sequence[int] = (), extra: int = 1):
        self.width, self.gram, self.buckets, self.extra = width, gram, buckets, extra
        self.hot = np.zeros(buckets, bool)
        self.hot[list(hot)] = True
        self.seen: dict[bytes, tuple] = {}

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids, prints = (np.asarray(batch.column(i)) for i in (0, 1))
            for chunk in W.scan(batch.column(2), most=CHUNK_BYTES):
                yield self.one(chunk, ids, prints)

    def one(self, chunk: W.Chunk, ids: np.ndarray, prints: np.ndarray) -> tuple:
        """Columns k, fp, start, n of runs that are settled here; buckets, columns and words (places in the bytes) of the others, by bucket; the bytes."""
        width, seen = self.width, self.seen
        hashed = W.span_hashes(chunk.data, chunk.starts, chunk.ends)
        text, starts, ends = canonical(chunk)
        good = W.grams_within(chunk.first, width)
        size = len(good)
        windows = W.gram_hashes(hashed, width)
        least = W.sliding_min(W.gram_hashes(hashed, self.gram), width - self.gram + 1)
        row = chunk.row_of_word()[:size]
        at = np.arange(size) - chunk.first[row]
        k, fp = ids[chunk.row + row], prints[chunk.row + row]
        raw = text.tobytes()
        gone = np.zeros(size, bool)
        valid = np.flatnonzero(good)
        twice = valid[equal_groups(windows[valid])[0]]
        for i, me in zip(twice.tolist(), zip(k[twice].tolist(), fp[twice].tolist(), at[twice].tolist(), strict=True), strict=True):
            own = raw[starts[i] : ends[i + width - 1]]
            other = seen.get(own)
            if other is not None and other < me:
                gone[i] = True
            elif other is not None or len(seen) < MAX_REMEMBERED:
                seen[own] = me
        new = np.ones(size, bool)
        new[1:] = row[1:] != row[:-1]
        a, n = runs_of(good & gone, new)
        settled = np.stack([k[a], fp[a], at[a], n])
        new[1:] |= least[1:] != least[:-1]
        b, m = runs_of(good & ~gone, new)
        bucket = (W.mix(least[b], 3) % np.uint64(self.buckets)).astype(np.int64)
        hot = self.hot[bucket]
        if hot.any():
            each = np.repeat(b[hot] - (np.cumsum(m[hot]) - m[hot]), m[hot]) + np.arange(m[hot].sum())
            b, m = np.concatenate([b[~hot], each]), np.concatenate([m[~hot], np.ones(len(each), m.dtype)])
            bucket = np.concatenate([bucket[~hot], self.buckets + (W.mix(windows[each], 5) % np.uint64(self.extra)).astype(np.int64)])
        order = np.argsort(bucket, kind="stable")
        b, m, bucket = b[order], m[order], bucket[order]
        return settled, bucket, np.stack([k[b], fp[b], at[b], m]), (starts[b], ends[b + m + width - 2]), raw


def bucket_sizes(width: int, gram: int, buckets: int):
    """mapInArrow from (k, fp, text) to (bucket, n): the windows that travel to each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, bucket, numbers, *_ in SuperKmers(width, gram, buckets).chunks(batches):
            total += np.bincount(bucket, numbers[3], buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    return run


def super_kmers(width: int, gram: int, buckets: int, hot: Sequence[int] = (), extra: int = 1):
    """mapInArrow from (k, fp, text) to BLOCKS: runs of windows to compare (with words) and runs settled here (without)."""

    def blocks(settled: np.ndarray, bucket: np.ndarray, numbers: np.ndarray, places: tuple, raw: bytes) -> Iterator[tuple]:
        if settled.shape[1]:
            yield pack(int(W.mix(settled[0, :1].view(np.uint64))[0] % np.uint64(buckets)), settled, None)
        cuts = list(zip(*(x.tolist() for x in places), strict=True))
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
        for i, j in zip(edge, [*edge[1:], len(bucket)], strict=True):
            yield pack(int(bucket[i]), numbers[:, i:j], [raw[x:y] for x, y in cuts[i:j]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in SuperKmers(width, gram, buckets, hot, extra).chunks(batches):
            rows = list(blocks(*found))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "rows", "numbers", "words"])

    return run


def repeated(width: int):
    """mapInArrow over whole buckets of BLOCKS to REMOVED: the runs of windows with an earlier equal."""

    def removed(numbers: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in numbers], names=["k", "fp", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list] = {}
        for batch in batches:
            for bucket, rows, numbers, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words is None:
                    yield removed(unpack(rows, numbers))
                else:
                    blocks.setdefault(bucket, []).append((rows, numbers, words))
        for bucket in list(blocks):
            yield one(blocks.pop(bucket))

    def one(held: list) -> pa.RecordBatch:
        k, fp, start, n = np.concatenate([unpack(rows, numbers) for rows, numbers, _ in held], axis=1)
        hashes, left, right, texts, base = [], [], [], [], 0
        for _, _, words in held:
            text = expand(words)
            data = np.frombuffer(text, np.uint8)
            line = np.flatnonzero(data == 10)
            edges = pa.array(np.concatenate([[0], line, [len(data)]]).astype(np.int32))
            column = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, edges.buffers()[1], pa.py_buffer(text)])
            for chunk in W.scan(column):
                good = np.flatnonzero(W.grams_within(chunk.first, width))
                hashes.append(W.gram_hashes(W.span_hashes(chunk.data, chunk.starts, chunk.ends), width)[good])
                left.append(chunk.starts[good] + base)
                right.append(chunk.ends[good + width - 1] + base)
                base += len(chunk.data)
            texts.append(text)
        hashes, left, right, text = np.concatenate(hashes), np.concatenate(left), np.concatenate(right), b"".join(texts)
        row = np.repeat(np.arange(len(n)), n)
        at = start[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        twice, _ = equal_groups(hashes)
        twice = twice[np.lexsort((at[twice], fp[row[twice]], k[row[twice]], hashes[twice]))]
        gone, first, group = np.zeros(len(row), bool), {}, None
        mine = zip(k[row[twice]].tolist(), fp[row[twice]].tolist(), at[twice].tolist(), strict=True)
        for i, h, a, b, me in zip(twice.tolist(), hashes[twice].tolist(), left[twice].tolist(), right[twice].tolist(), mine, strict=True):
            if h != group:
                group, first = h, {}
            gone[i] = first.setdefault(text[a:b], me) != me
        new = np.ones(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        a, size = runs_of(gone, new)
        return removed(np.stack([k[row[a]], fp[row[a]], at[a], size]))

    return run


def cut(width: int):
    """mapInArrow from (text, row, starts, sizes) to (row, n_words, n_removed, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, sizes = (batch.column(i) for i in (1, 2, 3))
            for chunk in W.scan(batch.column(0)):
                text, a, b = canonical(chunk)
                raw, kept, removed = text.tobytes(), [], []
                for i in range(chunk.rows):
                    f, g = chunk.first[i], chunk.first[i + 1]
                    cuts = starts[chunk.row + i].as_py()
                    if not cuts:
                        kept.append(raw[a[f] : b[g - 1]] if g > f else b"")
                        removed.append(0)
                        continue
                    gone = np.zeros(g - f + 1, np.int32)
                    np.add.at(gone, cuts, 1)
                    np.add.at(gone, np.add(cuts, sizes[chunk.row + i].as_py()) + width - 1, -1)
                    stay = np.cumsum(gone[:-1]) == 0
                    p, m = runs_of(stay, np.zeros(len(stay), bool))
                    kept.append(b" ".join(raw[a[f + x] : b[f + x + y - 1]] for x, y in zip(p, m, strict=True)))
                    removed.append(int(len(stay) - stay.sum()))
                yield pa.RecordBatch.from_arrays([rows.slice(chunk.row, chunk.rows), pa.array(chunk.counts), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, carry: bool = True) -> DataFrame:
    """(row, n_words, n_removed, kept), one row per row of ``docs`` (doc_id, text and others).

    row is the input row with all its columns, or with ``carry`` false its
    doc_id alone.
    A word is removed where a window of ``width`` words that covers it starts
    earlier as well: in a smaller doc_id, or in the same document before.
    Windows are judged on the input. kept has the other words, joined by one
    space. Null texts have no words; null ids count as later than all others;
    rows that repeat an id with other texts come in the order of a hash of
    the text, and equal rows are one. An empty table gives an empty result.
    """
    row = F.struct("*") if carry else F.struct("doc_id")
    docs = docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("k"), F.col("text").cast("string").alias("text"))
    # Where each id occurs once, no hash of the text is needed to tell rows apart.
    docs = docs.withColumn("fp", F.lit(0).cast("long") if docs.groupBy("k").count().filter("count > 1").isEmpty() else F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * size // BUCKET_BYTES)
    texts = docs.select("k", "fp", "text")
    sizes = save(texts.mapInArrow(bucket_sizes(width, gram, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "sizes")
    mean = (sizes.agg(F.sum("n")).first()[0] or 0) / buckets
    hot = sizes.filter(F.col("n") > max(HOT_WINDOWS, HOT_SHARE * mean)).collect()  # at most one bucket in HOT_SHARE
    extra = max(1, -(-sum(r["n"] for r in hot) // max(HOT_WINDOWS, int(mean))))
    blocks = texts.mapInArrow(super_kmers(width, gram, buckets, [r["bucket"] for r in hot], extra), BLOCKS)
    found = blocks.repartition(max(1, (buckets + (extra if hot else 0)) // 4), "bucket").mapInArrow(repeated(width), REMOVED)
    found = found.groupBy("k", "fp").agg(F.collect_set(F.struct("start", "n")).alias("runs")).select("k", "fp", F.col("runs.start").alias("starts"), F.col("runs.n").alias("sizes"))
    done = docs.join(found, ["k", "fp"], "left").select("text", "row", "starts", "sizes")
    return done.mapInArrow(cut(width), T.StructType([docs.schema["row"], *T.StructType.fromDDL("n_words long, n_removed long, kept string")]))
