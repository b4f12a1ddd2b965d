"""Compression of vectors to part codes, learned over integer components.

Components become integers. For each dimension, the distinct integers of a
batch are its dictionary, and the squared differences of every distinct
integer to the entries of the codebook are tabulated once; the distances of a
part are then gathers from these tables by dictionary code, added over the
part's dimensions. Learning adds up sums and counts of each entry in every
task, and Spark adds these; vectors never travel, and the driver holds the
codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.store import save

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers below this are handled as 64-bit numbers: squares over 512 dimensions stay below 2 ** 63. Larger ones take Python's integers.
SMALL = 2**26
#: Sums of integers of any size travel as limbs of this many bits.
LIMB = 40
TOP = 2**63 - 1
#: Rows whose tables are made together.
ROWS = 2048
#: Distinct labels up to this number are broadcast.
MAX_BROADCAST_ROWS = 1_000_000
SUMS = "slot int, at int, limb int, amount long"
CODED = "vec_id long, label string, code string, error long"


@dataclass
class Codebooks:
    """Entries by number: ``entries`` has a row of all dimensions each, ``edges`` where the parts begin and end."""

    entries: np.ndarray
    edges: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
        flat = (str(x) for a, b in zip(self.edges, self.edges[1:], strict=False) for row in self.entries[:, a:b] for x in row)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def part_edges(width: int, parts: int) -> np.ndarray:
    """Equal parts; where ``width`` isn't a multiple, their lengths differ by one at most."""
    return np.arange(parts + 1) * width // parts


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact; Python integers where one is large."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel()], object).reshape(scaled.shape)


def alike(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit numbers, or both as Python integers."""
    return (values, entries) if values.dtype == entries.dtype else (values.astype(object), entries.astype(object))


def assign(values: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every part of every row of ``values``, ties to the lower, and its squared distance."""
    values, entries = alike(values, books.entries)
    parts = len(books.edges) - 1
    codes, errors = np.zeros((len(values), parts), np.int64), np.zeros((len(values), parts), values.dtype)
    for p in range(parts):
        total = np.zeros((len(values), len(entries)), values.dtype)
        for d in range(books.edges[p], books.edges[p + 1]):
            distinct, code = np.unique(values[:, d], return_inverse=True)
            squares = (distinct[:, None] - entries[None, :, d]) ** 2
            if values.dtype != object and squares.max(initial=0) < 2**31 // max(1, int(books.edges[p + 1] - books.edges[p])):
                squares, total = squares.astype(np.int32), total.astype(np.int32, copy=False)
            else:
                total = total.astype(values.dtype, copy=False)
            total = total + squares[code]
        codes[:, p] = total.argmin(axis=1)
        errors[:, p] = total[np.arange(len(values)), codes[:, p]]
    return codes, errors


def clean(batch: pa.RecordBatch, width: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Which rows are kept, and their components: of ``batch``'s last column, lists without null or non-finite ones.

    All kept rows have ``width`` components, or, where that is None, any number but none; the result is then flat.
    """
    column = batch.column(batch.num_columns - 1)
    sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()
    fine = np.isfinite(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64))
    row = np.repeat(np.arange(len(sizes)), sizes)
    kept = (sizes > 0) & (np.bincount(row[~fine], minlength=len(sizes)) == 0) & (np.ones(len(sizes), bool) if width is None else sizes == width)
    return kept, flat.to_numpy(zero_copy_only=False)[kept[row]] if len(row) else np.zeros(0), sizes


def blocks(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Kept rows of at most ROWS at once, with their integers."""
    for batch in rows:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            kept, flat, _ = clean(part, width)
            if kept.any():
                yield part.filter(pa.array(kept)), whole(flat.reshape(-1, width))


def limbs(amounts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers as limbs of LIMB bits that add up to them, each with the number's sign; small numbers have one."""
    sign, rest, k = np.where(amounts < 0, -1, 1), np.abs(amounts), 0
    while k == 0 or (rest != 0).any():
        yield k, (sign * (rest % 2**LIMB)).astype(np.int64)
        rest, k = rest // 2**LIMB, k + 1


def add_up(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow to SUMS: a task's sum of each component over the parts of each entry; at = -1 has their number."""
    width, parts, n = books.entries.shape[1], len(books.edges) - 1, len(books.entries)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(n * parts, np.int64), np.zeros((n, width), np.int64)
        for _, values in blocks(rows, width):
            codes, _ = assign(values, books)
            values, total = alike(values, total)
            for p in range(parts):
                count += np.bincount(codes[:, p] + p * n, minlength=n * parts)
                np.add.at(total[:, books.edges[p] : books.edges[p + 1]], codes[:, p], values[:, books.edges[p] : books.edges[p + 1]])
        if count.any():
            part_of = np.searchsorted(books.edges, np.arange(width), "right") - 1
            slot, at = (part_of[None, :] * n + np.arange(n)[:, None]).ravel(), np.tile(np.arange(width), n)
            out = [(np.arange(n * parts), np.full(n * parts, -1), np.zeros(n * parts, np.int64), count)]
            out += [(slot, at, np.full(slot.size, k), limb) for k, limb in limbs(total.ravel())]
            slot, at, limb, amount = (np.concatenate(x) for x in zip(*out, strict=True))
            some = amount != 0
            yield pa.RecordBatch.from_arrays([pa.array(x[some], t) for x, t in ((slot, pa.int32()), (at, pa.int32()), (limb, pa.int32()), (amount, pa.int64()))], names=["slot", "at", "limb", "amount"])

    return run


def first_books(vectors: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The codebooks that the kept vectors with the smallest ids give, ties by components; None if none is kept."""
    fine = F.size("embedding") > 0
    fine &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    first = kept.orderBy("vec_id", "embedding").select("vec_id", "embedding").limit(1).collect()
    if not first:
        return None
    width = len(first[0]["embedding"])
    rows = kept.filter(F.size("embedding") == width).orderBy("vec_id", "embedding").select("embedding").limit(entries).collect()
    return Codebooks(whole(np.array([r["embedding"] for r in rows])), part_edges(width, parts))


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all of ``vectors`` (vec_id, embedding last).

    The driver gets a number for each component of each entry and limb a
    round, however many vectors there are.
    """
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if books else 0):
        n, width = books.entries.shape
        sums = vectors.mapInArrow(add_up(books), SUMS).groupBy("slot", "at", "limb").agg(F.sum("amount").alias("amount")).collect()
        count, total = np.zeros((parts, n), object), np.zeros((n, width), object)
        for slot, at, limb, amount in sums:
            if at < 0:
                count[slot // n, slot % n] = amount
            else:
                total[slot % n, at] += amount << (LIMB * limb)
        now = books.entries.astype(object)
        for p in range(parts):
            used = np.flatnonzero(count[p] > 0)
            now[used, books.edges[p] : books.edges[p + 1]] = total[used, books.edges[p] : books.edges[p + 1]] // count[p][used][:, None]
        books = Codebooks(now.astype(np.int64) if np.abs(now).max(initial=0) < SMALL else now, books.edges)
    return books


def encode(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow from (vec_id, label, embedding) to CODED."""
    hexes = np.array([f"{x:02x}" for x in range(max(256, len(books.entries)))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in blocks(rows, books.entries.shape[1]):
            codes, errors = assign(values, books)
            code = pa.array(["".join(x) for x in hexes[codes].tolist()], pa.string())
            error = pa.array([min(int(x), TOP) for x in errors.sum(axis=1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, error], names=["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), one row per kept row of ``vectors`` (vec_id, embedding, label).

    Rows whose vector is null, empty, or holds a null or non-finite component
    are dropped, and so are rows whose vector has another length than that
    of the smallest kept id (null ids are never used for that or for the first
    codebooks; without any other id nothing can be learned and the result is
    empty). Rows with the same id count and are coded each; among them the
    smaller components come first. With fewer kept rows than ``entries``, the
    codebooks have that many. Lengths that are no multiple of ``parts`` give
    parts that differ by one. Errors over 2**63 - 1 are given as that number.
    Null labels are one label. An empty table gives an empty result.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    books = learn(vectors, parts, entries, rounds)
    if books is None:
        return vectors.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = save(vectors.mapInArrow(encode(books), CODED), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(TOP).cast("decimal(38,0)")).cast("long")
    labels = save(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "labels")
    few = labels.count() <= MAX_BROADCAST_ROWS
    out = coded.join(F.broadcast(labels) if few else labels, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
