"""Line dedup by pairwise alignment.

Overlapping documents are found through the lines they share: a rare line (in
up to ``rare_df`` documents) pairs each of its documents with all earlier
ones. A block of frequent lines is found by its runs of consecutive lines:
each pairs its documents with the first that holds the whole run. So pairs
grow with the lines and not with the square of a group. Each pair is aligned
by patience diff on line hashes, and aligned common blocks are deleted from the
later document. A diff keeps to one order, so each stretch of lines that it
leaves is aligned with the earlier document again, until an alignment proposes
no block: moved and repeated blocks go that way. One rule holds for texts of
any length. Only alignments delete; runs of frequent lines do nothing but find
pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import measures as M
from tracewell.llm import words as W
from tracewell.llm.store import save

#: A line in up to so many documents is rare.
RARE_DF = 8
#: An aligned block with fewer words than this stays.
MIN_BLOCK_WORDS = 8
#: Keys held by more rows than this are joined by a broadcast of at most MAX_HOT_KEYS rows, others by a shuffle.
HOT_DF, MAX_HOT_KEYS = 1000, 500_000
#: An ordinary diff holds tiles of up to so many bits (50 MB); what it finds doesn't depend on that.
MAX_BITS = 400_000_000
#: Deleted lines are broadcast up to about so many bytes; more are joined by a shuffle.
MAX_BROADCAST_BYTES = 32 << 20
LINES = "k long, fp long, line array<long>, size array<int>"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, fp, text) to LINES: a hash and a number of words for each line. Hashes ignore outer white space."""
    for batch in batches:
        for chunk in W.scan(batch.column(2)):
            start, end, first = M.line_spans(chunk)
            a, b = np.searchsorted(chunk.starts, start), np.searchsorted(chunk.starts, end)
            full = b > a
            hashes = np.zeros(len(start), np.uint64)
            hashes[full] = W.span_hashes(chunk.data, chunk.starts[a[full]], chunk.ends[b[full] - 1])
            own = (slice(chunk.row, chunk.row + chunk.rows),)
            counts = np.diff(first)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(0))[own]), pa.array(np.asarray(batch.column(1))[own]), W.lists(W.signed(hashes), counts), W.lists((b - a).astype(np.int32), counts)], names=["k", "fp", "line", "size"])


def shortest_runs(line: np.ndarray, size: np.ndarray, inside: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First lines, ends and hashes of runs of consecutive lines that are all ``inside``.

    The shortest run from each line, and the shortest to each line, with
    ``min_words``. Each line of a block of so many words is in a run that lies
    in the block, and equal blocks have equal runs.
    """
    n, w = len(line), max(1, min_words)
    words = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    power, back = (x[:n] for x in W._tables(n))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(line.view(np.uint64) * power, dtype=np.uint64)])
    edges = np.concatenate([[-1], np.flatnonzero(~inside), [n]])
    at = np.flatnonzero(inside)
    place = np.searchsorted(edges, at)
    begin, stop = edges[place - 1] + 1, edges[place]
    end = np.searchsorted(words, words[at] + w)
    start = np.searchsorted(words, words[at + 1] - w, "right") - 1
    ahead, behind = end <= stop, (words[at + 1] >= w) & (start >= begin)
    a, b = np.concatenate([at[ahead], start[behind]]), np.concatenate([end[ahead], at[behind] + 1])
    return a, b, W.mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64), 3)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (i, j), given in order of i, in which j increases (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        if pile == len(tops):
            tops.append(j)
            at.append(n)
        else:
            tops[pile], at[pile] = j, n
        back[n] = at[pile - 1] if pile else -1
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _tile(at: dict[int, int], width: int, a: list[int], row: int, left: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The table of longest common subsequences of the lines ``a`` and of ``width`` lines that are in ``at`` (line to bits of places).

    After each line of ``a``, bit j of its row is 0 where the subsequence is
    longer than with one line less of the others; ``row`` is the row above. A
    carry, at the ``left`` and returned for the right, is 1 where the line of
    ``a`` makes it longer.
    """
    every, rows, right = (1 << width) - 1, [], bytearray()
    for x, carry in zip(a, left.tolist(), strict=True):
        up = row & at.get(x, 0)
        if up or carry:
            total = row + up + carry
            row, carry = (total | (row - up)) & every, total >> width
        rows.append(row)
        right.append(carry)
    return rows, np.frombuffer(right, np.uint8)


def _places(b: list[int]) -> dict[int, int]:
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    return at


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) of a longest common subsequence, an ordinary diff, at any length.

    The table is made in tiles of at most MAX_BITS; of the others only the
    borders are held, and the tiles that the way back crosses are made again.
    So the way back, and the pairs, don't depend on MAX_BITS. The work grows
    with the product of the lengths.
    """
    in_a, in_b = set(a), set(b)
    rows, columns = [i for i, x in enumerate(a) if x in in_b], [j for j, x in enumerate(b) if x in in_a]
    a, b = [a[i] for i in rows], [b[j] for j in columns]
    side = isqrt(MAX_BITS)
    above: dict[tuple[int, int], int] = {}
    left: dict[tuple[int, int], np.ndarray] = {}
    tiles = [(i, j) for j in range(0, len(b), side) for i in range(0, len(a), side)]
    for i, j in tiles:
        if i == 0:
            at, width = _places(b[j : j + side]), len(b[j : j + side])
            above[i, j] = (1 << width) - 1
        if j == 0:
            left[i, j] = np.packbits(np.zeros(len(a[i : i + side]), np.uint8))
        if (i, j) != tiles[-1]:
            part = a[i : i + side]
            made, right = _tile(at, width, part, above[i, j], np.unpackbits(left[i, j], count=len(part)))
            above[i + side, j], left[i, j + side] = made[-1], np.packbits(right)
    out: list[tuple[int, int]] = []
    x, y = len(a), len(b)
    while x and y:
        i, j = (x - 1) // side * side, (y - 1) // side * side
        made, _ = _tile(_places(b[j:y]), y - j, a[i:x], above[i, j] & (1 << y - j) - 1, np.unpackbits(left[i, j], count=x - i))
        while x > i and y > j:
            if a[x - 1] == b[y - 1]:
                x, y = x - 1, y - 1
                out.append((rows[x], columns[y]))
            elif made[x - 1 - i] >> (y - 1 - j) & 1:
                y -= 1
            else:
                x -= 1
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned pairs (i, j) of equal lines: equal ends first, then unique common lines, then the gaps between those.

    A gap without unique common lines is aligned by an ordinary diff.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i == p or j == q:
            continue
        in_a, in_b = Counter(a[i:p]), Counter(b[j:q])
        where = {x: n for n, x in enumerate(b[j:q], j) if in_b[x] == 1}
        anchors = increasing([(n, where[x]) for n, x in enumerate(a[i:p], i) if in_a[x] == 1 and x in where])
        if anchors:
            out += anchors
            edges = [(i - 1, j - 1), *anchors, (p, q)]
            todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:], strict=False)]
        else:
            out += [(i + x, j + y) for x, y in common(a[i:p], b[j:q])]
    return sorted(out)


def blocks(pairs: list[tuple[int, int]], sizes: list[int], min_words: int) -> list[list[int]]:
    """Lines of the later document in each aligned block of ``min_words`` words or more; blank lines of a block go with it."""
    out: list[list[int]] = [[]]
    before = (-2, -2)
    for i, j in pairs:
        if (i, j) != (before[0] + 1, before[1] + 1):
            out.append([])
        out[-1].append(j)
        before = (i, j)
    return [x for x in out if sum(sizes[j] for j in x) >= min_words]


def aligned(early: list[int], late: list[int], sizes: list[int], min_words: int) -> list[int]:
    """Lines of the later document that one alignment deletes."""
    return [j for x in blocks(patience(early, late), sizes, min_words) for j in x]


def joined(early: np.ndarray, late: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Aligned pairs with each run of consecutive ones moved, as a whole, to follow the run before where the same lines follow there.

    A diff may take equal lines from far away; none of its runs gets shorter.
    """
    if not pairs:
        return []
    at = np.array(pairs)
    edges = [0, *(np.flatnonzero((np.diff(at, axis=0) != 1).any(1)) + 1).tolist(), len(at)]
    for n, end in zip(edges[1:], edges[2:], strict=False):
        i, j = (at[n - 1] + 1).tolist()
        k = end - n
        if early[i] == late[j] and np.array_equal(early[i : i + k], late[j : j + k]):
            at[n:end] = np.arange(k)[:, None] + (i, j)
    return [(i, j) for i, j in at.tolist()]


def deleted(early: np.ndarray, late: np.ndarray, sizes: np.ndarray, min_words: int) -> np.ndarray:
    """Lines of the later document that go: those of an alignment's blocks, then those that alignments of each stretch between these delete."""
    order = np.argsort(early, kind="stable")
    theirs, gone, todo = early[order], np.zeros(len(late), bool), [(0, len(late))]
    while todo:
        j, q = todo.pop()
        part = late[j:q]
        first, end = np.searchsorted(theirs, part), np.searchsorted(theirs, part, "right")
        if sizes[j:q][end > first].sum() < min_words:
            continue
        _, one = np.unique(part, return_index=True)
        own = np.sort(order[W.spread(first[one], (end - first)[one])])  # the earlier document's lines that the stretch has too
        pairs = joined(early, part, [(int(own[x]), y) for x, y in patience(early[own].tolist(), part.tolist())])
        found = [(j + x[0], j + x[-1] + 1) for x in blocks(pairs, sizes[j:q].tolist(), min_words)]
        for a, b in found:
            gone[a:b] = True
        edges = [j, *(x for y in found for x in y), q]
        todo += [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if found and a < b]
    return np.flatnonzero(gone)


def join_hot(rows: DataFrame, keys: DataFrame, on: str, value: str, held: int) -> DataFrame:
    """``rows`` with ``value`` of their key in ``keys`` (on, value, df); keys in very many of the ``held`` rows don't go through a shuffle."""
    limit = max(HOT_DF, held // MAX_HOT_KEYS)  # held rows have at most MAX_HOT_KEYS keys above it
    marked = rows.join(F.broadcast(keys.filter(F.col("df") > limit).select(on, value)), on, "left")
    rest = marked.filter(F.col(value).isNull()).drop(value).join(keys.filter(F.col("df") <= limit).select(on, value), on)
    return marked.filter(F.col(value).isNotNull()).unionByName(rest)


def remove_lines(docs: DataFrame, rare_df: int = RARE_DF, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(row, n_lines, n_removed, kept), one row per row of ``docs`` (doc_id, text and others); row is the input row.

    kept is the text without the deleted lines, unchanged otherwise: those in
    a block of consecutive lines with ``min_words`` words that is aligned with
    an earlier document. Lines are compared without outer white space. A
    document is later than another if its doc_id is larger; null ids are
    later than all others, rows that repeat an id come in the order of a hash
    of their text, and equal rows are one. A null text has no lines and stays
    null; an empty text has one. An empty table gives an empty result.
    """
    docs = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("k"), F.col("text").cast("string").alias("text")).withColumn("fp", F.xxhash64("text"))
    lines = save(docs.select("k", "fp", "text").mapInArrow(_lines, LINES).dropDuplicates(["k", "fp"]), "lines")
    held = lines.select(F.struct("k", "fp").alias("doc"), F.explode(F.expr("array_distinct(transform(filter(arrays_zip(line, size), x -> x.size > 0), x -> x.line))")).alias("h"))
    shared = save(held.groupBy("h").agg(F.count("*").alias("df"), F.min("doc").alias("first")).filter("df > 1"), "shared")
    rare = held.join(shared.filter(F.col("df") <= rare_df).select("h"), "h").groupBy("h").agg(F.sort_array(F.collect_list("doc")).alias("d"))
    rare = rare.select(F.explode(F.expr("flatten(transform(d, (x, i) -> transform(slice(d, i + 2, size(d)), y -> struct(x as early, y as late))))")).alias("p")).select("p.*")
    held_lines = lines.agg(F.sum(F.size("line"))).first()[0] or 0
    often = join_hot(held, shared.filter(F.col("df") > rare_df).select("h", "df", F.lit(True).alias("is")), "h", "is", held_lines)
    frequent = lines.join(often.groupBy("doc").agg(F.collect_set("h").alias("often")).select("doc.*", "often"), ["k", "fp"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for line, size, often in zip(*(batch.column(i) for i in (2, 3, 4)), strict=True):
                line, size = np.asarray(line.values), np.asarray(size.values)
                found.append(np.unique(shortest_runs(line, size, np.isin(line, np.asarray(often.values)) | (size == 0), min_words)[2]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), W.lists(W.signed(np.concatenate(found)), np.array([len(x) for x in found[1:]], np.int64))], names=["k", "fp", "runs"])

    held = save(frequent.select("k", "fp", "line", "size", "often").mapInArrow(runs, "k long, fp long, runs array<long>").select(F.struct("k", "fp").alias("doc"), F.explode("runs").alias("run")), "runs")
    firsts = save(held.groupBy("run").agg(F.count("*").alias("df"), F.min("doc").alias("first")).filter("df > 1"), "firsts")
    whole = join_hot(held, firsts, "run", "first", held.count()).filter("first < doc").select(F.col("first").alias("early"), F.col("doc").alias("late"))
    pairs = rare.union(whole).distinct()
    early = lines.select(F.struct("k", "fp").alias("early"), F.col("line").alias("early_line"))
    late = lines.select(F.struct("k", "fp").alias("late"), "line", "size")
    both = pairs.join(early, "early").join(late, "late").select("late.k", "late.fp", "early_line", "line", "size")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [deleted(*(np.asarray(x.values) for x in pair), min_words) for pair in zip(*(batch.column(i) for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), W.lists(np.concatenate([np.zeros(0, np.int32), *gone]).astype(np.int32), np.array([len(x) for x in gone], np.int64))], names=["k", "fp", "gone"])

    gone = both.mapInArrow(align, "k long, fp long, gone array<int>").select("k", "fp", F.explode("gone").alias("i"))
    gone = save(gone.groupBy("k", "fp").agg(F.collect_set("i").alias("gone")), "deleted")
    size = gone.agg(F.sum(F.size("gone") * 8 + 120)).first()[0] or 0
    out = docs.join(F.broadcast(gone) if size <= MAX_BROADCAST_BYTES else gone, ["k", "fp"], "left").withColumn("gone", F.coalesce("gone", F.expr("cast(array() as array<int>)")))
    out = out.withColumn("lines", F.split("text", "\n", -1))
    # array_except hashes the deleted numbers, so a text takes time in proportion to its lines.
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')"))
    return out.select("row", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), kept.alias("kept"))
