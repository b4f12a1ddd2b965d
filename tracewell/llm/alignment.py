"""Alignment of two tokenizers' tokens over the same texts, and how often their ids meet.

The ends of both tokenizers' tokens in a batch of texts are two ascending
lists. Binary searches on equally spaced diagonals of their merge divide it
into independent pieces of equal work, whatever the texts' lengths; a piece
emits the overlaps of its tokens and the places where both end, and a group
that crosses pieces is put together from the places of both. Distinct id
pairs of a batch travel once; Spark adds them up over all batches and sends
each batch the counts of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.packing import encoder, load, splits_at_spaces, token_bytes
from tracewell.llm.store import remove, save
from tracewell.llm.words import lists, span_hashes, spread

#: Text that is aligned at once, one text at least, and ends that a piece merges.
BATCH_CHARS, PIECE = 1 << 20, 1 << 16
SPACE = "▁"
#: Units in a string; the piece model takes more than proportional time for long ones.
STRING = 256
#: Bytes that aren't white space or a control character, and first bytes of two or three that could be Unicode white space (U+0085 to U+3000).
SOLID, MAYBE = np.arange(256) > 0x20, np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
BATCHES = "batch long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, groups array<string>, links binary, keys array<long>, numbers array<long>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def unit_starts(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin in UTF-8 texts ``data[edges[i] : edges[i + 1]]``, and which of them can stand side by side in another text.

    A unit begins at a text's begin and at each space between two characters
    that surely aren't white space; where bytes could be those of Unicode
    white space nothing is cut. A unit stands by itself if such a character
    follows its first space and ends it, and no U+2581 is in it.
    """
    far = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)])
    at = np.flatnonzero(data == 0x20)
    solid = SOLID[far[at + 4]] & ~MAYBE[far[at + 4]]  # after a space
    mark = np.flatnonzero(data == 0x96)
    marks = mark[(far[mark + 2] == 0xE2) & (far[mark + 4] == 0x81)]

    def ends_well(p: np.ndarray) -> np.ndarray:
        return SOLID[far[p + 2]] & (far[p + 1] != 0xC2) & ~MAYBE[far[p]]

    begin = edges[:-1][np.diff(edges) > 0]
    starts = np.union1d(at[solid & ends_well(at)], begin)
    ends = np.append(starts[1:], len(data))
    alone = SOLID[far[np.minimum(starts + 4, len(far) - 1)]] & ~MAYBE[far[np.minimum(starts + 4, len(far) - 1)]] & (ends - starts > 1) & ends_well(ends)
    alone[np.searchsorted(starts, marks, "right") - 1] = False
    return starts, alone


class Sides:
    """The byte-level tokenizer file ``a_path``, its special tokens' strings taken as plain text, and the piece model ``b_path``.

    Neither merges over a space between two other characters, so texts fall
    into units there, and each distinct unit of a batch is encoded once, with
    many others in one string.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.model = encoder(a_path, special=False), sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tables = token_bytes(a_path), [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(pieces)]
        self.lengths = [np.array([len(x) for x in t], np.int64) for t in self.tables]
        self.space = self.model.piece_to_id(SPACE)
        self.apart = splits_at_spaces(a_path) and not any(SPACE in x.lstrip(SPACE) for x in pieces)
        load.cache_clear()

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Of a text that begins with a space, which the piece model adds by itself."""
        return self.a(text).astype(np.int64), np.array([self.space] if text == " " else self.model.encode(text[1:]), np.int64)

    def whole(self, k: int, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tables[k].__getitem__, ids.tolist()))

    def encode(self, units: list[bytes], alone: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Of distinct units: the ids of both, one unit after another, the number of each unit's, and which are not given back byte for byte."""
        sizes = np.array([len(x) for x in units], np.int64)
        own = [x for x, y in zip(units, alone, strict=True) if y]
        strings = [b"".join(own[i : i + STRING]) for i in range(0, len(own), STRING)]
        joined = b"".join(strings)
        none = np.zeros(0, np.int64)
        many = self.a(joined.decode()).astype(np.int64), np.concatenate([none, *self.model.encode([x[1:].decode() for x in strings], num_threads=1)]).astype(np.int64)
        if any(self.whole(k, x) != joined for k, x in enumerate(many)):
            return self.encode(units, np.zeros(len(units), bool))
        few = [self.ids(x.decode()) for x, y in zip(units, alone, strict=True) if not y]
        bad, ids, counts = np.zeros(len(units), bool), [], []
        for k in (0, 1):
            count = np.zeros(len(units), np.int64)
            count[alone] = np.diff(np.searchsorted(np.cumsum(self.lengths[k][many[k]]), np.cumsum(sizes[alone]), "right"), prepend=0)
            count[~alone] = [len(x[k]) for x in few]
            bad[~alone] |= np.array([self.whole(k, x[k]) != units[u] for x, u in zip(few, np.flatnonzero(~alone), strict=True)], bool)
            first = np.where(alone, np.cumsum(count * alone) - count, len(many[k]) + np.cumsum(count * ~alone) - count)
            ids.append(np.concatenate([many[k], *(x[k] for x in few)])[spread(first, count)])
            counts.append(count)
        return ids, counts, bad

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of all texts, one after another, and the number of each text's, of both."""
        own = [f" {t}".encode() if t else b"" for t in texts]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        data = np.frombuffer(b"".join(own), np.uint8)
        starts, alone = unit_starts(data, edges) if self.apart else (edges[:-1][np.diff(edges) > 0], np.zeros(int((np.diff(edges) > 0).sum()), bool))
        ends = np.append(starts[1:], len(data))
        _, at, unit = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        same = (ends - starts == (ends - starts)[at][unit]).all() and (data == data[spread(starts[at][unit], ends - starts)]).all()
        if not same:  # two units of one hash
            at = unit = np.arange(len(starts))
        raw = data.tobytes()
        ids, counts, bad = self.encode([raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], alone[at])
        firsts = [np.cumsum(x) - x for x in counts]
        lost = np.zeros(len(starts), bool)
        for text in np.unique(np.searchsorted(edges, starts[bad[unit]], "right") - 1):
            a, b = np.searchsorted(starts, edges[text : text + 2])
            if any(self.whole(k, ids[k][spread(firsts[k][unit[a:b]], counts[k][unit[a:b]])]) != own[text] for k in (0, 1)):
                lost[a:b] = True
        out = []
        for k in (0, 1):
            size = np.where(lost, 0, counts[k][unit])
            upto = np.concatenate([[0], np.cumsum(size)])
            out.append((ids[k][spread(firsts[k][unit], size)], np.diff(upto[np.searchsorted(starts, edges)])))
        return [x[0] for x in out], [x[1] for x in out]


sides = cache(Sides)


def divide(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` are among the first 0, step, 2 * step ... of their merge; equal ones of ``a`` come first.

    On each diagonal the point is found by halving, all diagonals at once.
    """
    at = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        up = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(at - 1 - mid, 0, len(b) - 1)]) if len(a) and len(b) else open_
        low, high = np.where(up, mid + 1, low), np.where(open_ & ~up, mid, high)
    return low, at - low


def merge_piece(a: np.ndarray, b: np.ndarray, i: int, i_end: int, j: int, j_end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the ends i:i_end of ``a`` and j:j_end of ``b``: the overlapping tokens (of a, of b), and how many tokens (of a, of b) there are up to each common end.

    An end that the piece before has on the other side is a common end here.
    """
    own_a, own_b = a[i:i_end], b[j:j_end]
    ends, is_a = np.empty(len(own_a) + len(own_b), np.int64), np.zeros(len(own_a) + len(own_b), bool)
    at = np.arange(len(own_a)) + np.searchsorted(own_b, own_a, "left")
    is_a[at] = True
    ends[is_a], ends[~is_a] = own_a, own_b
    before = np.empty_like(ends)
    before[1:] = ends[:-1]
    before[:1] = max(a[i - 1] if i else 0, b[j - 1] if j else 0)
    upto_a = i + np.cumsum(is_a)
    upto_b = i + j + np.arange(1, len(ends) + 1) - upto_a
    new = ends > before
    return (upto_a - is_a)[new], (upto_b - ~is_a)[new], upto_a[~new], upto_b[~new]


def merged(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> list[np.ndarray]:
    """What the pieces emit, put together: overlaps (of a, of b) and common ends (of a, of b)."""
    i, j = divide(a, b, step)
    parts = [merge_piece(a, b, *x) for x in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4


@cache
def digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below ``n`` in decimal as rows of bytes, filled up with zero bytes, and their lengths."""
    width = len(str(max(0, n - 1)))
    rows = np.array([str(x) for x in range(n)], f"S{width}").view(np.uint8).reshape(n, width)
    return rows, (rows > 0).sum(axis=1)


def written(ids: tuple[np.ndarray, np.ndarray], cuts: tuple[np.ndarray, np.ndarray], edges: tuple[np.ndarray, np.ndarray], most: int) -> Iterator[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``: ``cuts`` are the tokens up to the end of each group, ``edges`` those up to the end of each text."""
    rows, sizes = digits(most)
    n = len(ids[0]) + len(ids[1])
    all_ids, marks = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
    for k, end in ((0, b"|"), (1, b";")):
        group = np.repeat(np.arange(len(cuts[k])), np.diff(cuts[k], prepend=0))
        other = cuts[1 - k] if k else np.concatenate([[0], cuts[1][:-1]])
        at = np.arange(len(ids[k])) + other[group]
        all_ids[at] = ids[k]
        marks[at[cuts[k] - 1]] = end[0]
    last = edges[0] + edges[1]
    marks[last[np.diff(last, prepend=0) > 0] - 1] = 0
    size = np.concatenate([[0], np.cumsum(sizes[all_ids] + (marks > 0))])
    text = np.concatenate([rows[all_ids], marks[:, None]], axis=1).ravel()
    text = text[text > 0].tobytes()
    for x, y in zip(np.concatenate([[0], last[:-1]]), last, strict=True):
        yield text[size[x] : size[y]]


def squeeze(links: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed byte by byte: the upper bytes are mostly 0."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(links.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def align_batch(texts: list[str | None], a_path: str, b_path: str, carry: bool) -> dict:
    """The fields of BATCHES of some texts, but their ids."""
    both = sides(a_path, b_path)
    ids, counts = both.tokens(texts)
    edges = [np.cumsum(x) for x in counts]
    link_a, link_b, *cuts = merged(*(np.cumsum(x[i]) for x, i in zip(both.lengths, ids, strict=True)))
    keys, links, numbers = np.unique(ids[0][link_a] * len(both.tables[1]) + ids[1][link_b], return_inverse=True, return_counts=True)
    order = np.argsort(-numbers, kind="stable")  # frequent pairs get low numbers
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    groups = np.diff(np.searchsorted(cuts[0], edges[0], "right"), prepend=0)
    strings = list(written(ids, cuts, edges, max(map(len, both.tables))))
    return {"n_a": counts[0], "n_b": counts[1], "n_groups": groups, "digests": [hashlib.sha256(x).hexdigest() if x else "" for x in strings], "groups": [x.decode() for x in strings] if carry else [None] * len(texts), "links": squeeze(place[links]), "keys": keys[order], "numbers": numbers[order]}


def align_batches(a_path: str, b_path: str, carry: bool, most: int):
    """mapInArrow from (doc_id, text) to BATCHES; a batch's number is that of its partition and its place there."""
    schema = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())), ("groups", pa.list_(pa.string())), ("links", pa.binary()), ("keys", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int64()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def batch() -> pa.RecordBatch:
            out = align_batch(texts, a_path, b_path, carry)
            one = {k: pa.array([v], schema.field(k).type) if k == "links" else lists(pa.array(v, schema.field(k).type.value_type), [len(v)]) for k, v in out.items()}
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists(pa.array(docs, pa.int64()), [len(docs)]), *(one[x] for x in schema.names[2:])], schema=schema)

        for part in rows:
            for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                docs.append(doc)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= most:
                    yield batch()
                    number, docs, texts, size = number + 1, [], [], 0
        if docs:
            yield batch()

    return run


def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BATCHES with ``found`` (the total and whether it is the best, at each of the batch's pairs) to ALIGNED."""
    for part in rows:
        for k in range(part.num_rows):
            row = {x: part.column(x)[k] for x in part.schema.names}
            n_a, n_b, groups = (row[x].values.to_numpy(zero_copy_only=False) for x in ("n_a", "n_b", "n_groups"))
            found = row["found"].values if row["found"].is_valid else None
            size = len(found) if found is not None else 0
            total, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
            if size:
                at = found.field("at").to_numpy(zero_copy_only=False)
                total[at], best[at] = found.field("total").to_numpy(zero_copy_only=False), found.field("best").to_numpy(zero_copy_only=False)
            links = expand(row["links"].as_py())
            n_links = n_a + n_b - groups
            edges = np.cumsum(n_links)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[links])])[edges], prepend=0) for x in (best, total)]
            columns = [row["doc_ids"].values, *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups, n_links, *sums)), row["digests"].values, row["groups"].values]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"])


def align(docs: DataFrame, a_path: str, b_path: str, carry_groups: bool = False, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """ALIGNED, one row per row of ``docs`` (doc_id, text).

    Both files are on every executor. Texts that are null or empty, or that a
    tokenizer doesn't give back byte for byte after a space (one with U+2581,
    say), have no tokens: zeros and ''. ``groups`` has the groups as written,
    or null without ``carry_groups``. Repeated rows are rows of their own and
    their links count; null ids stay null; ties for a B id's highest count are
    all best. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width, made = len(sides(a_path, b_path).tables[1]), []
    table = save(docs.mapInArrow(align_batches(a_path, b_path, carry_groups, batch_chars), BATCHES), "aligned")
    pairs = table.select("batch", F.posexplode(F.arrays_zip("keys", "numbers")).alias("at", "pair")).select("batch", "at", F.col("pair.keys").alias("key"), F.col("pair.numbers").alias("n"))
    totals = save(pairs.groupBy("key").agg(F.sum("n").alias("total")), "pairs", made)
    b = F.col("key") % width
    highest = totals.groupBy(b.alias("b")).agg(F.max("total").alias("highest"))
    marked = totals.withColumn("b", b).join(highest, "b").select("key", "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))
    n = max(1, table.count())
    back = pairs.select("batch", "at", "key").join(marked, "key").repartition(n, "batch").groupBy("batch").agg(F.collect_list(F.struct("at", "total", "best")).alias("found"))
    out = save(table.drop("keys", "numbers").repartition(n, "batch").join(back, "batch", "left").mapInArrow(finish, ALIGNED), "aligned")
    remove(docs.sparkSession, made)
    return out
