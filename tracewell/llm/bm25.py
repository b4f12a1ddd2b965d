"""Exact top-k search: BM25 over sharded inverted indexes with block-max WAND.

Each input partition becomes one or more shards; an index row is one term of
one shard, with its documents in order and, for each block of them, the
largest term frequency and the smallest length. Queries read the rows of their
own terms only. Document frequencies, the number of documents and their mean
length are taken over all shards, so every shard scores alike and the merge of
the shards' best k is exact. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words as W
from tracewell.llm.store import save

K1, B = 1.2, 0.75
BLOCK = 64
#: Tokens after which a shard is closed.
SHARD_TOKENS = 3_000_000
#: Up to so many distinct query terms (8 bytes each) are broadcast; more are joined by a shuffle.
MAX_BROADCAST_TERMS = 500_000
#: Queries go through the shards in blocks of about so many distinct words.
BLOCK_TERMS = 200_000
INDEX = "shard long, term long, df int, docs array<long>, tfs array<int>, lengths array<int>, most array<int>, least array<int>"


def _terms(chunk: W.Chunk) -> np.ndarray:
    return W.span_hashes(chunk.data, chunk.starts, chunk.ends)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to INDEX. A row of term 0 lists the shard's documents and lengths."""
    held: list[tuple] = []
    number = TaskContext.get().partitionId() << 32

    def close() -> pa.RecordBatch:
        nonlocal held, number
        number += 1
        ids, sizes, terms = (np.concatenate(x) for x in zip(*held, strict=True))
        held = []
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        ids, lengths = ids[order], sizes[order].astype(np.int32)
        doc = np.repeat(rank, sizes)
        by = np.lexsort((doc, terms))
        terms, doc = terms[by], doc[by]
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(terms))).astype(np.int32)
        terms, doc = terms[at], doc[at]
        head = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        df = np.diff(np.append(head, len(terms)))
        blocks = -(-df // BLOCK)
        of_block = np.repeat(head, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        most = np.maximum.reduceat(tf, of_block) if len(tf) else tf
        least = np.minimum.reduceat(lengths[doc], of_block) if len(tf) else tf
        zero = np.zeros(0, np.int32)
        rows = lambda values, all_, counts, n: W.lists(np.concatenate([all_, values]), np.concatenate([[n], counts]))
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(1 + len(head), number)), pa.array(np.concatenate([[0], W.signed(terms[head])])), pa.array(np.concatenate([[n], df]).astype(np.int32)),
                rows(ids[doc], ids, df, n), rows(tf, zero, df, 0), rows(lengths[doc], lengths, df, n), rows(most, zero, blocks, 0), rows(least, zero, blocks, 0),
            ],
            names=["shard", "term", "df", "docs", "tfs", "lengths", "most", "least"],
        )

    total = 0
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for chunk in W.scan(batch.column(1), lower=True):
            held.append((ids[chunk.row : chunk.row + chunk.rows], chunk.counts, _terms(chunk)))
            total += len(chunk.starts)
            if total >= SHARD_TOKENS:
                yield close()
                total = 0
    if held:
        yield close()


def build(docs: DataFrame) -> DataFrame:
    """INDEX over all rows of ``docs`` (doc_id, text), written to the shared folder.

    Words are lower-cased (A-Z). Null and empty texts have length 0 and match
    nothing, but count as documents; rows without an id can't be named by a
    result and are left out; rows that repeat an id are documents each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return save(docs.filter("doc_id is not null").mapInArrow(_index, INDEX), "index")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times) of ``queries`` (query_id, text); null and empty texts and null ids give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.scan(batch.column(1), lower=True):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.row, chunk.rows).take(pa.array(chunk.row_of_word())), pa.array(W.signed(_terms(chunk)))], names=["query_id", "term"])

    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text")).filter("query_id is not null")
    return queries.mapInArrow(run, "query_id long, term long").groupBy("query_id", "term").agg(F.count("*").alias("times"))


class Cursor:
    """A query's place in a term's postings in one shard. The arrays, without the query's weight, are shared by all queries."""

    def __init__(self, term: int, weight: float, docs: Sequence[int], scores: Sequence[float], bounds: Sequence[float]):
        self.term, self.weight, self.at = term, weight, 0
        self.docs, self.scores, self.bounds = docs, scores, bounds
        self.bound = weight * max(bounds)

    @property
    def doc(self) -> int:
        return self.docs[self.at]

    def seek(self, doc: int) -> bool:
        """Moves to the first document from ``doc`` on; false at the end."""
        self.at = bisect_left(self.docs, doc, self.at)
        return self.at < len(self.docs)

    def block(self, doc: int) -> tuple[float, int]:
        """Upper bound of the block that would hold ``doc``, and the block's last document."""
        at = bisect_left(self.docs, doc, self.at)
        if at == len(self.docs):
            return 0.0, self.docs[-1]
        return self.weight * self.bounds[at // BLOCK], self.docs[min(len(self.docs), (at // BLOCK + 1) * BLOCK) - 1]


def wand(cursors: list[Cursor], k: int) -> list[tuple[float, int]]:
    """The k best (score, document) of one shard; of equal scores, smaller ids first.

    Documents come in order of id, so one with the score of the kth can't
    replace it: whatever can't exceed that score is skipped.
    """
    best: list[tuple[float, int]] = []
    floor = 0.0
    slack = 1 + 1e-9  # sums of bounds may round down
    cursors = list(cursors)
    while cursors:
        cursors.sort(key=lambda c: c.docs[c.at])
        total, pivot = 0.0, -1
        for n, c in enumerate(cursors):
            total += c.bound
            if total * slack > floor:
                pivot = n
                break
        if pivot < 0:
            break
        doc = cursors[pivot].doc
        while pivot + 1 < len(cursors) and cursors[pivot + 1].doc == doc:
            pivot += 1
        blocks = [c.block(doc) for c in cursors[: pivot + 1]]
        if sum(b for b, _ in blocks) * slack <= floor:
            after = min(last for _, last in blocks) + 1
            if pivot + 1 < len(cursors):
                after = min(after, cursors[pivot + 1].doc)
            after = max(after, doc + 1)
            cursors = [c for n, c in enumerate(cursors) if n > pivot or c.seek(after)]
        elif cursors[0].doc == doc:
            here = sorted((c for c in cursors[: pivot + 1]), key=lambda c: c.term)
            score = 0.0
            for c in here:
                score += c.weight * c.scores[c.at]
            if score > floor or len(best) < k:
                best.append((score, doc))
                best.sort(key=lambda x: (-x[0], x[1]))
                del best[k:]
                floor = best[-1][0] if len(best) == k else 0.0
            cursors = [c for n, c in enumerate(cursors) if n > pivot or c.seek(doc + 1)]
        else:
            cursors = [c for n, c in enumerate(cursors) if n > pivot or c.seek(doc)]
    return best


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each of ``queries`` (query_id, text).

    score is BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)), a query's
    repeated words counting as often. Equal scores are ranked by doc_id. Rows
    that repeat a query_id are one query of all their words. Documents without
    a word of the query aren't returned. No rows for an empty index or query.
    Queries are dealt into blocks of about BLOCK_TERMS words; each shard takes
    each block by itself, so what a task holds doesn't grow with the queries.
    """
    terms = save(query_terms(queries), "terms")
    wanted = terms.select("term").distinct()
    count = wanted.count()
    found = save(index.join(F.broadcast(wanted) if count <= MAX_BROADCAST_TERMS else wanted, "term", "left_semi"), "postings")
    about = index.filter("term = 0").agg(F.sum(F.col("df").cast("long")).alias("n"), F.sum(F.expr("aggregate(lengths, 0L, (s, x) -> s + x)")).alias("words")).first()
    n, mean = about["n"] or 0, (about["words"] or 0) / max(1, about["n"] or 0) or 1.0
    weights = found.groupBy("term").agg(F.sum(F.col("df").cast("long")).alias("all"))
    weighted = terms.join(weights, "term").select("query_id", "term", (F.col("times") * F.log(1 + (n - F.col("all") + 0.5) / (F.col("all") + 0.5))).alias("weight"))
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    by_term = weighted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).groupBy("term", "block").agg(F.collect_list(F.struct("query_id", "weight")).alias("queries"))
    rows = found.join(by_term, "term")

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        by_query: dict[int, list[Cursor]] = {}
        for row in shard.itertuples():
            tf, length = np.asarray(row.tfs, float), np.asarray(row.lengths, float)
            most, least = np.asarray(row.most, float), np.asarray(row.least, float)
            impact = lambda t, d: t * (K1 + 1) / (t + K1 * (1 - B + B * d / mean))
            docs, scores, bounds = array("q", np.asarray(row.docs, np.int64).tobytes()), array("d", impact(tf, length).tobytes()), array("d", impact(most, least).tobytes())
            for q in row.queries:
                by_query.setdefault(q["query_id"], []).append(Cursor(row.term, q["weight"], docs, scores, bounds))
        out = [(q, doc, score) for q, cursors in by_query.items() for score, doc in wand(cursors, k)]
        return pd.DataFrame(out, columns=["query_id", "doc_id", "score"])

    best = rows.groupBy("shard", "block").applyInPandas(run, "query_id long, doc_id long, score double")
    ranked = best.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, doc_id)"))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")
