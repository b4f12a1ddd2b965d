"""N-gram Jaccard join by prefix filters under several global token orders.

Two texts link when their sets of word shingles have a Jaccard similarity of
``num / den`` or more. The candidates come from prefix filters: in any order
of all tokens that is the same for all texts, two linked texts share a token
among the first n - ceil(s * n) + 1 of each. The first order (rare tokens
first) is the index; under the other orders, which break ties among equally
rare tokens differently, a pair must share a prefix token as well before its
sets are compared. Tokens of a single text come first in every order and link
nothing, so a text with more than n - ceil(s * n) of them is out at once.

Classes of links, without all pairs of a group: texts with equal sets are one
node; in each index bucket every node is first compared with one hub, the one
with the fewest tokens of its own (in a group of near copies, the one nearest
to their origin), then with a second hub; what is linked is one component by
then, and the last pass compares only nodes of different components. It
compares every pair that is left and passes the filters, so no link between
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words as W
from tracewell.llm.graph import components
from tracewell.llm.store import join_small, remove, save

#: Share of the token space that the first, cheap filter counts; any share gives the same result.
SAMPLE = 0.3
#: Up to so many ids (16 bytes each) are broadcast; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000


def shingle_sets(chunk: W.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, row after row and sorted, and the number of each row."""
    hashed = W.span_hashes(chunk.data, chunk.starts, chunk.ends)
    good = W.grams_within(chunk.first, n)
    grams, rows = W.gram_hashes(hashed, n)[good], chunk.row_of_word()[: len(good)][good]
    short = np.flatnonzero((chunk.counts > 0) & (chunk.counts < n))
    if len(short):
        whole = [W.gram_hashes(hashed[a:b], b - a)[0] for a, b in zip(chunk.first[short], chunk.first[short + 1], strict=True)]
        grams, rows = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([rows, short])
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    grams, rows = grams[new], rows[new]
    return grams, np.bincount(rows, minlength=chunk.rows)


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of each row's values."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def sketches(n: int, share: float):
    """mapInArrow: (doc_id, n, f1, f2, tokens); f1 and f2 identify a set, tokens are those below the share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.scan(batch.column(1), lower=True):
                grams, counts = shingle_sets(chunk, n)
                low = grams < np.uint64(min(int(share * 2**64), 2**64 - 1)) if share < 1 else np.ones(len(grams), bool)
                rows = np.repeat(np.arange(chunk.rows), counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.row, chunk.rows), pa.array(counts.astype(np.int32)), pa.array(W.signed(row_sums(W.mix(grams, 1), counts))), pa.array(W.signed(row_sums(W.mix(grams, 2), counts))), W.lists(W.signed(grams[low]), np.bincount(rows[low], minlength=chunk.rows))],
                    names=["doc_id", "n", "f1", "f2", "tokens"],
                )

    return run


SKETCH = "doc_id long, n int, f1 long, f2 long, tokens array<long>"


def prefixes_meet(k: int, num: int, den: int, x: str = "x.", y: str = "y.") -> str:
    """SQL: the prefixes under order k share as many tokens as linked texts must.

    Of the common tokens, those outside the shorter-reaching prefix are fewer
    than ceil(s * n) of its text; all others are in both prefixes.
    """
    need = f"((greatest({x}n, {y}n) * {num}L + {den - 1}) div {den})"
    return f"size(array_intersect({x}prefix_{k}, {y}prefix_{k})) >= greatest(1, ({num}L * ({x}n + {y}n) + {num + den - 1}) div {num + den} - {need} + 1)"


def verified(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose prefixes meet under the other orders too and whose sets are similar enough."""
    side = lambda x: nodes.select(*(F.col(c).alias(f"{x}_{c}") for c in ("id", "n", "tokens", "prefix_1", "prefix_2")))
    both = pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id"))
    both = both.filter(" and ".join(prefixes_meet(k, num, den, "a_", "b_") for k in (1, 2)))
    same = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.withColumn("same", same).filter(den * F.col("same") >= num * (F.col("a_n") + F.col("b_n") - F.col("same"))).select("a", "b")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, share: float = SAMPLE) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text).

    Words are lower-cased (A-Z). A text with fewer than n words has its whole
    word sequence as its only shingle; null, empty and white texts have none
    and link with nothing. component_id is the smallest doc_id reachable by
    links. Rows that repeat a doc_id are one node; a null doc_id links with
    nothing and has a null component_id unless an equal set has an id. An
    empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark, made, done = docs.sparkSession, [], []
    sketch = save(docs.mapInArrow(sketches(n, share), SKETCH), "sketch")
    lone = sketch.select("f1", F.explode("tokens").alias("t")).groupBy("t").agg(F.min("f1").alias("f1"), F.max("f1").alias("other")).filter("f1 = other")
    lone = lone.groupBy("f1").agg(F.count("*").alias("lone"))
    classes = sketch.filter("n > 0").join(lone, "f1", "left").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id"), F.max("lone").alias("lone")).filter("id is not null")
    classes = save(classes.withColumn("near", F.expr(f"{den} * (n - coalesce(lone, 0)) >= {num} * n")), "classes")
    few = classes.filter("near").select(F.col("id").alias("doc_id")).distinct()
    rows = few.count()

    sets = save(join_small(docs, few, "doc_id", "left_semi", rows, MAX_BROADCAST_ROWS).mapInArrow(sketches(n, 1.0), SKETCH).select(F.col("doc_id").alias("id"), "n", "f1", "f2", "tokens").dropDuplicates(["id", "n", "f1", "f2"]), "sets", made)
    flat = sets.select("id", "n", "f1", "f2", F.explode("tokens").alias("t"))
    shared = flat.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1")
    need = f"cast((n * {num}L + {den - 1}) div {den} as int)"
    nodes = flat.join(shared, "t").groupBy("id", "n", "f1", "f2").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("all"))
    nodes = nodes.withColumn("alive", F.size("all")).filter(f"alive >= {need}").withColumn("take", F.expr(f"alive - {need} + 1"))
    other = "slice(transform(array_sort(transform(all, x -> struct(cast(log2(x.df) as int) as c, xxhash64(x.t, {k}) as h, x.t as t))), x -> x.t), 1, take)"
    nodes = save(nodes.select("id", "n", "alive", F.expr("array_sort(transform(all, x -> x.t))").alias("tokens"), F.expr("slice(transform(all, x -> x.t), 1, take)").alias("prefix_0"), F.expr(other.format(k=1)).alias("prefix_1"), F.expr(other.format(k=2)).alias("prefix_2")), "nodes", done)
    remove(spark, made)

    index = nodes.select("id", "n", "alive", F.explode("prefix_0").alias("t"))
    fits = f"least(x.alive, y.alive) * {num + den}L >= {num}L * (x.n + y.n)"
    links, comp = None, None
    hubs = ("struct(1 - alive / n as k, id, n, alive, comp)", "struct(xxhash64(id) as k, id, n, alive, comp)")
    for hub in (*hubs, None):
        own = index.withColumn("comp", F.col("id")) if comp is None else index.join(comp, F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "id")).drop("node")
        mixed = own.groupBy("t").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.expr(f"min({hub})" if hub else "count(*)").alias("hub")).filter("low < high")
        if hub:
            pairs = own.alias("x").join(mixed.select("t", "hub.*").alias("y"), "t")
        else:
            left = own.join(mixed.select("t"), "t", "left_semi").join(nodes.select("id", "n", "prefix_0"), ["id", "n"])
            pairs = left.alias("x").join(left.alias("y"), "t").filter("x.id < y.id")
        meet = "x.comp <> y.comp and " + fits + ("" if hub else f" and array_intersect(x.prefix_0, y.prefix_0)[0] = t and {prefixes_meet(0, num, den)}")
        pairs = pairs.filter(meet).select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b")).distinct()
        found = save(verified(pairs, nodes, num, den), "links", done)
        links = found if links is None else links.union(found)
        remove(spark, made)  # the components before
        comp = components(links, made)
    remove(spark, done)
    named = classes.join(comp, F.col("id") == F.col("node"), "left").select("n", "f1", "f2", F.coalesce("comp", "id").alias("comp"))
    out = sketch.join(named, ["n", "f1", "f2"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
