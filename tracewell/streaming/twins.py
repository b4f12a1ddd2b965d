"""What the stream operators compute, over tables: the truth their streams are tested against."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.graph import chain_walk


def coalesce(events: DataFrame, quiet: float, max_wait: float) -> DataFrame:
    """(key, seq, emit_at): of each burst of a key's events (key, seq, t in seconds), the latest one.

    A burst ends before the first event that comes ``quiet`` after the one
    before it or ``max_wait`` after the burst's first.
    """
    w = Window.partitionBy("key").orderBy("t", "seq")
    rows = events.select("key", "seq", "t").withColumn("node", F.row_number().over(w).cast("long")).withColumn("gap", F.col("t") - F.lag("t").over(w))
    # Frames run backwards from the end, so each row adds one value to what is known.
    ahead = Window.partitionBy("key").orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    micros = F.round(F.col("t") * 1_000_000).cast("long")
    ends = rows.select("key", "node", micros.alias("at"), F.lit(0).alias("asks")).union(rows.select("key", "node", micros + round(max_wait * 1_000_000), F.lit(1)))
    later = Window.partitionBy("key").orderBy(F.desc("at"), "asks", F.desc("node")).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("late", F.min(F.when(F.col("asks") == 0, F.col("node"))).over(later)).filter("asks = 1").select("key", "node", "late")
    rows = rows.withColumn("soon", F.min(F.when(F.col("gap") >= quiet, F.col("node"))).over(ahead)).join(ends, ["key", "node"]).withColumn("next", F.least("soon", "late")).drop("soon", "late")
    first = rows.filter("node = 1").select("key", "node")
    starts = chain_walk(rows, first).join(rows.select("key", "node", "next", F.col("t").alias("t0")), ["key", "node"])
    starts = starts.join(rows.groupBy("key").agg(F.max("node").alias("last")), "key").select("key", "t0", F.coalesce(F.col("next") - 1, F.col("last")).alias("node"))
    return starts.join(rows, ["key", "node"]).select("key", "seq", F.least(F.col("t") + quiet, F.col("t0") + max_wait).alias("emit_at"))


#: Kinds and sources of changes that are taken unless a caller names others.
CHANGE_KINDS, CHANGE_SOURCES = ("created", "modified", "deleted", "renamed"), ("watcher", "editor", "agent")


def versioned_ingest(changes: DataFrame, kinds: Sequence[str] = CHANGE_KINDS, sources: Sequence[str] = CHANGE_SOURCES) -> DataFrame:
    """``changes`` (path, seq, version, source, kind) with reason: null where accepted. Rejected ones never exceed the current version."""
    bad = F.when(~F.col("source").isin(*sources), "source").when(~F.col("kind").isin(*kinds), "kind")
    current = F.max(F.when(bad.isNull(), F.col("version"))).over(Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return changes.withColumn("reason", F.coalesce(bad, F.when(F.col("version") <= current, "stale")))


def batch_idempotent(batches: DataFrame) -> DataFrame:
    """``batches`` (batch, seq, source) with outcome: the first of an id is new, its repeats are repeated, another source is an error."""
    first = F.first(F.struct("seq", "source")).over(Window.partitionBy("batch").orderBy("seq"))
    return batches.withColumn("_f", first).withColumn("outcome", F.when(F.col("seq") == F.col("_f.seq"), "new").when(F.col("source") == F.col("_f.source"), "repeated").otherwise("error")).drop("_f")


def txn_commit(edits: DataFrame) -> DataFrame:
    """(txn, edits): the number of staged edits of each transaction that has a commit and no abort."""
    by = edits.groupBy("txn").agg(F.count_if(F.col("kind") == "commit").alias("c"), F.count_if(F.col("kind") == "abort").alias("a"), F.count_if(~F.col("kind").isin("commit", "abort")).alias("edits"))
    return by.filter("c > 0 and a = 0").select("txn", "edits")


def watch_stable(seen: DataFrame) -> DataFrame:
    """``seen`` with accepted: size, time and hash are the same before and after reading; others are to be reconciled."""
    same = (F.col("size_before") == F.col("size_after")) & (F.col("time_before") == F.col("time_after")) & F.col("hash_before").eqNullSafe(F.col("hash_after"))
    return seen.withColumn("accepted", F.coalesce(same, F.lit(False)))


def reconcile(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Entries without those that a deletion, rename or lost event names."""
    gone = targets.filter(F.col("kind").isin("delete", "rename", "event_loss")).select("path")
    return entries.join(gone, "path", "left_anti")


def epochs(rows: DataFrame, identity: list[str]) -> DataFrame:
    """``rows`` (key, seq and identity columns) with epoch: one more at each change of identity."""
    w = Window.partitionBy("key").orderBy("seq")
    who = F.struct(*identity)
    changed = ~F.lag(who).over(w).eqNullSafe(who) & (F.row_number().over(w) > 1)
    return rows.withColumn("epoch", F.sum(changed.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def activity(rows: DataFrame) -> DataFrame:
    """(key, pending, lag_ms): revisions after the last analysed one and how long the first of them has waited. rows: key, seq, ts, analysed."""
    done = rows.groupBy("key").agg(F.coalesce(F.max(F.when(F.col("analysed"), F.col("seq"))), F.lit(-1)).alias("_d"), F.max("ts").alias("_now"))
    late = rows.join(done, "key").filter(F.col("seq") > F.col("_d"))
    out = late.groupBy("key").agg(F.count("*").alias("pending"), F.floor((F.unix_micros(F.max("_now")) - F.unix_micros(F.min("ts"))) / 1000).alias("lag_ms"))
    return done.select("key").join(out, "key", "left").na.fill(0)


def sequence_check(rows: DataFrame) -> DataFrame:
    """(stream, sequence, rule): gaps and repeats of a stream's sequence numbers."""
    w = Window.partitionBy("stream").orderBy("sequence", "id")
    rows = rows.withColumn("_p", F.lag("sequence").over(w))
    rule = F.when(F.col("sequence") == F.col("_p"), "duplicate").when(F.col("sequence") > F.col("_p") + 1, "gap")
    return rows.select("stream", "sequence", rule.alias("rule")).filter("rule is not null")


def pointer_chain(requests: DataFrame) -> DataFrame:
    """(key, seq): accepted requests (key, seq, generation, expected): each expects its accepted predecessor, or ``*``; the first needs empty or ``*``."""
    after = requests.select("key", F.col("seq").alias("s"), F.col("expected").alias("generation"))
    exact = requests.select("key", "seq", "generation").join(after, ["key", "generation"]).filter("s > seq").groupBy("key", "seq").agg(F.min("s").alias("exact"))
    stars = F.min(F.when(F.col("expected") == "*", F.col("seq"))).over(Window.partitionBy("key").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1))
    rows = requests.withColumn("star", stars).join(exact, ["key", "seq"], "left").select("key", F.col("seq").alias("node"), F.least("exact", "star").alias("next"))
    heads = requests.filter("expected in ('', '*')").groupBy("key").agg(F.min("seq").alias("node"))
    return chain_walk(rows, heads).select("key", F.col("node").alias("seq"))


def failure_timeline(observed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(trace, place, kind, source): observations in order of time; corroborated if a code node has the symbol."""
    known = nodes.select("symbol").distinct().withColumn("_known", F.lit(True))
    out = observed.join(known, "symbol", "left")
    place = F.row_number().over(Window.partitionBy("trace").orderBy("ts", "seq"))
    return out.select("trace", place.cast("long").alias("place"), "kind", F.when(F.col("_known"), "corroborated").otherwise("runtime").alias("source"))


def settled(rows: DataFrame) -> DataFrame:
    """(key, seq, epoch, accepted) of a log (key, seq, identity, result_epoch): identity rows begin a new epoch where it changes; a result (its epoch isn't null) is taken only in its own epoch."""
    w = Window.partitionBy("key").orderBy("seq")
    who = F.when(F.col("result_epoch").isNull(), F.col("identity"))
    before = F.last(who, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    changed = F.coalesce(before.isNotNull() & who.isNotNull() & (who != before), F.lit(False))
    rows = rows.withColumn("_c", changed.cast("long")).withColumn("epoch", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("key", "seq", "epoch", F.coalesce(F.col("result_epoch") == F.col("epoch"), F.lit(True)).alias("accepted"))


def timeline(observed: DataFrame, nodes: DataFrame, around: str) -> DataFrame:
    """``observed`` (trace, seq, symbol, kind, ts) with source: corroborated by each code node (symbol, seen) known ``around`` it, runtime without."""
    near = F.expr(f"o.symbol = n.node and n.seen >= o.ts - interval {around} and n.seen <= o.ts + interval {around}")
    out = observed.alias("o").join(nodes.select(F.col("symbol").alias("node"), "seen").alias("n"), near, "left")
    return out.select("trace", "seq", "kind", F.when(F.col("node").isNotNull(), "corroborated").otherwise("runtime").alias("source"), "ts")
