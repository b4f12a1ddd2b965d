"""The stream operators: keyed state with event-time timers, over Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.streaming.twins import CHANGE_KINDS, CHANGE_SOURCES


def coalesce_stream(events: DataFrame, quiet: float, max_wait: float, late: str = "0 seconds") -> DataFrame:
    """The stream twin of ``twins.coalesce`` over (key, seq, ts): a burst is emitted when its timer passes the watermark or its next event comes."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, seq = state.get if state.exists else (None, None, None)
        out = []
        due = lambda: min(last + quiet, first + max_wait)
        if state.hasTimedOut:
            out.append((key[0], seq, due()))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
            for ts, n in zip(rows["ts"].astype("int64") / 1e9 if str(rows["ts"].dtype).endswith("[ns]") else rows["ts"].astype("datetime64[ns]").astype("int64") / 1e9, rows["seq"], strict=True):
                if first is not None and (ts - last >= quiet or ts - first >= max_wait):
                    out.append((key[0], seq, due()))
                    first = None
                first, last, seq = ts if first is None else first, ts, int(n)
            state.update((first, last, seq))
            state.setTimeoutTimestamp(max(int(due() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "seq", "emit_at"])

    marked = events.withWatermark("ts", late)
    return marked.groupBy("key").applyInPandasWithState(run, "key long, seq long, emit_at double", "first double, last double, seq long", "append", GroupStateTimeout.EventTimeTimeout)


def ingest_stream(changes: DataFrame, kinds: Sequence[str] = CHANGE_KINDS, sources: Sequence[str] = CHANGE_SOURCES) -> DataFrame:
    """The stream twin of ``twins.versioned_ingest``: (path, seq, reason) by the current version of each path."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            reason = "source" if r.source not in sources else "kind" if r.kind not in kinds else "stale" if current is not None and r.version <= current else None
            if reason is None:
                current = int(r.version)
            out.append((key[0], int(r.seq), reason))
        if current is not None:
            state.update((current,))
        yield pd.DataFrame(out, columns=["path", "seq", "reason"])

    return changes.groupBy("path").applyInPandasWithState(run, "path string, seq long, reason string", "version long", "append", GroupStateTimeout.NoTimeout)


def idempotent_stream(batches: DataFrame, late: str) -> DataFrame:
    """The first row of each batch id within the watermark."""
    return batches.withWatermark("ts", late).dropDuplicatesWithinWatermark(["batch"])


def replay_stream(events: DataFrame) -> DataFrame:
    """The stream twin of the ledger replay, in update mode: (subject, approved, draft)."""
    dead = F.max(F.when(F.col("kind") == "reject", F.col("seq")))
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("seq", "name")))
    by = events.groupBy("subject").agg(dead.alias("dead"), last("approve").alias("a"), last("draft").alias("d"))
    alive = lambda c: F.when(F.col(f"{c}.seq") > F.coalesce("dead", F.lit(-1)), F.col(f"{c}.name"))
    return by.select("subject", alive("a").alias("approved"), alive("d").alias("draft"))


def txn_stream(edits: DataFrame, expiry: float, late: str = "0 seconds") -> DataFrame:
    """(txn, outcome, edits) of transactions over (txn, seq, kind, size, ts): committed, aborted or expired.

    A commit names its number of staged edits (size) and holds once they are
    all there, in whatever order they come; an abort before that drops all. A
    transaction that is open ``expiry`` seconds of event time after its first
    row expires. State is the staged numbers of open transactions, and, until
    that time, that an ended one is closed, so what comes late opens nothing.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        staged, size, until, closed = state.get if state.exists else ([], None, None, False)
        staged, out = set(staged), []
        if state.hasTimedOut:
            if not closed:
                out.append((key[0], "expired", len(staged)))
            state.remove()
        else:
            for part in parts:
                for r in part.sort_values("seq").itertuples():
                    end = int((r.ts.timestamp() + expiry) * 1000)
                    until = end if until is None else min(until, end)
                    if closed:
                        continue
                    if r.kind == "abort":
                        out.append((key[0], "aborted", len(staged)))
                        closed = True
                    elif r.kind == "commit":
                        size = int(r.size)
                    else:
                        staged.add(int(r.seq))
                    if not closed and size is not None and len(staged) >= size:
                        out.append((key[0], "committed", len(staged)))
                        closed = True
            state.update(([] if closed else sorted(staged), size, until, closed))
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["txn", "outcome", "edits"])

    marked = edits.withWatermark("ts", late)
    return marked.groupBy("txn").applyInPandasWithState(run, "txn string, outcome string, edits long", "staged array<long>, size long, until long, closed boolean", "append", GroupStateTimeout.EventTimeTimeout)


def epoch_stream(rows: DataFrame) -> DataFrame:
    """The stream twin of ``twins.settled`` over a key's log in order: (key, seq, epoch, accepted)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        who, epoch = state.get if state.exists else (None, 0)
        out = []
        for part in parts:
            for r in part.sort_values("seq").itertuples():
                if pd.isna(r.result_epoch):
                    epoch += who is not None and r.identity != who
                    who = r.identity
                    out.append((key[0], r.seq, epoch, True))
                else:
                    out.append((key[0], r.seq, epoch, int(r.result_epoch) == epoch))
        state.update((who, epoch))
        yield pd.DataFrame(out, columns=["key", "seq", "epoch", "accepted"])

    return rows.groupBy("key").applyInPandasWithState(run, "key long, seq long, epoch long, accepted boolean", "who string, epoch long", "append", GroupStateTimeout.NoTimeout)


def timeline_stream(observed: DataFrame, nodes: DataFrame, around: str, late: str = "0 seconds") -> DataFrame:
    """The stream twin of ``twins.timeline``: observations (trace, seq, symbol, kind, ts) with the code nodes (symbol, seen) known ``around`` them; runtime only once the watermark rules out a node."""
    left = observed.withWatermark("ts", late).alias("o")
    right = nodes.select(F.col("symbol").alias("node"), "seen").withWatermark("seen", late).alias("n")
    near = F.expr(f"o.symbol = n.node and n.seen >= o.ts - interval {around} and n.seen <= o.ts + interval {around}")
    return left.join(right, near, "left_outer").select("trace", "seq", "kind", F.when(F.col("node").isNotNull(), "corroborated").otherwise("runtime").alias("source"), "ts")
