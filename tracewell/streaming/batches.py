"""Batches of versioned changes, taken whole or not at all: over tables and as a stream.

Changes are (repo, number, size, idx, source, kind, path, old_path, version,
content, content_id): number counts a repository's batches from 1, size is
that of the batch. A repository's batches are judged in order, as each sees
the versions that the accepted ones before it have left.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Kinds of changes, sources, and the source that may leave versions to the ingress.
KINDS, SOURCES, WATCHER = ("create", "upsert", "delete", "rename"), ("editor", "agent", "watcher_fallback"), "watcher_fallback"
JUDGED = "repo string, number long, idx long, accepted boolean, reason string, version long"
FIELDS = ["repo", "number", "size", "idx", "source", "kind", "path", "old_path", "version", "content", "content_id"]


def refused(path: str | None) -> bool:
    return not path or "\0" in path or "\\" in path or path.startswith("/") or ".." in path.split("/") or not re.sub(r"[./]", "", path)


def fault(change: dict) -> str | None:
    """What is wrong with a change by itself."""
    if change["source"] not in SOURCES:
        return "source"
    if change["kind"] not in KINDS:
        return "kind"
    if refused(change["path"]) or (change["kind"] == "rename" and refused(change["old_path"])):
        return "path"
    if change["kind"] == "rename" and change["old_path"] == change["path"]:
        return "rename"
    if change["kind"] != "delete" and change["content_id"] and change["content_id"] != hashlib.sha256((change["content"] or "").encode()).hexdigest():
        return "content"
    return None


def judge(batch: list[dict], versions: dict[str, int]) -> list[tuple]:
    """JUDGED of one batch in order of idx; ``versions`` takes its versions if all its changes hold.

    The first faulty change names the reason for all; only if none is faulty,
    the first that isn't above its path's current version does. A watcher's
    version 0 is the current one and one more.
    """
    batch = sorted(batch, key=lambda c: c["idx"])
    reason = next((x for x in map(fault, batch) if x), None)
    new: dict[str, int] = {}
    found: list[int | None] = []
    for c in batch:
        current = versions.get(c["path"], 0)
        version = current + 1 if not c["version"] and c["source"] == WATCHER else c["version"] or 0
        found.append(None if c["kind"] == "delete" else version)
        if c["kind"] != "delete":
            reason = reason or ("version" if version < 1 else "stale" if version <= current else None)
            new[c["path"]] = max(version, new.get(c["path"], 0))
    if reason is None:
        versions.update(new)
    return [(c["repo"], c["number"], c["idx"], reason is None, reason, v if reason is None else None) for c, v in zip(batch, found, strict=True)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["repo", "number", "idx", "accepted", "reason", "version"])
    return out.astype({"number": "int64", "idx": "int64", "accepted": "bool", "version": "Int64"})


def _records(batch: pd.DataFrame) -> list[dict]:
    return batch[FIELDS].astype(object).where(batch[FIELDS].notna(), None).to_dict("records")


def atomic_batches(changes: DataFrame) -> DataFrame:
    """JUDGED, a row for each change. Tasks read their repositories' batches in order and hold one batch and the versions of one repository at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repo, versions, held = None, {}, []
        for part in parts:
            out = []
            for c in _records(part):
                if held and (c["repo"], c["number"]) != (held[0]["repo"], held[0]["number"]):
                    out += judge(held, versions)
                    held = []
                if c["repo"] != repo:
                    repo, versions = c["repo"], {}
                held.append(c)
            yield _frame(out)
        if held:
            yield _frame(judge(held, versions))

    return changes.select(*FIELDS).repartition("repo").sortWithinPartitions("repo", "number", "idx").mapInPandas(run, JUDGED)


def atomic_stream(changes: DataFrame) -> DataFrame:
    """``atomic_batches`` over a stream, whatever the order and the cuts in which changes come.

    A repository's state is its versions, the number of its next batch, and the
    changes that wait, as their batch or one before it isn't whole; repeats of
    a change that waits or was judged are dropped.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        versions, following, waiting = (json.loads(state.get[0]), state.get[1], json.loads(state.get[2])) if state.exists else ({}, 1, {})
        for part in parts:
            for c in _records(part):
                if c["number"] >= following:
                    waiting.setdefault(str(c["number"]), {})[str(c["idx"])] = c
        out = []
        while (batch := waiting.get(str(following))) and len(batch) == next(iter(batch.values()))["size"]:
            out += judge(list(waiting.pop(str(following)).values()), versions)
            following += 1
        state.update((json.dumps(versions), following, json.dumps(waiting)))
        yield _frame(out)

    return changes.select(*FIELDS).groupBy("repo").applyInPandasWithState(run, JUDGED, "versions string, following long, waiting string", "append", GroupStateTimeout.NoTimeout)
