"""Streams against their batch twins: shuffled input, restarts, state that ends."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from tracewell.streaming import batches, live, twins


def run(spark, df, where, name, mode="append"):
    q = df.writeStream.format("parquet" if where else "memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{where}/ck").option("path", f"{where}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def rows_of(df, *columns):
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in df.select(*columns).collect()), key=repr)


CHANGE = "repo string, number long, size long, idx long, source string, kind string, path string, old_path string, version long, content string, content_id string"


def changes(n=60):
    rng, rows = random.Random(6), []
    for repo in "ab":
        for number in range(1, n + 1):
            size = rng.randint(1, 4)
            source = rng.choice(["editor", "agent", "watcher_fallback", "watcher_fallback", "other"])
            for idx in range(size):
                rows.append((repo, number, size, idx, source, rng.choice(["create", "upsert", "delete", "rename"] * 12 + ["touch"]), rng.choice(["p", "q", "r", "../x"] if rng.random() < 0.05 else ["p", "q", "r"]), rng.choice(["p", "o", "o"]), rng.choice([0, number // 2, number, number - 2]), "t", rng.choice([None] * 20 + ["bad"])))
    return rows


def test_atomic_stream_equals_batch_on_shuffled_input_with_a_restart(spark, tmp_path):
    rows = changes()
    df = spark.createDataFrame(rows, CHANGE)
    want = rows_of(batches.atomic_batches(df), *batches.JUDGED.replace(" string", "").replace(" long", "").replace(" boolean", "").split(", "))
    by_loop, versions = [], {}
    for r in sorted(rows):
        versions.setdefault(r[0], {})
    for repo, number in sorted({(r[0], r[1]) for r in rows}):
        by_loop += batches.judge([dict(zip(batches.FIELDS, r, strict=True)) for r in rows if r[:2] == (repo, number)], versions[repo])
    assert want == sorted(by_loop, key=repr) and {r[4] for r in want} >= {None, "source", "kind", "path", "content", "stale", "version"}
    random.Random(1).shuffle(rows)
    src = tmp_path / "in"
    src.mkdir()
    stream = batches.atomic_stream(spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(src)))
    for k in range(2):  # the second run goes on from the first one's checkpoint
        half = rows[k::2] + (rows[:5] if k else [])
        spark.createDataFrame(half, CHANGE).repartition(3).write.mode("append").parquet(str(src))
        run(spark, stream, str(tmp_path), f"atomic{k}")
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), "repo", "number", "idx", "accepted", "reason", "version") == want


@pytest.mark.parametrize("order", [1, -1])
def test_transactions(spark, tmp_path, order):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("done", 1, "edit", None, at(0)), ("done", 2, "edit", None, at(1)), ("done", 3, "commit", 2, at(2)), ("gone", 4, "edit", None, at(1)), ("gone", 5, "abort", None, at(3)), ("open", 6, "edit", None, at(2)), ("lacks", 7, "commit", 3, at(2)), ("lacks", 8, "edit", None, at(2))]
    schema = "txn string, seq long, kind string, size long, ts timestamp"
    src = tmp_path / "in"
    src.mkdir()
    stream = live.txn_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)), 10.0, "1 minute")
    for k, part in enumerate([rows[::order][:4], rows[::order][4:], [("later", 9, "edit", None, at(500))], [("later", 10, "edit", None, at(501))]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = run(spark, stream, str(tmp_path), f"txn{order}{k}".replace("-", "m"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), "txn", "outcome", "edits") == [("done", "committed", 2), ("gone", "aborted", 1 if order == 1 else 0), ("lacks", "expired", 1), ("open", "expired", 1)]
    assert sum(p.stateOperators[0].numRowsTotal for p in q.recentProgress[-1:]) == 1  # only the transaction that is open


def test_epochs(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, s, rng.choice("xyz") if rng.random() < 0.5 else None, None) for k in (1, 2) for s in range(40)]
    rows = [(k, s, i, None if i else rng.randint(0, 12)) for k, s, i, _ in rows]
    schema = "key long, seq long, identity string, result_epoch long"
    want = rows_of(twins.settled(spark.createDataFrame(rows, schema)), "key", "seq", "epoch", "accepted")
    assert {r[3] for r in want} == {True, False} and max(r[2] for r in want) > 5
    src = tmp_path / "in"
    src.mkdir()
    stream = live.epoch_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
    for k in range(4):
        spark.createDataFrame([r for r in rows if k * 10 <= r[1] < k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(src))
        run(spark, stream, str(tmp_path), f"epochs{k}")
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), "key", "seq", "epoch", "accepted") == want


def test_timeline(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    seen = [("t1", 1, "f", "timeout", at(10)), ("t1", 2, "g", "retry", at(20)), ("t1", 3, "f", "retry", at(300)), ("t2", 4, "none", "circuit_break", at(30))]
    nodes = [("f", at(5)), ("g", at(100)), ("f", at(12))]
    o, n = "trace string, seq long, symbol string, kind string, ts timestamp", "symbol string, seen timestamp"
    want = rows_of(twins.timeline(spark.createDataFrame(seen, o), spark.createDataFrame(nodes, n), "30 seconds"), "trace", "seq", "kind", "source")
    assert [r[3] for r in want] == ["corroborated", "corroborated", "runtime", "runtime", "runtime"]
    a, b = tmp_path / "o", tmp_path / "n"
    a.mkdir()
    b.mkdir()
    stream = live.timeline_stream(spark.readStream.schema(o).parquet(str(a)), spark.readStream.schema(n).parquet(str(b)), "30 seconds")
    for k, (x, y) in enumerate([(seen[:2], nodes[:1]), (seen[2:], nodes[1:]), ([("end", 9, "z", "timeout", at(9000))], [("z9", at(9000))]), ([("end", 10, "z", "timeout", at(9001))], [("z9", at(9001))])]):
        spark.createDataFrame(x, o).coalesce(1).write.mode("append").parquet(str(a))
        spark.createDataFrame(y, n).coalesce(1).write.mode("append").parquet(str(b))
        run(spark, stream, str(tmp_path), f"timeline{k}")
    assert rows_of(spark.read.parquet(str(tmp_path / "out")).filter("trace <> 'end'"), "trace", "seq", "kind", "source") == want
