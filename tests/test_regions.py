"""Regions, merges and anchors by hand-made cases; empty tables."""

import hashlib

from pyspark.sql import functions as F

from tracewell.operators import anchors, regions

STEP = "flow long, ordinal long, kind string, invocation_id string, effect boolean, guard_condition string, name string, path string, symbol string, file_hash string, byte_start long, byte_end long"
EDGE = "flow long, step_ordinal long, target_ordinal long, kind string, resolution_status string, condition_step long, outcome string, conditions long"


def steps_of(flow, kinds, **more):
    out = []
    for i, kind in enumerate(kinds, 1):
        own = {"invocation": "i", "effect": False, "guard": None, "name": f"n{i}", "a": 100 * i, "b": 100 * i + 50} | more.get(f"s{i}", {})
        out.append((flow, i, kind, own["invocation"], own["effect"], own["guard"], own["name"], "p", "s", "h", own["a"], own["b"]))
    return out


def edges_of(flow, ways):
    """Ways by source: one target, or a pair for truthy and falsy."""
    out = []
    for a, to in ways.items():
        if isinstance(to, tuple):
            out += [(flow, a, b, "control_flow", "resolved", a, o, 1) for b, o in zip(to, ("truthy", "falsy"), strict=True)]
        else:
            out += [(flow, a, b, "control_flow", "resolved", None, None, 0) for b in (to if isinstance(to, list) else [to])]
    return out


def test_alternatives(spark):
    c, b = "call", "branch"
    cases = {
        1: ([b, c, c, c], {1: (2, 3), 2: 4, 3: 4}),  # one condition
        2: ([b, c, b, c, c, c], {1: (2, 3), 2: 6, 3: (4, 5), 4: 6, 5: 6}),  # a chain of two
        3: ([b, b, c, c, c], {1: (2, 4), 2: (3, 4), 3: 4, 4: 5}),  # a decision in a body: only the inner one
        4: ([b, c, c, c], {1: (2, 3), 3: 4}),  # one branch ends: no join
        5: ([c, b, c, c, c], {1: [2, 3], 2: (3, 4), 3: 5, 4: 5}),  # a way into a body
        6: ([b, "external_effect", c, c], {1: (2, 3), 2: 4, 3: 4}),
        7: ([b, c, c, c], {1: (2, 3), 2: 4, 3: 4}),  # a request needs a body's step
        8: ([b, c, c, c], {1: (2, 3), 2: 4, 3: 4}),  # a frame reaches over the join
        9: ([b, c, c, b, c, c, c], {1: (2, 3), 2: 4, 3: 4, 4: (5, 6), 5: 7, 6: 7}),  # one after another
        10: ([b, c, c, c], {1: (2, 3), 2: 4, 3: [4, 1]}),  # a loop back to the first step stays inside
        11: ([b, c, c, c, c], {1: (2, 3), 2: [4, 5], 3: 4, 4: 5}),  # a way over the join: the next one holds
        12: ([b, c, c, c], {1: (2, 3), 2: 4, 3: 4}),  # another invocation in a body
        13: ([b, c, c, c, c], {1: (2, 4), 2: 4, 4: 5}),  # a step that nothing reaches
    }
    steps = [s for f, (kinds, _) in cases.items() for s in steps_of(f, kinds, **({"s2": {"invocation": "j"}} if f == 12 else {}))]
    edges = [e for f, (_, ways) in cases.items() for e in edges_of(f, ways)]
    df = spark.createDataFrame(steps, STEP)
    frames = df.select("flow", F.expr("if(flow = 8 and ordinal = 4, 3, ordinal)").alias("frame"), "ordinal", F.lit("verified").alias("status"))
    out = regions.alternatives(df, spark.createDataFrame(edges, EDGE), frames, df.filter("flow = 7 and ordinal = 3"))
    assert sorted((r.flow, r.first, r.join, r.conditions, r.frames) for r in out.collect()) == [(1, 1, 4, 1, 3), (2, 1, 6, 2, 5), (3, 2, 4, 1, 2), (9, 1, 4, 1, 3), (9, 4, 7, 1, 3), (10, 1, 4, 1, 3), (11, 1, 5, 1, 4)]
    none = df.limit(0)
    assert regions.alternatives(none, spark.createDataFrame([], EDGE), frames.limit(0), none).count() == 0


def test_segments(spark):
    kinds = ["mutation", "call", "await", "call", "branch", "call", "call", "mutation"]
    around = {"s3": {"a": 200, "b": 400}, "s1": {"name": "let total = 1"}, "s6": {"guard": "x"}, "s7": {"guard": "x"}}
    whole = steps_of(1, kinds, **around)
    late = steps_of(2, ["mutation", "mutation", "call", "await", "call"], s4={"a": 300, "b": 500}, s2={"name": "const sum = f()"})
    fails = steps_of(3, ["mutation", "mutation", "call", "await", "failure"], s4={"a": 300, "b": 500})
    outside = steps_of(4, ["mutation", "mutation", "call", "await", "call"], s4={"a": 300, "b": 500}, s2={"invocation": "j"})
    ways = {i: i + 1 for i in range(1, 8)}
    edges = [e for f in (1, 2, 3, 4) for e in edges_of(f, ways | ({5: (6, 7)} if f == 1 else {}))]
    df = spark.createDataFrame(whole + late + fails + outside, STEP)
    frames = df.select("flow", F.col("ordinal").alias("frame"), "ordinal", F.expr("if(ordinal = 4, 'partial', 'verified')").alias("status"))
    out = regions.segments(df, spark.createDataFrame(edges, EDGE), frames)
    got = sorted((r.flow, r.first, r.end, r.kind, r.primary, r.title, r.status) for r in out.collect())
    assert got == [
        (1, 2, 5, "operation", 2, "n2", "partial"), (1, 5, 8, "decision", 5, "n5", "verified"),
        (2, 1, 3, "preparation", 2, "sum 준비", "verified"), (2, 3, None, "operation", 3, "n3", "partial"),
        (3, 1, 3, "preparation", 1, "n1", "verified"), (4, 3, None, "operation", 3, "n3", "partial"),
    ]


def test_merges_in_a_row(spark):
    log = spark.createDataFrame([(1, 0, 4, 3), (1, 1, 3, 2), (1, 2, 2, 1), (1, 1, 6, 5), (1, 1, 5, 5), (2, 0, 9, 8)], "flow long, round int, frame long, into long")
    assert sorted(tuple(r) for r in regions.survivors(log).collect()) == [(1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 6, 5), (2, 9, 8)]
    limits = spark.createDataFrame([(1, 4, "invocation_unproven"), (1, 2, "invocation_unproven"), (1, 4, "grouping_evidence_missing"), (1, 5, "grouping_evidence_missing"), (1, 7, "grouping_evidence_missing"), (2, 8, "grouping_evidence_missing")], "flow long, frame long, code string")
    assert sorted(tuple(r) for r in regions.carried(limits, log).collect()) == [(1, 1, "invocation_unproven"), (1, 7, "grouping_evidence_missing"), (2, 8, "grouping_evidence_missing")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_anchors_of_one_snapshot(spark):
    body = "int load(int a) {\n  return {1};\n}"
    docs = spark.createDataFrame([("r", "s", "a.dart", f"// é\n{body}\n", "1"), ("r", "t", "a.dart", "x", "1"), ("q", "s", "a.dart", "y", "1"), ("r", "s", "b.dart", f"//\n//\n{body}", "2"), ("r", "s", "c.dart", None, "3")], "repo_id string, snapshot_id string, path string, content string, revision_id string")
    rows = [("r", "s", "a.dart", 6, 6 + len(body), "x", sha(body), "A.load"), ("r", "t", "a.dart", 6, 9, "x", sha(body), "A.load"), ("r", "s", "gone.dart", 0, 3, "x", sha(body), "A.load"), ("r", "s", "b.dart", 0, 3, "x", sha(body), "A.load"), ("r", "s", "c.dart", 0, 3, None, None, None), (None, "s", "a.dart", None, None, None, None, "A.load")]
    df = spark.createDataFrame(rows, "repo_id string, snapshot_id string, path string, byte_start long, byte_end long, file_hash string, span_hash string, symbol string")
    got = {(r.snapshot_id, r.path): (r.freshness, r.moved_path, r.moved_start) for r in anchors.freshness(df, docs).filter("repo_id = 'r'").collect()}
    assert got == {("s", "a.dart"): ("fresh", None, None), ("t", "a.dart"): ("orphaned", None, None), ("s", "gone.dart"): ("orphaned", "a.dart", 6), ("s", "b.dart"): ("fresh", "b.dart", 6), ("s", "c.dart"): ("orphaned", None, None)}
    moved = {(r.snapshot_id, r.path): (r.status, r.new_start, r.new_end) for r in anchors.reanchor(df, docs).filter("repo_id = 'r'").collect()}
    assert moved["s", "b.dart"] == ("adjusted", 6, 6 + len("int load(int a) {")) and moved["s", "a.dart"][0] == "verified" and moved["s", "gone.dart"] == ("unknown_boundary", 0, 3)
    assert anchors.freshness(df.limit(0), docs).count() == 0 and anchors.check(df, docs.limit(0)).filter("reason is null").count() == 0
    assert anchors.balanced_end(b"a {b {c}} d") == 9 and anchors.balanced_end(b"} {") is None and anchors.balanced_end(b"{{}") is None and anchors.balanced_end("é{}".encode(), 2) == 4
