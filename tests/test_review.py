"""Signatures, limitations and reviews: small hand-written cases."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import review as R

SOURCE = "import 'a';\n\nclass Store {\n  /// loads\n  Future<void> load(\n    int id,\n  )\n  async {\n    if (id > 0) {\n      send();\n    }\n  }\n  void stop() {\n  }\n}"


@pytest.mark.parametrize(
    ("content", "offset", "line", "hint", "want"),
    [
        (SOURCE, 0, 3, "", (3, "class Store {")),
        (SOURCE, 0, 10, "load", (5, "Future<void> load( int id, )")),
        (SOURCE, 0, 10, "stop", (13, "void stop() {")),
        (SOURCE, 0, 10, "none", (3, "class Store {")),
        (SOURCE, SOURCE.index("send"), 1, "", (10, "send();")),
        (SOURCE, 0, 99, "load", (0, "")),
        ("", 0, 1, "x", (0, "")),
        (None, 0, 1, "x", (0, "")),
        ("é\nvoid a(\n" + "int aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa,\n" * 9, 3, 1, None, (2, ("void a( " + "int aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa, " * 4)[:200] + "…")),
        ("x" * (R.SCAN_BYTES + 1), 0, 1, "x", (0, "")),
        ("{\n}", 0, None, "a", (1, "{")),
    ],
)
def test_signature(spark, content, offset, line, hint, want):
    df = spark.createDataFrame([(content, offset, line, hint)], "content string, byte_offset int, line_hint int, symbol_hint string")
    r = R.signatures(df).first()
    assert (r.line, r.signature) == want


@pytest.mark.parametrize(("line", "heads"), [("void a(", True), ("(", False), ("if (", False), ("class A {", True), ("} else if (x) {", False), ("for (;;) {", False), ("a(b) {", True), ("x; a() {", False), ("// a() {", False), ("a {", False), ("do {", False), ("", False)])
def test_opens_declaration(spark, line, heads):
    assert spark.createDataFrame([(line,)], "l string").select(R.opens_declaration(F.col("l")).alias("h")).first().h is heads


def test_limitations(spark):
    steps = spark.createDataFrame(
        [(1, 1, "call", "a", None), (1, 2, "mutation", "b", 1), (1, 3, "mutation", "b", 1), (1, 4, "mutation", "c", 9), (1, 5, "mutation", None, None), (2, 1, "call", None, None), (2, 2, "call", "z", None)],
        "flow int, ordinal int, kind string, invocation_id string, caller_ordinal int",
    ).withColumns({"path": F.lit("p"), "symbol": F.lit("s")})
    edges = spark.createDataFrame([(1, 1, 2, "resolved_cross_file"), (1, 2, 3, "control_flow"), (1, 3, 4, "control_flow"), (1, 1, 4, "resolved_cross_file")], "flow int, step_ordinal int, target_ordinal int, kind string").withColumns({"resolution_status": F.lit("resolved"), "condition": F.lit(None).cast("string")})
    frames = steps.select("flow", F.col("ordinal").alias("frame"), F.lit("process").alias("role"), "ordinal")
    found = R.limitations(frames, steps, edges, steps.select("flow", "ordinal").limit(0), steps.filter("flow = 2").select("flow"))
    assert sorted(map(tuple, found.collect())) == [(1, 2, "grouping_evidence_missing"), (1, 3, "grouping_evidence_missing"), (1, 4, "invocation_unproven"), (2, 1, "request_relevance_unproven"), (2, 2, "request_relevance_unproven")]
    assert R.limitations(frames.limit(0), steps.limit(0), edges.limit(0), steps.select("flow", "ordinal").limit(0), steps.select("flow").limit(0)).collect() == []


def test_renumber_and_nullish_fork(spark):
    from tracewell.operators import folds as M

    rows = [(1, "call", 0, 5, "entry"), (2, "branch", 10, 12, "decision"), (3, "return", 10, 20, "process"), (4, "call", 30, 35, "process")]
    steps = spark.createDataFrame(rows, "ordinal int, kind string, byte_start int, byte_end int, role string").withColumns(
        {"flow": F.lit(1), "invocation_id": F.lit("i"), "path": F.lit("p"), "symbol": F.lit("s"), "file_hash": F.lit("h"), "status": F.lit("verified"), "boundary": F.lit(False), "effect": F.lit(False), "single": F.lit(True), "state_after": F.lit(None).cast("string"), "guard_condition": F.lit(None).cast("string")}
    )
    edge = lambda a, b, step, outcome: (1, a, b, "control_flow", "resolved", step, outcome)
    names = "flow int, step_ordinal int, target_ordinal int, kind string, resolution_status string, condition_step int, outcome string"
    edges = [edge(1, 2, None, None), edge(2, 3, 2, "nullish"), edge(2, 3, 2, "non_nullish")]
    merged = M.merge_expressions(steps, spark.createDataFrame(edges, names))
    assert sorted(map(tuple, merged.select("ordinal", "into", "role", "status").collect())) == [(2, 2, "decision", "verified"), (3, 2, "decision", "verified")]
    frames = M.renumber(steps.select("flow", F.col("ordinal").alias("frame"), "ordinal"), merged)
    assert sorted((r.ordinal, r.frame) for r in frames.collect()) == [(1, 1), (2, 2), (3, 2), (4, 3)]
    assert M.merge_expressions(steps, spark.createDataFrame(edges[:2], names)).collect() == []
    assert M.merge_expressions(steps.limit(0), spark.createDataFrame([], names)).collect() == []
