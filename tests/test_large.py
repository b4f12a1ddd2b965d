"""What is written on the way, counted, and results of the ways that write less."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import candidates as C
from tracewell.operators import graph as H
from tracewell.operators import meaning as N
from tracewell.operators import store


@pytest.fixture
def written(monkeypatch):
    """Rows of the tables that an operator writes to cut lineage."""
    counts, cut = [], H._cut

    def counted(df, *folder):
        out = cut(df, *folder)
        counts.append(out.count())
        return out

    monkeypatch.setattr(H, "_cut", counted)
    return counts


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def calls_of(spark, pairs):
    rng = random.Random(5)
    return spark.createDataFrame([(a, b, rng.randrange(9), rng.choice(["verified"] * 3 + ["dynamic"])) for a, b in sorted(pairs)], "caller string, callee string, idx int, status string")


def test_call_tree_is_not_written_whole(spark, written):
    calls = spark.createDataFrame([("a", f"b{i}") for i in range(30)] + [(f"b{i}", f"c{j}") for i in range(30) for j in range(30)] + [("c0", "a"), ("b0", "a")], "caller string, callee string")
    out = H.expand_calls(calls.filter("caller = 'a'").select(F.col("caller").alias("node")).distinct(), calls, 2)
    assert out.count() == 1 + 30 + 901 and max(written) <= calls.count()
    got = {tuple(r.path): (r.cycle, r.truncated) for r in out.collect()}
    assert got["a", "b0", "a"] == (True, False) and got["a", "b1", "c0"] == (False, True) and got["a", "b1", "c1"] == (False, False) and got["a",] == (False, False)
    assert H.expand_calls(spark.createDataFrame([("c1",), ("a",)], "node string"), calls, 0).filter("truncated").count() == 1


@pytest.mark.parametrize("most", [1, 1000])
def test_reach_in_passes(spark, written, monkeypatch, most):
    rng = random.Random(3)
    edges = spark.createDataFrame([(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(150)], "source string, target string")
    roots = spark.createDataFrame([(f"r{i}", f"n{i}") for i in range(40)] + [("r0", "n5"), ("r1", "x")], "root string, node string")
    want = rows(H.reachable(roots, edges), "root", "node", "depth")
    monkeypatch.setattr(store, "MAX_ROWS", most)
    monkeypatch.setattr(store, "PASSES", 2)
    written.clear()
    assert rows(H.reachable_in_passes(roots, edges), "root", "node", "depth") == want
    assert max(written) < (0.7 if most == 1 else 1.1) * len(want)


def test_claims_follow_no_edge_in_vain(spark, written):
    hub = {("b0", f"c{i}") for i in range(300)} | {("b1", f"c{i}") for i in range(300)} | {("a", "b0"), ("a", "b1")}
    calls = spark.createDataFrame([(a, b, i, "verified") for i, (a, b) in enumerate(sorted(hub))], "caller string, callee string, idx int, status string")
    steps = spark.createDataFrame([(f"c{i}", "db:x", None) for i in range(300)], "node string, effect string, state string")
    out = N.impact_effects(spark.createDataFrame([("a", "a")], "root string, node string"), calls, steps, 2, 10)
    assert out.count() == 7 and sum(written) < 60


@pytest.mark.parametrize("budget", [1, 2, 5, 40])
def test_claims_are_those_of_the_whole_walk(spark, budget):
    rng = random.Random(budget)
    calls = calls_of(spark, {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(200)})
    roots = spark.createDataFrame([(f"r{i}", f"n{i}") for i in range(40)] + [("r0", "n7"), ("r0", "n8")], "root string, node string")
    assert rows(H.impact_claims(roots, calls, 3, budget), "root", "node", "depth", "parent") == rows(H.impact(roots, calls, 3, budget)[0], "root", "node", "depth", "parent")


def counted_rows(df):
    """The most rows that a join of the plan made."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName():
            found.append(p.metrics().apply("numOutputRows").value())
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return max(found)


def test_names_are_counted_not_paired(spark):
    c = spark.range(400).select(F.concat(F.lit("f"), F.col("id")).alias("flow_id"), F.concat(F.lit("e"), F.col("id")).alias("entry_symbol_path"), F.when(F.col("id") < 300, "Same").alias("derived_name"))
    q = spark.range(400).select(F.col("id").alias("query_id"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("flow_id"), F.lit("SAME").alias("text"))
    out = C.resolve_target(q, c)
    assert counted_rows(out) <= 800
    assert rows(out.distinct(), "status", "n")[0] == ("ambiguous", 300) and out.count() == 400


def test_equal_queries_and_texts_are_verified_once(spark, monkeypatch):
    sizes, kept = [], C.save
    monkeypatch.setattr(C, "save", lambda df: sizes.append(df.count()) or kept(df))
    c = spark.range(60).select(F.col("id").alias("candidate_id"), F.when(F.col("id") < 50, "red ring").otherwise("blue bolt").alias("name"))
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["RED  ring", "red ring", "ed", " ", "zq", "b", None, "ring red"] * 3)], "query_id int, query string")
    got = rows(C.literal_hits(c, q, ["name"]), "query_id", "candidate_id", "status")
    want = []
    for i, t in enumerate(["RED  ring", "red ring", "ed", " ", "zq", "b", None, "ring red"] * 3):
        terms = (t or "").lower().split()
        hits = [k for k in range(60) if terms and all(x in ("red ring" if k < 50 else "blue bolt") for x in terms)]
        want += [(i, k, "matched") for k in hits] or [(i, None, "no_literal_match" if terms else "empty_query")]
    assert got == sorted(want, key=repr) and sizes == [4]
