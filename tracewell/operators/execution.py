"""Rules of execution facts: invocations and their callers, branch outcomes, loops, waits, failures, completions. Each violation is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.rules import assignment_refs

# Kinds of edges inside an invocation, and outcomes of a branch.
INSIDE = ("control_flow", "parallel_wait", "await_resume", "await_loop_back", "failure", "finally", "switch_exit", "loop_back", "loop_reentry", "loop_exit", "loop_exit_back")
CONDITIONED = ("control_flow", "loop_back", "loop_reentry")
OUTCOMES = ("truthy", "falsy", "nullish", "non_nullish")


def step_rules(steps: DataFrame) -> DataFrame:
    """(flow, rule, at) of steps: repeated or small ordinals, odd value roles, callers without an invocation, invocations of several places or with a caller that can't be, assignment sources that are missing or don't lie inside."""
    same = Window.partitionBy("flow", "ordinal")
    place = F.struct("symbol", "path", F.coalesce("caller_ordinal", F.lit(-1)))
    own = steps.withColumn("_n", F.count("*").over(same))
    checks = {
        "step_ordinal": (F.col("_n") > 1) | (F.col("ordinal") < 1),
        "value_role": (F.coalesce("value_role", F.lit("")) != "") & ((F.col("value_role") != "local_binding") | (F.col("kind") != "mutation")),
        "caller_without_invocation": F.col("invocation_id").isNull() & F.col("caller_ordinal").isNotNull(),
    }
    found = own.select("flow", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("rule"), F.col("ordinal").alias("at")).distinct()
    groups = steps.filter("invocation_id is not null").groupBy("flow", "invocation_id").agg(F.min("ordinal").alias("at"), F.min_by("caller_ordinal", "ordinal").alias("caller"), F.countDistinct(place).alias("_places"))
    split = groups.filter("_places > 1").select("flow", F.lit("invocation_inconsistent").alias("rule"), "at")
    callers = steps.select("flow", F.col("ordinal").alias("caller"), F.col("invocation_id").alias("_from"), F.lit(True).alias("_there"))
    entered = groups.filter("caller is not null").join(callers, ["flow", "caller"], "left").filter("_there is null or _from is null or _from = invocation_id or caller >= at")
    missing = steps.filter("assign_source is not null").join(steps.select("flow", F.col("ordinal").alias("assign_source")), ["flow", "assign_source"], "left_anti").select("flow", F.lit("assignment_missing").alias("rule"), F.col("ordinal").alias("at"))
    outside = assignment_refs(steps).select("flow", F.lit("assignment_source").alias("rule"), F.col("ordinal").alias("at")).join(missing.select("flow", "at"), ["flow", "at"], "left_anti")
    return found.unionByName(split).unionByName(entered.select("flow", F.lit("caller_invalid").alias("rule"), "at")).unionByName(missing).unionByName(outside)


def ends(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """``edges`` with structs of their source a, target b and deciding step d, the source's caller c, and the first step of the source's and target's invocations."""
    first = steps.filter("invocation_id is not null").groupBy("flow", "invocation_id").agg(F.min("ordinal").alias("entry"))
    fields = F.struct("ordinal", "kind", "invocation_id", "caller_ordinal", "symbol", "path", "byte_start", "byte_end", "entry")
    one = steps.join(first, ["flow", "invocation_id"], "left").groupBy("flow", "ordinal").agg(F.min(fields).alias("_s"))
    side = lambda at, name: one.select("flow", F.col("ordinal").alias(at), F.col("_s").alias(name))
    rows = edges.join(side("step_ordinal", "a"), ["flow", "step_ordinal"], "left").join(side("target_ordinal", "b"), ["flow", "target_ordinal"], "left").join(side("condition_step", "d"), ["flow", "condition_step"], "left")
    return rows.withColumn("_caller", F.col("a.caller_ordinal")).join(side("_caller", "c"), ["flow", "_caller"], "left").drop("_caller")


def edge_rules(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow, rule, at): the first rule that an edge breaks, at its number.

    edges have conditions (how many), condition_step and outcome (of the first),
    to_symbol and unresolved_reason. A passed callback enters an invocation
    without caller that lies in its source. A condition belongs to the edge's
    own branch or guard. A return leads from an invocation whose caller is
    known to have entered it, to where that call goes on. Inside an invocation,
    breaks leave loops and switches, continues go back, awaits resume, throws
    fail, and completed steps lead nowhere but to finally and failure. A throw
    may be caught by the caller. Other edges with a target enter it from its
    caller.
    """
    solved = edges.filter("resolution_status = 'resolved'")
    calls = solved.filter("kind = 'resolved_cross_file'").select("flow", F.col("step_ordinal").alias("_call"), F.col("target_ordinal").alias("_entry")).distinct()
    goes = solved.filter("kind = 'control_flow' and conditions = 0").select("flow", F.col("step_ordinal").alias("_call"), F.col("target_ordinal").alias("_next")).distinct()
    rows = ends(edges, steps).withColumn("_call", F.col("c.ordinal")).withColumn("_entry", F.col("a.entry")).withColumn("_next", F.col("b.ordinal"))
    rows = rows.join(calls.withColumn("_called", F.lit(True)), ["flow", "_call", "_entry"], "left").join(goes.withColumn("_continued", F.lit(True)), ["flow", "_call", "_next"], "left")

    no = lambda c: ~F.coalesce(c, F.lit(False))  # noqa: E731  a rule that isn't known to hold is broken
    kind, open_ = F.col("kind"), F.col("resolution_status") != "resolved"
    both = F.col("step_ordinal").isNotNull() & F.col("target_ordinal").isNotNull()
    named = F.col("to_symbol") == F.concat("b.path", F.lit("#"), "b.symbol")
    later, earlier = F.col("b.ordinal") > F.col("a.ordinal"), F.col("b.ordinal") < F.col("a.ordinal")
    a_kind, b_kind = F.col("a.kind"), F.col("b.kind")
    across = (kind == "failure") & (F.col("a.invocation_id").isNotNull() | F.col("b.invocation_id").isNotNull()) & F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("a.invocation_id").eqNullSafe(F.col("b.invocation_id"))
    into_caller = (F.col("c.kind") == "call") & F.col("c.invocation_id").eqNullSafe(F.col("b.invocation_id")) & (F.col("b.ordinal") > F.col("c.ordinal"))
    callback = (F.col("a.invocation_id") != F.col("b.invocation_id")) & F.col("b.caller_ordinal").isNull() & (F.col("b.entry") == F.col("b.ordinal")) & (F.col("a.path") == F.col("b.path")) & (F.col("a.symbol") == F.col("b.symbol")) & named & (F.col("a.byte_start") <= F.col("b.byte_start")) & (F.col("a.byte_end") >= F.col("b.byte_end"))
    inside = (F.col("a.invocation_id") == F.col("b.invocation_id")) & (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.path") == F.col("b.path")) & named & ~open_
    post = (kind == "loop_back") & (a_kind == "continue") & (b_kind == "mutation") & (F.col("b.byte_end") > F.col("b.byte_start")) & (F.col("b.byte_end") <= F.col("a.byte_start"))

    def first(*rules: tuple[str, Column]) -> Column:
        return F.coalesce(*(F.when(c, F.lit(n)) for n, c in rules))

    wrong_condition = first(
        ("condition_relation", ~kind.isin(*CONDITIONED) | F.col("step_ordinal").isNull() | (F.col("conditions") != 1)),
        ("condition_reference", no((F.col("condition_step") == F.col("step_ordinal")) & F.col("d.kind").isin("branch", "guard") & F.col("outcome").isin(*OUTCOMES))),
    )
    passed = first(("callback_incomplete", ~both | open_ | (F.col("conditions") > 0) | (F.coalesce("unresolved_reason", F.lit("")) != "")), ("callback_reference", no(callback)))
    returned = first(
        ("return_incomplete", ~both | open_),
        ("return_without_caller", no((a_kind == "return") & F.col("b").isNotNull() & F.col("a.invocation_id").isNotNull() & F.col("a.caller_ordinal").isNotNull())),
        ("return_continuation", no(into_caller & ~F.col("b.invocation_id").eqNullSafe(F.col("a.invocation_id")) & named)),
        ("return_unmatched", no(F.col("_called") & F.col("_continued"))),
    )
    caught = first(
        ("throw_recovery", no((a_kind == "throw") & F.col("a.invocation_id").isNotNull() & F.col("a.caller_ordinal").isNotNull() & F.col("b.invocation_id").isNotNull() & ~open_ & named)),
        ("throw_not_in_caller", no(into_caller & ~F.col("c.invocation_id").eqNullSafe(F.col("a.invocation_id")))),
        ("throw_without_call", no(F.col("_called"))),
    )
    moved = first(
        ("flow_endpoints", no(inside)),
        ("loop_transfer", (kind.isin("loop_exit", "loop_exit_back", "switch_exit") != (a_kind == "break")) | ((a_kind == "continue") & (kind != "loop_back"))),
        ("exit_order", kind.isin("loop_exit", "switch_exit") & ~later),
        ("exit_to_itself", (kind == "loop_exit_back") & (F.col("b.ordinal") == F.col("a.ordinal"))),
        ("loop_back_order", kind.isin("loop_back", "await_loop_back", "loop_exit_back") & later & ~post),
        ("loop_reentry", (kind == "loop_reentry") & no((a_kind == "branch") & earlier & (F.col("conditions") == 1) & (F.col("outcome") == "truthy"))),
        ("await_source", kind.isin("await_resume", "await_loop_back") & (a_kind != "await")),
        ("parallel_wait", (kind == "parallel_wait") & ~((a_kind == "call") & (b_kind == "await") & later)),
        ("await_completion", (a_kind == "await") & ~kind.isin("await_resume", "await_loop_back", "failure")),
        ("failure_source", (kind == "failure") & ~a_kind.isin("await", "throw")),
        ("finally_source", (kind == "finally") & ~a_kind.isin("return", "throw")),
        ("flow_after_completion", a_kind.isin("return", "throw") & ~kind.isin("finally", "failure")),
    )
    entered = first(("target_invalid", no((F.col("b.entry") == F.col("b.ordinal")) & named)), ("target_caller", no((F.col("step_ordinal") == F.col("b.caller_ordinal")) & ~open_)))
    plain = F.when(kind == "return", returned).when(kind.isin(*INSIDE), F.when(~both, "flow_incomplete").when(across, caught).otherwise(moved)).when(F.col("target_ordinal").isNotNull(), entered)
    rule = F.when(kind == "callback_argument", passed).otherwise(F.coalesce(F.when(F.col("conditions") > 0, wrong_condition), plain))
    return rows.select("flow", rule.alias("rule"), F.col("edge_idx").alias("at")).filter("rule is not null")


def collected_rules(edges: DataFrame) -> DataFrame:
    """(flow, rule, at) of calls across files that newly collected facts must resolve on both sides."""
    open_ = edges.filter("kind = 'resolved_cross_file' and (step_ordinal is null or target_ordinal is null or resolution_status <> 'resolved')")
    return open_.select("flow", F.lit("call_unconfirmed").alias("rule"), F.col("edge_idx").alias("at"))
