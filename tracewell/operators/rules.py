"""Rule checks over sets of rows, and the gates they feed. Each violation is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def execution_refs(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow, rule, at): duplicate ordinals, edges from or to no step, edges between invocations that don't cross files, returns with a later edge."""
    key = steps.groupBy("flow", "ordinal").agg(F.count("*").alias("n"), F.min("invocation_id").alias("inv"), F.min("kind").alias("kind"))
    out = key.filter("n > 1").select("flow", F.lit("duplicate_ordinal").alias("rule"), F.col("ordinal").alias("at"))
    e = edges.select("flow", "edge_idx", "step_ordinal", "target_ordinal", F.col("kind").alias("edge_kind"))
    a = key.select("flow", F.col("ordinal").alias("step_ordinal"), F.col("inv").alias("from_inv"), F.col("kind").alias("from_kind"))
    b = key.select("flow", F.col("ordinal").alias("target_ordinal"), F.col("inv").alias("to_inv"))
    joined = e.join(a, ["flow", "step_ordinal"], "left").join(b, ["flow", "target_ordinal"], "left")
    checks = {
        "source_missing": F.col("from_kind").isNull(),
        "target_missing": F.col("target_ordinal").isNotNull() & F.col("to_inv").isNull(),
        "crosses_invocation": (F.col("from_inv") != F.col("to_inv")) & ~F.col("edge_kind").isin("resolved_cross_file", "return", "callback_argument"),
        "after_return": (F.col("from_kind") == "return") & (F.col("edge_kind") == "sequence"),
    }
    found = joined.select("flow", F.col("edge_idx").alias("at"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("rule"))
    return out.unionByName(found)


def assignment_refs(steps: DataFrame) -> DataFrame:
    """(flow, ordinal) of steps whose assignment source isn't an earlier step of the same file whose bytes lie inside theirs."""
    src = steps.select("flow", F.col("ordinal").alias("assign_source"), F.col("byte_start").alias("_a"), F.col("byte_end").alias("_b"), F.col("file_hash").alias("_h"))
    rows = steps.filter("assign_source is not null").join(src, ["flow", "assign_source"], "left")
    good = (F.col("_a") >= F.col("byte_start")) & (F.col("_b") <= F.col("byte_end")) & F.col("_h").eqNullSafe(F.col("file_hash")) & (F.col("assign_source") < F.col("ordinal"))
    return rows.filter(~F.coalesce(good, F.lit(False))).select("flow", "ordinal")


def sequence_refs(frames: DataFrame, steps: DataFrame) -> DataFrame:
    """(flow, ordinal, rule): steps in no frame or in several, members that are no steps, frames out of reading order."""
    member = frames.groupBy("flow", "ordinal").agg(F.count("*").alias("n"))
    both = steps.select("flow", "ordinal", F.lit(True).alias("_s")).join(member, ["flow", "ordinal"], "full_outer")
    rule = F.when(F.col("n").isNull(), "uncovered").when(F.col("_s").isNull(), "unknown_step").when(F.col("n") > 1, "shared")
    out = both.select("flow", "ordinal", rule.alias("rule")).filter("rule is not null")
    w = Window.partitionBy("flow").orderBy("frame", "ordinal")
    late = frames.withColumn("_p", F.lag("ordinal").over(w)).filter(F.col("_p") > F.col("ordinal")).select("flow", "ordinal", F.lit("order").alias("rule"))
    return out.unionByName(late)


def size_caps(steps: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """(flow, what, n) of flows with more than ``most`` steps or edges."""
    count = lambda df, what: df.groupBy("flow").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("flow", F.lit(what).alias("what"), "n")
    return count(steps, "steps").unionByName(count(edges, "edges"))


def read_set(documents: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``documents`` with the first rule that the snapshot's entry breaks: missing, content, version or length."""
    s = snapshot.select("path", F.col("content_id").alias("_c"), F.col("version").alias("_v"), F.col("byte_length").alias("_l"))
    rule = F.when(F.col("_c").isNull(), "missing").when(F.col("_c") != F.col("content_id"), "content").when(F.col("_v") != F.col("version"), "version").when(F.col("_l") != F.col("byte_length"), "length")
    return documents.join(s, "path", "left").withColumn("rule", rule).drop("_c", "_v", "_l")


def publication_gate(maps: DataFrame, gates: dict[str, str]) -> DataFrame:
    """``maps`` with passed and causes: the names of the gates (SQL conditions) that don't hold, in order."""
    causes = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in gates.items()]))
    return maps.withColumn("causes", causes).withColumn("passed", F.size("causes") == 0)


def refinement_check(maps: DataFrame, digests: list[str]) -> DataFrame:
    """(basis, first, later, allowed): a later map of a basis may replace the first only if no digest differs."""
    w = Window.partitionBy("basis").orderBy("seq")
    rows = maps.withColumn("_first", F.first(F.struct("seq", *digests)).over(w)).filter(F.col("seq") > F.col("_first.seq"))
    same = F.lit(True)
    for d in digests:
        same &= F.col(d).eqNullSafe(F.col(f"_first.{d}"))
    return rows.select("basis", F.col("_first.seq").alias("first"), F.col("seq").alias("later"), same.alias("allowed"))


# Which decision may follow which state.
TRANSITIONS = {"approve": ["", "reject"], "reject": ["approve"], "draft": ["", "approve", "reject", "draft"]}


def approval_history(events: DataFrame) -> DataFrame:
    """(subject, seq, rule): decisions that may not follow the one before; note rows don't count."""
    w = Window.partitionBy("subject").orderBy("seq")
    rows = events.filter(F.col("kind").isin(*TRANSITIONS)).withColumn("_before", F.coalesce(F.lag("kind").over(w), F.lit("")))
    bad = F.lit(False)
    for kind, ok in TRANSITIONS.items():
        bad |= (F.col("kind") == kind) & ~F.col("_before").isin(*ok)
    return rows.filter(bad).select("subject", "seq", F.concat("_before", F.lit(">"), "kind").alias("rule"))


def metric_report(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(scenario, rule): repeated measures, values that aren't finite, and p95 over the scenario's threshold."""
    by = rows.groupBy("scenario").agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs"), F.bool_or(F.isnan("value") | F.col("value").isNull()).alias("odd"), F.expr("percentile(value, 0.95)").alias("p95")).join(thresholds, "scenario", "left")
    rules = {"duplicate_run": F.col("n") > F.col("runs"), "not_finite": F.col("odd"), "over_threshold": F.coalesce(F.col("p95") > F.col("most"), F.lit(False))}
    return by.select("scenario", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("rule"))


def settlement(obligations: DataFrame) -> DataFrame:
    """(map, gate, blocking): pending before stage Q3, failed if something blocks, else passed."""
    by = obligations.groupBy("map").agg(F.max("stage").alias("stage"), F.array_sort(F.collect_list(F.when(F.col("state").isin("blocking", "unresolved", "conflicting"), F.col("ref")))).alias("open"))
    gate = F.when(~F.col("stage").isin("Q3", "Q4"), "pending").when(F.size("open") > 0, "failed").otherwise("passed")
    return by.select("map", gate.alias("gate"), F.size("open").cast("long").alias("blocking"))
