"""Comparison of two generations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, modified and deleted paths of two snapshots (path, content_id)."""
    a, b = before.select("path", F.col("content_id").alias("old")), after.select("path", F.col("content_id").alias("new"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change"), "old", "new").filter("change is not null")


def renames(delta: DataFrame) -> DataFrame:
    """(old_path, new_path): deleted paths whose content one added path alone has."""
    added = delta.filter("change = 'added'").groupBy(F.col("new").alias("content_id")).agg(F.count("*").alias("n"), F.min("path").alias("new_path")).filter("n = 1")
    gone = delta.filter("change = 'deleted'").select(F.col("old").alias("content_id"), F.col("path").alias("old_path"))
    return gone.join(added, "content_id").select("old_path", "new_path")


def delta_flags(delta: DataFrame) -> DataFrame:
    """One row: whether members, resolution (lock files), sources or configuration changed."""
    from tracewell.functions.text import path_class

    kind = path_class(F.col("path"))
    return delta.agg(
        F.coalesce(F.bool_or(F.col("change") != "modified"), F.lit(False)).alias("membership"), F.coalesce(F.bool_or(kind["resolver"]), F.lit(False)).alias("resolution"), F.coalesce(F.bool_or(kind["source"]), F.lit(False)).alias("index"), F.coalesce(F.bool_or(kind["config"]), F.lit(False)).alias("configuration")
    )


def flow_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(symbol, change) of two specs (symbol, ordinal, name, kind); of a repeated symbol the last step counts."""
    last = lambda df, p: df.groupBy("symbol").agg(F.max_by(F.struct("name", "kind"), "ordinal").alias(p))
    both = last(before, "a").join(last(after, "b"), "symbol", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return both.select("symbol", change.alias("change")).filter("change is not null")


def comparable(headers: DataFrame) -> DataFrame:
    """``headers`` (a and b as structs) with the first reason why they can't be compared; null if they can."""
    reason = F.when(F.col("a.generation").isNull() | F.col("b.generation").isNull(), "identity_missing")
    for c in ("schema", "repo", "mode", "task", "epoch"):
        reason = reason.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c)
    return headers.withColumn("reason", reason)


def semantic_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(step, change): steps (id, structure, behavior, evidence) matched by id, then by a structure that is unique on both sides.

    A match differs in behavior, then in evidence, then only in structure; what
    has several structural partners is ambiguous. Ids are matched before
    structures, in two passes, whatever the steps' order.
    """
    cols = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "structure", "behavior", "evidence")))
    a, b = cols(before, "a"), cols(after, "b")
    by_id = a.join(b, F.col("a_id") == F.col("b_id"))
    rest_a, rest_b = a.join(b, F.col("a_id") == F.col("b_id"), "left_anti"), b.join(a, F.col("a_id") == F.col("b_id"), "left_anti")
    na = rest_a.groupBy("a_structure").agg(F.count("*").alias("na"))
    nb = rest_b.groupBy("b_structure").agg(F.count("*").alias("nb"))
    counts = na.join(nb, F.col("a_structure") == F.col("b_structure"))
    alone = counts.filter("na = 1 and nb = 1").select(F.col("a_structure").alias("s"))
    several = counts.filter("na > 1 or nb > 1").select(F.col("a_structure").alias("s"))
    matched = by_id.unionByName(rest_a.join(alone, F.col("a_structure") == F.col("s")).drop("s").join(rest_b, F.col("a_structure") == F.col("b_structure")))
    change = F.when(~F.col("a_behavior").eqNullSafe(F.col("b_behavior")), "changed_rule").when(~F.col("a_evidence").eqNullSafe(F.col("b_evidence")), "evidence_updated").when((F.col("a_id") != F.col("b_id")) | ~F.col("a_structure").eqNullSafe(F.col("b_structure")), "structural_only")
    out = matched.select(F.col("b_id").alias("step"), change.alias("change")).filter("change is not null")
    seen = alone.union(several)
    for rows, c, kind in ((rest_a, "a", "removed_behavior"), (rest_b, "b", "added_behavior")):
        out = out.union(rows.join(seen, F.col(f"{c}_structure") == F.col("s"), "left_anti").select(F.col(f"{c}_id"), F.lit(kind)))
        out = out.union(rows.join(several, F.col(f"{c}_structure") == F.col("s"), "left_semi").select(F.col(f"{c}_id"), F.lit("ambiguous_move")))
    return out


def relation_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source, target, change) of relations (source, target, seq, state); of a repeated relation the last counts."""
    last = lambda df, p: df.groupBy("source", "target").agg(F.max_by("state", "seq").alias(p))
    both = last(before, "a").withColumn("in_a", F.lit(True)).join(last(after, "b").withColumn("in_b", F.lit(True)), ["source", "target"], "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("source", "target", change.alias("change")).filter("change is not null")


def change_facets(pairs: DataFrame, facets: dict[str, tuple[str, str]]) -> DataFrame:
    """``pairs`` with facets: the names of those whose two columns differ (null equals null), in order."""
    each = [F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(name)) for name, (a, b) in facets.items()]
    return pairs.withColumn("facets", F.array_compact(F.array(*each)))


def already_applied(changes: DataFrame, head: DataFrame) -> DataFrame:
    """(batch, applied): whether the head has every change of a batch (batch, path, content_id; null is a removal)."""
    h = head.select("path", F.col("content_id").alias("_head"))
    rows = changes.join(h, "path", "left")
    return rows.groupBy("batch").agg(F.bool_and(F.col("content_id").eqNullSafe(F.col("_head"))).alias("applied"))
