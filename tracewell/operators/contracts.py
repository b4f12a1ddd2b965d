"""Rules of smaller contracts: deltas of snapshots, impact maps, frames, traces, catalogs, roots of change batches, alignments from criteria to proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import path_class
from tracewell.operators.checks import AUTHORITIES, alignment_status
from tracewell.operators.fuse import criterion_matches


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _broken(rows: DataFrame, checks: dict[str, Column], *columns: str) -> DataFrame:
    """A row for each of ``checks`` that holds."""
    return rows.select(*columns, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))).alias("rule"))


def delta_dimensions(delta: DataFrame, settings: DataFrame) -> DataFrame:
    """(repo, membership, resolution, index, configuration, contract): what a repository's changed paths (repo, path, change) may have changed.

    change is added, modified, deleted or renamed (a row for either path). Lock
    and configuration files change resolution and configuration; sources the
    index and, as they may declare what others use, the public contract.
    settings (repo, before, after) are fingerprints of the configuration.
    """
    kind = path_class(F.col("path"))
    own = delta.withColumn("_source", kind["source"]).withColumn("_resolver", kind["resolver"] & (F.col("change") != "renamed"))
    by = own.groupBy("repo").agg(F.bool_or(F.col("change") != "modified").alias("membership"), F.bool_or("_resolver").alias("resolution"), F.bool_or("_source").alias("index"))
    rows = settings.join(by, "repo", "full_outer").fillna(False, ["membership", "resolution", "index"])
    differs = F.coalesce(~F.col("before").eqNullSafe(F.col("after")), F.lit(False))
    return rows.select("repo", "membership", "resolution", "index", (F.col("resolution") | differs).alias("configuration"), F.col("index").alias("contract"))


def impact_map_rules(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(map, at, rule): steps without id, symbol or path, repeated steps; edges without an end, symbol or kind, to steps that aren't there, or to another symbol than the step's names (technical, enclosing)."""
    times = F.count("*").over(Window.partitionBy("map", "step"))
    found = _broken(steps.withColumn("_n", times), {"step_identity": _blank("step") | (_blank("technical") & _blank("enclosing")) | _blank("path"), "step_repeated": F.col("_n") > 1}, "map", F.col("step").alias("at")).distinct()
    ends = steps.groupBy("map", "step").agg(F.collect_set("technical").alias("_t"), F.collect_set("enclosing").alias("_e"))
    side = lambda at, name: ends.select("map", F.col("step").alias(at), F.struct("_t", "_e").alias(name))
    rows = edges.join(side("from_step", "_a"), ["map", "from_step"], "left").join(side("to_step", "_b"), ["map", "to_step"], "left")
    open_ = _blank("from_step") | _blank("to_step") | _blank("to_symbol") | _blank("kind") | F.col("_a").isNull() | F.col("_b").isNull()
    other = ~open_ & ~F.array_contains("_b._t", F.col("to_symbol")) & ~F.array_contains("_b._e", F.col("to_symbol"))
    return found.unionByName(_broken(rows, {"edge_unresolved": open_, "edge_symbol": other}, "map", F.col("edge").alias("at")))


def frame_rules(frames: DataFrame, members: DataFrame, steps: DataFrame, limits: DataFrame) -> DataFrame:
    """(flow, frame, rule) of frames (flow, frame, ordinal, status, primary) and their members (flow, frame, place, step) against steps (flow, step, position, verified, boundary).

    frame_ordinal: not its place; frame_empty; step_missing; step_shared: also
    in another frame or twice; children_order, frame_order: against the steps'
    positions; promoted: a verified frame with a step that isn't, or a
    boundary; primary: no member; limitation: of no frame, or twice (limits:
    flow, frame). Steps in no frame have a null frame: step_uncovered.
    """
    rank = F.row_number().over(Window.partitionBy("flow").orderBy("ordinal", "frame"))
    own = members.join(steps, ["flow", "step"], "left").withColumn("_n", F.count("*").over(Window.partitionBy("flow", "step")))
    own = own.withColumn("_before", F.lag("position").over(Window.partitionBy("flow", "frame").orderBy("place")))
    by = own.groupBy("flow", "frame").agg(
        F.bool_or(F.col("position").isNull()).alias("_missing"), F.bool_or(F.col("_n") > 1).alias("_shared"), F.bool_or(F.col("position") <= F.col("_before")).alias("_order"), F.min_by("position", "place").alias("_first"),
        F.bool_or(~F.coalesce("verified", F.lit(False)) | F.coalesce("boundary", F.lit(False))).alias("_weak"), F.collect_set("step").alias("_steps"),
    )
    rows = frames.withColumn("_rank", rank).join(by, ["flow", "frame"], "left").withColumn("_last", F.lag("_first").over(Window.partitionBy("flow").orderBy("ordinal", "frame")))
    some = F.col("_steps").isNotNull()
    checks = {
        "frame_ordinal": F.col("ordinal") != F.col("_rank"), "frame_empty": ~some, "step_missing": F.col("_missing"), "step_shared": F.col("_shared"), "children_order": F.col("_order"),
        "frame_order": F.col("_first") <= F.col("_last"), "promoted": (F.col("status") == "verified") & F.col("_weak"), "primary": some & ~F.coalesce(F.array_contains("_steps", F.col("primary")), F.lit(False)),
    }
    found = _broken(rows, checks, "flow", "frame")
    lost = steps.join(members.select("flow", "step").distinct(), ["flow", "step"], "left_anti").select("flow", F.lit(None).cast(frames.schema["frame"].dataType).alias("frame"), F.lit("step_uncovered").alias("rule")).distinct()
    named = limits.groupBy("flow", "frame").agg(F.count("*").alias("_n")).join(frames.select("flow", "frame", F.lit(True).alias("_f")).distinct(), ["flow", "frame"], "left")
    return found.unionByName(lost).unionByName(named.filter("_n > 1 or _f is null").select("flow", "frame", F.lit("limitation").alias("rule")))


def trace_rules(traces: DataFrame, nodes: DataFrame, observations: DataFrame) -> DataFrame:
    """(trace, at, rule): nodes seen at run time or corroborated without evidence, traces that hide a conflicting node, and observations with trusted local isolation that nobody approved."""
    bare = nodes.filter(F.col("status").isin("runtime_observed", "corroborated") & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0)).select("trace", F.col("node").alias("at"), F.lit("evidence_missing").alias("rule"))
    clash = nodes.filter("status = 'conflicting'").select("trace").distinct().join(traces.filter("not has_conflicts"), "trace").select("trace", F.lit(None).cast("string").alias("at"), F.lit("conflict_hidden").alias("rule"))
    loose = observations.filter("isolation = 'trusted_local' and approved is null").select("trace", F.col("observation").alias("at"), F.lit("approval_missing").alias("rule"))
    return bare.unionByName(clash).unionByName(loose)


def catalog(flows: DataFrame) -> DataFrame:
    """(domain, place, flow, rule) of representative flows (domain, flow, position, complexity, map, evidence): their place by complexity, then id, and the first rule each breaks: ungrounded, repeated or order."""
    flows = flows.withColumn("_n", F.row_number().over(Window.partitionBy("domain", "flow").orderBy("position")))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("complexity"), "flow", "position")).cast("long")
    before = Window.partitionBy("domain").orderBy("position")
    late = (F.col("complexity") > F.lag("complexity").over(before)) | ((F.col("complexity") == F.lag("complexity").over(before)) & (F.col("flow") < F.lag("flow").over(before)))
    rule = F.when(_blank("map") | (F.col("complexity") < 0) | (F.size("evidence") <= 0), "ungrounded").when(F.col("_n") > 1, "repeated").when(late, "order")
    return flows.withColumn("place", place).withColumn("rule", rule).select("domain", "place", "flow", "rule")


def batch_targets(batch: DataFrame, changes: DataFrame, steps: DataFrame, evidence: DataFrame) -> DataFrame:
    """(step) that a batch of revisions (path, revision) changed: targets of verified changes (step, to_step, validation, epistemic) whose file is in the batch and that have no evidence (step, revision), or some of a revision of the batch."""
    ref = F.when(_blank("to_step"), F.col("step")).otherwise(F.col("to_step"))
    hit = changes.filter("validation = 'verified' and coalesce(epistemic, '') not in ('unknown', 'unobserved')").select(ref.alias("step")).distinct()
    hit = hit.join(steps.join(batch.select("path").distinct(), "path", "left_semi").select("step").distinct(), "step", "left_semi")
    proven = evidence.join(batch.select("revision").distinct(), "revision", "left_semi").select("step").distinct()
    bare = hit.join(evidence.select("step").distinct(), "step", "left_anti")
    return bare.union(hit.join(proven, "step", "left_semi"))


def align(criteria: DataFrame, steps: DataFrame, refs: DataFrame, evidence: DataFrame, basis: str, snapshot: str, proofs: DataFrame) -> DataFrame:
    """(criterion_id, steps, status, reason): from criteria to status in one run: matching steps, what their evidence says, and promotion under a current proof.

    criteria have text and required, steps text and rules, refs and evidence
    as ``checks.alignment_status`` takes them, evidence a snapshot besides.
    proofs (basis, snapshot, passed) are of this map; one that passed for its
    basis and snapshot is current. A partial alignment that waits for nothing
    but the proof is confirmed under it, if all its evidence is verified, of
    an authority, and of this basis and snapshot; else it says what it lacks.
    """
    matches = criterion_matches(criteria, steps)
    status = alignment_status(criteria, matches, refs, evidence, basis)
    current = proofs.filter((F.col("basis") == basis) & (F.col("snapshot") == snapshot) & F.col("passed")).select(F.lit(True).alias("_proof")).limit(1)
    seen = matches.join(refs, "step").select("criterion_id", "evidence_id").distinct().join(evidence.withColumn("_there", F.lit(True)), "evidence_id", "left")
    good = F.col("_there") & (F.col("validation") == "verified") & F.col("authority").isin(*AUTHORITIES) & (F.col("basis") == basis) & (F.col("snapshot") == snapshot)
    whole = seen.groupBy("criterion_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("_whole"))
    rows = status.join(whole, "criterion_id", "left").join(F.broadcast(current), how="left")
    waits = (F.col("status") == "partial") & (F.array_join("missing", ",") == "current_runtime_proof")
    proved, complete = F.coalesce("_proof", F.lit(False)), F.coalesce("_whole", F.lit(False))
    reason = F.when(waits & ~proved, "current_proof_mismatch").when(waits & ~complete, "current_evidence_incomplete")
    return rows.select("criterion_id", "steps", F.when(waits & proved & complete, "confirmed").otherwise(F.col("status")).alias("status"), reason.alias("reason"))
