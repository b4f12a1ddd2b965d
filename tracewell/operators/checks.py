"""Checks of roles, entries, projections, evidence, alignments and publications, as joins and conditional columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import has_any

# Kinds of steps that may have a role; other roles look at edges and unknowns.
ROLE_KINDS = {"decision": ["guard", "branch", "decision"], "transform": ["mutation"], "state_change": ["mutation"], "handoff": ["call", "await", "break", "continue"], "outcome": ["return", "throw", "mutation", "external_effect"]}
# Whose evidence counts.
AUTHORITIES = ["code", "test", "contract", "runtime"]
# Purposes of decisions, the words of rules that show them, and those of names.
RULE_WORDS = {"auth": ["auth", "permission", "credential", "role", "access"], "limit": ["limit", "quota", "rate", "balance"], "validation": ["validation", "validate", "verify", "schema"], "precondition": ["precondition", "status", "ready", "state_check"]}
NAME_WORDS = {
    "auth": ["permission", "authorize", "role", "credential", "access", "forbidden", "unauthorized", "allow", "token", "authenticate", "권한", "인증", "인가", "접근", "토큰"],
    "limit": ["limit", "quota", "rate", "threshold", "balance", "amount", "budget", "한도", "잔액", "초과"],
    "validation": ["validate", "valid", "schema", "format", "required", "verify", "검증", "유효", "형식", "누락"],
    "precondition": ["ready", "init", "state", "status", "enabled", "active", "상태", "준비", "활성"],
}


def first_of(rules: dict[str, Column]) -> Column:
    """The name of the first condition that holds; null if none does. Null conditions don't hold."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])


def all_of(rules: dict[str, Column]) -> Column:
    """The names of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))


def role_check(steps: DataFrame, edges: DataFrame, unknowns: DataFrame) -> DataFrame:
    """``steps`` (flow, ordinal, kind, value_role, role) with valid: whether a step may have the role by which it was read back.

    The first step is the entry. Effects need an effect or a resolved edge to
    the outside, boundaries an unresolved edge, a passed callback or an
    unknown (flow, ordinal). Unknown roles aren't valid.
    """
    resolved = F.col("resolution_status") == "resolved"
    out = edges.groupBy("flow", F.col("step_ordinal").alias("ordinal")).agg(F.bool_or(resolved & edges["kind"].isin("external", "async")).alias("_out"), F.bool_or(~resolved | (edges["kind"] == "callback_argument")).alias("_open"))
    rows = steps.join(out, ["flow", "ordinal"], "left").join(unknowns.select("flow", "ordinal", F.lit(True).alias("_dark")).distinct(), ["flow", "ordinal"], "left")
    first = F.col("ordinal") == F.min("ordinal").over(_by("flow"))
    by_kind = reduce(or_, [(F.col("role") == role) & F.col("kind").isin(*kinds) for role, kinds in ROLE_KINDS.items()])
    local = (F.col("role") == "state_change") & F.col("value_role").eqNullSafe("local_binding")
    effect = (F.col("role") == "effect") & ((F.col("kind") == "external_effect") | F.coalesce("_out", F.lit(False)))
    boundary = (F.col("role") == "boundary") & (F.coalesce("_open", F.lit(False)) | F.coalesce("_dark", F.lit(False)))
    return rows.withColumn("valid", F.coalesce(F.when(first, F.col("role") == "entry").otherwise((by_kind & ~local) | effect | boundary), F.lit(False))).drop("_out", "_open", "_dark")


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def entry_attach(resolutions: DataFrame, documents: DataFrame) -> DataFrame:
    """``resolutions`` with error, null where the anchor of the entry may be attached.

    A resolution (entry, n_evidence, path, symbol, byte_start, byte_end,
    file_hash, span_hash) needs one evidence row, the path and symbol of its
    entry, a range inside the snapshot's content (path, content), and the
    hashes of the file and of the range.
    """
    raw = F.encode("_content", "UTF-8")
    span = F.substring(raw, F.col("byte_start").cast("int") + 1, (F.col("byte_end") - F.col("byte_start")).cast("int"))
    rows = resolutions.join(documents.select("path", F.col("content").alias("_content")), "path", "left")
    rules = {
        "evidence_count": F.coalesce(F.col("n_evidence"), F.lit(0)) != 1,
        "symbol": ~F.col("entry").eqNullSafe(F.concat("path", F.lit("#"), "symbol")),
        "range": F.col("_content").isNull() | ~F.coalesce((F.col("byte_start") >= 0) & (F.col("byte_end") > F.col("byte_start")) & (F.col("byte_end") <= F.octet_length(raw)), F.lit(False)),
        "hash": ~(F.col("file_hash").eqNullSafe(F.sha2(raw, 256)) & F.col("span_hash").eqNullSafe(F.sha2(span, 256))),
    }
    return rows.withColumn("error", first_of(rules)).drop("_content")


def projection_refs(projections: DataFrame, maps: DataFrame, steps: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(map, kind, ref, rule): references of a projection that its map lacks, and projections of another generation or basis.

    projections: map, generation, basis, kind (visible, preserved, fold_entry,
    fold_exit or boundary), ref; maps: map, generation, basis; steps and
    boundaries: map, ref. Empty ends of folds refer to nothing.
    """
    m = maps.select("map", F.col("generation").alias("_g"), F.col("basis").alias("_b"))
    known = steps.select("map", "ref", F.lit("step").alias("_of")).union(boundaries.select("map", "ref", F.lit("boundary"))).distinct()
    rows = projections.withColumn("_of", F.when(F.col("kind") == "boundary", "boundary").otherwise("step"))
    rows = rows.join(m, "map", "left").join(known.withColumn("_known", F.lit(True)), ["map", "ref", "_of"], "left")
    nothing = F.col("kind").isin("fold_entry", "fold_exit") & (F.coalesce("ref", F.lit("")) == "")
    rule = first_of({"no_map": F.col("_g").isNull(), "basis": ~(F.col("_g").eqNullSafe(F.col("generation")) & F.col("_b").eqNullSafe(F.col("basis"))), "unknown_ref": F.col("_known").isNull() & ~nothing})
    return rows.select("map", "kind", "ref", rule.alias("rule")).filter("rule is not null")


def impact_evidence(evidence: DataFrame, maps: DataFrame) -> DataFrame:
    """``evidence`` with valid: named, verified, of the map's basis and snapshot, at a path inside the repository, with a range of bytes and of lines."""
    path = F.regexp_replace(F.coalesce(F.col("path"), F.lit("")), r"^(\./)+", "")
    inside = ~path.isin("", ".", "..") & ~path.rlike(r"^(/|\.\./)")
    named = (F.coalesce("evidence_id", F.lit("")) != "") & (F.trim(F.coalesce("kind", F.lit(""))) != "")
    same = (F.col("basis") == F.col("_b")) & (F.col("snapshot") == F.col("_s"))
    ranges = (F.col("byte_start") >= 0) & (F.col("byte_end") > F.col("byte_start")) & (F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start"))
    good = named & (F.col("validation") == "verified") & same & inside & F.col("authority").isin(*AUTHORITIES) & ranges
    rows = evidence.join(maps.select("map", F.col("basis").alias("_b"), F.col("snapshot").alias("_s")), "map", "left")
    return rows.withColumn("valid", F.coalesce(good, F.lit(False))).drop("_b", "_s")


def decision_purpose_v1(rules: Column, text: Column) -> Column:
    """auth, limit, validation or precondition, by the words of the rules, else by those of the text; empty if none or several show."""
    low = F.transform(F.coalesce(rules, F.expr("cast(array() as array<string>)")), F.lower)
    shows = lambda words: F.exists(low, lambda r: has_any(r, *words))
    by_rule = all_of({p: shows(words) for p, words in RULE_WORDS.items()})
    name = F.lower(F.coalesce(text, F.lit("")))
    by_name = all_of({p: has_any(name, *words) for p, words in NAME_WORDS.items()})
    found = F.when(F.size(by_rule) > 0, by_rule).otherwise(by_name)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("")


def alignment_status(criteria: DataFrame, matches: DataFrame, refs: DataFrame, evidence: DataFrame, basis: str, analysed: bool = True) -> DataFrame:
    """(criterion_id, steps, status, missing): how far a criterion is implemented, as far as evidence of this basis says.

    criteria: criterion_id, required (kinds); matches: criterion_id, step;
    refs: step, evidence_id; evidence: evidence_id, kind, authority, basis,
    validation. No step is not_observed (unknown where nothing was analysed);
    steps without evidence are unknown; evidence of another authority or in
    conflict is conflicting; anything else is partial, with what is missing:
    at the least the current runtime proof.
    """
    own = matches.select("criterion_id", "step").distinct()
    steps = own.groupBy("criterion_id").agg(F.count("*").alias("steps"))
    seen = own.join(refs.filter("coalesce(evidence_id, '') <> ''"), "step").select("criterion_id", "evidence_id").distinct()
    rows = seen.join(evidence.withColumn("_known", F.lit(True)), "evidence_id", "left")
    verified = F.col("validation").eqNullSafe("verified")
    odd = F.col("_known") & (~F.coalesce(F.col("authority").isin(*AUTHORITIES), F.lit(False)) | F.coalesce(F.col("validation").isin("conflicting", "invalid"), F.lit(False)))
    old = F.col("_known").isNull() | ~F.col("basis").eqNullSafe(basis) | ~(verified | F.coalesce(F.col("validation").isin("conflicting", "invalid"), F.lit(False)))
    by = rows.groupBy("criterion_id").agg(F.count("*").alias("refs"), F.bool_or(F.coalesce(odd, F.lit(False))).alias("odd"), F.bool_or(old).alias("old"), F.collect_set(F.when(verified, F.col("kind"))).alias("kinds"))
    out = criteria.select("criterion_id", F.coalesce("required", F.expr("cast(array() as array<string>)")).alias("required")).join(steps, "criterion_id", "left").join(by, "criterion_id", "left")
    lacking = F.array_sort(F.transform(F.array_except("required", F.coalesce("kinds", F.expr("cast(array() as array<string>)"))), lambda k: F.concat(F.lit("evidence_kind:"), k)))
    of = lambda *names: F.array(*[F.lit(n) for n in names])
    nothing, bare = F.col("steps").isNull(), F.col("refs").isNull()
    status = F.when(nothing, F.lit("not_observed" if analysed else "unknown")).when(bare, "unknown").when(F.col("odd"), "conflicting").otherwise("partial")
    missing = (
        F.when(nothing, of("implementation_step", "current_runtime_proof")).when(bare, of("verified_evidence", "test_evidence", "contract_evidence", "current_runtime_proof"))
        .when(F.col("odd"), F.expr("cast(array() as array<string>)")).when(F.col("old"), of("fresh_basis_evidence")).when(F.size(lacking) > 0, lacking).otherwise(of("current_runtime_proof"))
    )
    return out.select("criterion_id", F.coalesce("steps", F.lit(0)).alias("steps"), status.alias("status"), missing.alias("missing"))


def _differ(a: str, b: str) -> str:
    """SQL: one is empty or they aren't equal."""
    return f"coalesce({a}, '') = '' or not ({a} <=> {b})"


#: Gates of a publication: what fails each, as SQL over a row of a map joined with its snapshot, closure, delta and intent.
GATE_RULES: dict[str, dict[str, str]] = {
    "snapshot": {
        "snapshot_identity": _differ("snapshot_id", "captured_snapshot"),
        "basis_identity": _differ("basis_id", "captured_basis"),
        "tree_identity": _differ("tree_id", "captured_tree"),
        "dependency_identity": _differ("dependency", "captured_dependency"),
        "epoch_identity": "not (epoch <=> captured_epoch) or not (live_epoch <=> captured_epoch) or captured_epoch < 0",
        "repository_identity": _differ("repository", "captured_repository"),
        "worktree_identity": _differ("worktree", "captured_worktree"),
        "delta_binding": "not (delta_from <=> captured_snapshot) or not (delta_to <=> live_snapshot)",
    },
    "closure": {
        "read_set_identity": _differ("read_set", "closure_read_set"),
        "closure_basis": "not (closure_basis <=> basis_id) or not (closure_intent <=> intent_revision)",
        "query_identity": _differ("closure_query", "query_hash"),
        "digest_binding": _differ("closure_digest", "derived_digest"),
        "closure_open": "not (closure_status <=> 'closed')",
        "delta_intersects": "coalesce(changed_inside, 0) > 0",
        "delta_dimension": "coalesce(membership_changed or index_changed or resolution_changed or capability_changed or configuration_changed or contract_changed, false)",
    },
    "evidence": {
        "no_evidence": "coalesce(n_steps, 0) = 0 or coalesce(n_evidence, 0) = 0",
        "evidence_binding": "coalesce(n_unbound, 0) > 0",
        "duplicate_evidence": "coalesce(n_evidence_twice, 0) > 0",
        "step_without_evidence": "coalesce(n_bare, 0) > 0",
        "unknown_evidence": "coalesce(n_unknown_refs, 0) > 0",
    },
    "atomicity": {
        "duplicate_step": "coalesce(n_steps_twice, 0) > 0",
        "edge_outside": "coalesce(n_edges_outside, 0) > 0",
        "generation_identity": _differ("generation_id", "expected_generation"),
        "same_generation": "generation_id = previous_generation",
        "artifact_digest": "coalesce(n_digests, 0) = 0 or coalesce(n_bad_digests, 0) > 0",
    },
    "relevance": {"intent_binding": "intent_status <=> 'needs_confirmation' or " + _differ("task_id", "intent_task") + " or not (mode <=> intent_mode)", "no_query": "trim(coalesce(query_hash, '')) = ''"},
    "comprehension": {"summary": "coalesce(requested, '') = '' or coalesce(current, '') = ''"},
}


def map_counts(steps: DataFrame, edges: DataFrame, refs: DataFrame, evidence: DataFrame, maps: DataFrame) -> DataFrame:
    """``maps`` (map, snapshot_id, basis_id, ...) with the counts that the evidence and atomicity gates read.

    steps: map, step, path; edges: map, from_step, to_step; refs: map, step,
    evidence_id; evidence: map, evidence_id, validation, snapshot, basis.
    """
    s = steps.groupBy("map", "step").agg(F.count("*").alias("n"), F.max(F.coalesce("path", F.lit(""))).alias("path"))
    known = evidence.groupBy("map", "evidence_id").agg(F.count("*").alias("n"))
    bound = evidence.join(maps.select("map", "snapshot_id", "basis_id"), "map")
    loose = bound.groupBy("map").agg(F.count("*").alias("n_evidence"), F.count_if((F.coalesce("evidence_id", F.lit("")) == "") | ~F.col("validation").eqNullSafe("verified") | ~F.col("snapshot").eqNullSafe(F.col("snapshot_id")) | ((F.coalesce("basis", F.lit("")) != "") & (F.col("basis") != F.col("basis_id")))).alias("n_unbound"))
    has = refs.join(known.select("map", "evidence_id", F.lit(True).alias("_k")), ["map", "evidence_id"], "left").groupBy("map", "step").agg(F.count("*").alias("r"), F.count_if(F.col("_k").isNull()).alias("u"))
    by = s.join(has, ["map", "step"], "left").groupBy("map").agg(F.sum("n").alias("n_steps"), F.count_if(F.col("n") > 1).alias("n_steps_twice"), F.count_if(F.col("r").isNull() | (F.col("path") == "")).alias("n_bare"), F.sum(F.coalesce("u", F.lit(0))).alias("n_unknown_refs"))
    a, b = (s.select("map", F.col("step").alias(c), F.lit(True).alias(f"_{c}")) for c in ("from_step", "to_step"))
    out = edges.join(a, ["map", "from_step"], "left").join(b, ["map", "to_step"], "left").groupBy("map").agg(F.count_if(F.col("_from_step").isNull() | F.col("_to_step").isNull()).alias("n_edges_outside"))
    twice = known.filter("n > 1").groupBy("map").agg(F.count("*").alias("n_evidence_twice"))
    for counts in (by, loose, twice, out):
        maps = maps.join(counts, "map", "left")
    return maps


def publication_gates(maps: DataFrame, rules: dict[str, dict[str, str]] = GATE_RULES) -> DataFrame:
    """``maps`` with failed (gates in order), causes (of all gates, in order) and passed. Columns that a rule names must be there."""
    causes = [all_of({cause: F.expr(test) for cause, test in of.items()}) for of in rules.values()]
    out = maps.withColumn("_causes", F.array(*causes))
    out = out.withColumn("failed", all_of({gate: F.size(F.col("_causes")[i]) > 0 for i, gate in enumerate(rules)})).withColumn("causes", F.flatten("_causes")).drop("_causes")
    return out.withColumn("passed", F.size("failed") == 0)


def closure_status(observations: DataFrame, required: DataFrame) -> DataFrame:
    """(closure, measured, status, reasons): the names that a closure's measured observations have, in order, and whether those required are among them.

    observations: closure, category, kind, measured; required: closure, name.
    An observation of its category's own kind (or of source_membership, in
    membership) has the category's name, any other that of its kind. A closure
    is closed if nothing required is missing, else open, with a reason for
    each missing name. Null or empty kinds have no name.
    """
    own = (F.col("kind") == F.col("category")) | ((F.col("category") == "membership") & (F.col("kind") == "source_membership"))
    name = F.when(own, F.col("category")).otherwise(F.nullif("kind", F.lit("")))
    seen = observations.filter("measured").groupBy("closure").agg(F.array_sort(F.collect_set(name)).alias("measured"))
    want = required.groupBy("closure").agg(F.array_sort(F.collect_set("name")).alias("required"))
    none = F.expr("cast(array() as array<string>)")
    rows = observations.select("closure").union(required.select("closure")).distinct().join(seen, "closure", "left").join(want, "closure", "left")
    rows = rows.select("closure", F.coalesce("measured", none).alias("measured"), F.coalesce("required", none).alias("required"))
    missing = F.array_except("required", "measured")
    return rows.select("closure", "measured", F.when(F.size(missing) == 0, "closed").otherwise("open").alias("status"), F.transform(missing, lambda n: F.concat(F.lit("not_measured:"), n)).alias("reasons"))
