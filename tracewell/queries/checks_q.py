"""Queries over role, entry, projection, evidence, alignment and publication checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import checks as K
from tracewell.queries.registry import query

_ROLES = ["entry", "decision", "transform", "state_change", "effect", "handoff", "outcome", "boundary", "other"]


@query("role_check", "v_step v_edge", f"""
WITH o AS (SELECT flow, step_ordinal AS ordinal, bool_or(resolution_status = 'resolved' AND kind = 'external') AS fx, bool_or(resolution_status <> 'resolved' OR kind = 'callback_argument') AS op FROM v_edge GROUP BY 1, 2),
s AS (SELECT flow, ordinal, kind, partkey, ({_ROLES!r})[partkey % 9 + 1] AS role FROM v_step)
SELECT flow, ordinal, role, CASE WHEN ordinal = 1 THEN role = 'entry' ELSE CASE role
  WHEN 'decision' THEN kind IN ('guard', 'branch', 'decision') WHEN 'transform' THEN kind = 'mutation' WHEN 'state_change' THEN kind = 'mutation' AND partkey % 2 <> 0
  WHEN 'effect' THEN kind = 'external_effect' OR coalesce(fx, false) WHEN 'handoff' THEN kind IN ('call', 'await') WHEN 'outcome' THEN kind IN ('return', 'mutation', 'external_effect')
  WHEN 'boundary' THEN coalesce(op, false) OR partkey % 13 = 0 ELSE false END END AS valid FROM s LEFT JOIN o USING (flow, ordinal)""")
def role_check(v):
    role = F.get(F.array(*[F.lit(r) for r in _ROLES]), F.expr("int(partkey % 9)"))
    steps = v["v_step"].withColumn("role", role).withColumn("value_role", F.expr("if(partkey % 2 = 0, 'local_binding', null)"))
    return K.role_check(steps, v["v_edge"], steps.filter("partkey % 13 = 0").select("flow", "ordinal")).select("flow", "ordinal", "role", "valid")


@query("entry_attach", "v_doc", """
SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'evidence_count' WHEN doc_id % 7 = 2 THEN 'symbol' WHEN doc_id % 7 = 3 OR coalesce(strlen(content), 0) = 0 THEN 'range' WHEN doc_id % 7 IN (4, 5) THEN 'hash' END AS error FROM v_doc""")
def entry_attach(v):
    size = F.octet_length(F.encode(F.coalesce("content", F.lit("")), "UTF-8"))
    wrong = lambda n, bad, good: F.when(F.col("doc_id") % 7 == n, bad).otherwise(good)
    rows = v["v_doc"].select(
        "doc_id", "path", F.concat("path", F.lit("#"), wrong(2, F.lit("Other.run"), F.lit("Main.run"))).alias("entry"), wrong(1, F.lit(2), F.lit(1)).alias("n_evidence"), F.lit("Main.run").alias("symbol"), F.lit(0).alias("byte_start"),
        wrong(3, size + 1, size).alias("byte_end"), wrong(4, F.lit("x"), F.sha2("content", 256)).alias("file_hash"), wrong(5, F.lit("x"), F.sha2("content", 256)).alias("span_hash"),
    )
    return K.entry_attach(rows, v["v_doc"]).select("doc_id", "error")


@query("projection_refs", "v_step", """
WITH p AS (SELECT flow AS map, flow, ordinal, partkey % 5 AS k, CASE partkey % 5 WHEN 0 THEN 'visible' WHEN 1 THEN 'preserved' WHEN 2 THEN 'fold_entry' WHEN 3 THEN 'fold_exit' ELSE 'boundary' END AS kind,
  CASE WHEN partkey % 11 = 0 THEN '' WHEN partkey % 7 = 0 THEN 'none' ELSE cast(ordinal AS VARCHAR) END AS ref FROM v_step)
SELECT map, kind, ref, CASE WHEN flow % 17 = 0 THEN 'no_map' WHEN flow % 10 = 0 THEN 'basis' ELSE 'unknown_ref' END AS rule FROM p
WHERE flow % 17 = 0 OR flow % 10 = 0 OR NOT (CASE WHEN ref = '' THEN k IN (2, 3) WHEN ref = 'none' THEN false WHEN k = 4 THEN ordinal % 2 = 0 ELSE true END)""")
def projection_refs(v):
    s = v["v_step"].withColumnRenamed("flow", "map")
    kind = F.expr("element_at(array('visible', 'preserved', 'fold_entry', 'fold_exit', 'boundary'), int(partkey % 5) + 1)")
    ref = F.expr("case when partkey % 11 = 0 then '' when partkey % 7 = 0 then 'none' else string(ordinal) end")
    refs = s.select("map", F.lit("g").alias("generation"), F.expr("if(map % 10 = 0, 'old', 'b')").alias("basis"), kind.alias("kind"), ref.alias("ref"))
    maps = s.filter("map % 17 <> 0").select("map", F.lit("g").alias("generation"), F.lit("b").alias("basis")).distinct()
    known = s.select("map", F.col("ordinal").cast("string").alias("ref"), "ordinal")
    return K.projection_refs(refs, maps, known.select("map", "ref"), known.filter("ordinal % 2 = 0").select("map", "ref"))


@query("impact_evidence", "v_step", """
SELECT flow, ordinal, partkey % 12 NOT IN (1, 2, 3, 4, 5, 6, 7, 8) AND byte_end > byte_start AND flow % 3 <> 0 AS valid FROM v_step""")
def impact_evidence(v):
    k = lambda n, bad, good: F.when(F.col("partkey") % 12 == n, F.lit(bad)).otherwise(good)
    rows = v["v_step"].select(
        "flow", "ordinal", (F.col("flow") % 3).alias("map"), k(1, "", F.lit("ev")).alias("evidence_id"), k(2, " ", F.lit("code")).alias("kind"), k(3, "stale", F.lit("verified")).alias("validation"), k(4, "old", F.lit("b")).alias("basis"), F.lit("s").alias("snapshot"),
        k(5, "../x.dart", k(6, "/x.dart", F.col("path"))).alias("path"), k(7, "agent", F.lit("test")).alias("authority"), "byte_start", "byte_end", k(8, 0, F.lit(3)).alias("line_start"), F.lit(3).alias("line_end"),
    )
    maps = rows.filter("map <> 0").select("map", F.lit("b").alias("basis"), F.lit("s").alias("snapshot")).distinct()
    return K.impact_evidence(rows, maps).select("flow", "ordinal", "valid")


@query("decision_purpose_v1", "v_step", """
SELECT flow, ordinal, CASE partkey % 6 WHEN 0 THEN 'auth' WHEN 1 THEN 'limit' WHEN 2 THEN 'validation' WHEN 3 THEN 'precondition' WHEN 4 THEN '' ELSE CASE WHEN partkey % 5 = 3 THEN 'validation' ELSE '' END END AS purpose FROM v_step""")
def decision_purpose_v1(v):
    rules = F.expr("case partkey % 6 when 0 then array('Role:Admin', 'x') when 1 then array('rate_cap') when 2 then array('SCHEMA') when 3 then array('state_check') when 4 then array('auth', 'quota') end")
    return v["v_step"].select("flow", "ordinal", K.decision_purpose_v1(rules, F.col("symbol")).alias("purpose"))


@query("alignment_status", "v_criterion v_turn", """
WITH m AS (SELECT DISTINCT criterion_id, flow * 100 + ordinal AS step FROM v_criterion JOIN v_turn ON flow % 40 = criterion_id WHERE criterion_id % 5 <> 0),
r AS (SELECT DISTINCT criterion_id, step, step % 6 AS k FROM m WHERE criterion_id % 5 <> 1),
b AS (SELECT criterion_id, bool_or(k = 1 OR k = 5) AS odd, bool_or(k IN (2, 3, 4)) AS old, bool_or(k IN (0, 1, 2)) AS code FROM r GROUP BY 1)
SELECT c.criterion_id, (SELECT count(*) FROM m WHERE m.criterion_id = c.criterion_id) AS steps,
  CASE WHEN c.criterion_id NOT IN (SELECT criterion_id FROM m) THEN 'not_observed' WHEN odd IS NULL THEN 'unknown' WHEN odd THEN 'conflicting' ELSE 'partial' END AS status,
  CASE WHEN c.criterion_id NOT IN (SELECT criterion_id FROM m) THEN 'implementation_step,current_runtime_proof' WHEN odd IS NULL THEN 'verified_evidence,test_evidence,contract_evidence,current_runtime_proof' WHEN odd THEN '' WHEN old THEN 'fresh_basis_evidence'
       WHEN c.criterion_id % 3 = 0 THEN 'evidence_kind:test' WHEN NOT code THEN 'evidence_kind:code' ELSE 'current_runtime_proof' END AS missing
FROM v_criterion c LEFT JOIN b USING (criterion_id)""")
def alignment_status(v):
    """Evidence of six kinds of state: good; of an agent; of another basis; stale; unknown; in conflict."""
    criteria = v["v_criterion"].select("criterion_id", F.expr("if(criterion_id % 3 = 0, array('test'), array('code'))").alias("required"))
    steps = v["v_turn"].select(F.expr("flow % 40").alias("criterion_id"), F.expr("flow * 100 + ordinal").alias("step"))
    own = steps.join(criteria.filter("criterion_id % 5 <> 0").select("criterion_id"), "criterion_id")
    refs = own.filter("criterion_id % 5 <> 1").select("step", F.concat(F.lit("e"), F.col("step").cast("string")).alias("evidence_id"))
    evidence = refs.filter("step % 6 <> 4").select("evidence_id", F.lit("code").alias("kind"), F.expr("if(step % 6 = 1, 'agent', 'code')").alias("authority"), F.expr("if(step % 6 = 2, 'old', 'b')").alias("basis"), F.expr("case step % 6 when 3 then 'stale' when 5 then 'conflicting' else 'verified' end").alias("validation"))
    return K.alignment_status(criteria, own, refs, evidence, "b").select("criterion_id", "steps", "status", F.array_join("missing", ",").alias("missing"))


_CAUSES = [(gate, cause) for gate, of in K.GATE_RULES.items() for cause in of]
# What each faulty row has in place of the good value, in the order of the causes.
_FAULTS = [
    ("captured_snapshot", "'other'"), ("captured_basis", "''"), ("tree_id", "null"), ("dependency", "'d2'"), ("live_epoch", "4"), ("captured_repository", "'r2'"), ("worktree", "''"), ("delta_to", "'x'"),
    ("closure_read_set", "''"), ("closure_intent", "9"), ("closure_query", "''"), ("derived_digest", "'x'"), ("closure_status", "'open'"), ("changed_inside", "2L"), ("index_changed", "true"),
    ("n_evidence", "0L"), ("n_unbound", "1L"), ("n_evidence_twice", "1L"), ("n_bare", "1L"), ("n_unknown_refs", "3L"), ("n_steps_twice", "1L"), ("n_edges_outside", "1L"), ("expected_generation", "'g2'"), ("previous_generation", "generation_id"), ("n_bad_digests", "1L"), ("intent_status", "'needs_confirmation'"), ("query_hash", "null"), ("current", "''"),
]
_GOOD = {
    "snapshot_id": "'s'", "captured_snapshot": "'s'", "live_snapshot": "'l'", "delta_from": "captured_snapshot", "delta_to": "'l'", "basis_id": "'b'", "captured_basis": "'b'", "tree_id": "'t'", "captured_tree": "'t'", "dependency": "'d'", "captured_dependency": "'d'", "epoch": "3", "captured_epoch": "3", "live_epoch": "3",
    "repository": "'r'", "captured_repository": "'r'", "worktree": "'w'", "captured_worktree": "'w'", "read_set": "'rs'", "closure_read_set": "'rs'", "closure_basis": "'b'", "closure_intent": "1", "intent_revision": "1", "query_hash": "'q'", "closure_query": "'q'", "closure_digest": "'c'", "derived_digest": "'c'", "closure_status": "'closed'",
    "changed_inside": "0L", "membership_changed": "false", "index_changed": "false", "resolution_changed": "false", "capability_changed": "false", "configuration_changed": "false", "contract_changed": "false", "n_steps": "5L", "n_evidence": "5L", "n_unbound": "0L", "n_evidence_twice": "0L", "n_bare": "0L", "n_unknown_refs": "0L", "n_steps_twice": "0L", "n_edges_outside": "0L",
    "generation_id": "concat('g', string(o_orderkey))", "expected_generation": "generation_id", "previous_generation": "'before'", "n_digests": "2L", "n_bad_digests": "0L", "intent_status": "'confirmed'", "task_id": "'task'", "intent_task": "'task'", "mode": "'m'", "intent_mode": "'m'", "requested": "'a'", "current": "'b'",
}
_ONE = " ".join(f"WHEN {i} THEN '{gate}:{cause}'" for i, (gate, cause) in enumerate(_CAUSES))


@query("publication_gates", "orders", f"""
WITH f AS (SELECT o_orderkey, o_orderkey % 31 AS a, CASE WHEN o_orderkey % 4 = 0 THEN 27 ELSE -1 END AS b FROM orders)
SELECT o_orderkey, a >= {len(_CAUSES)} AND b < 0 AS passed, concat_ws(',', CASE a {_ONE} END, CASE WHEN b >= 0 AND a <> b THEN CASE b {_ONE} END END) AS causes FROM f WHERE a <> 26
UNION ALL SELECT o_orderkey, false, concat_ws(',', 'closure:query_identity', 'relevance:no_query', CASE WHEN b >= 0 THEN 'comprehension:summary' END) FROM f WHERE a = 26""")
def publication_gates(v):
    """Each row has one fault or none, every fourth lacks its summary as well."""
    rows = v["orders"].select("o_orderkey")
    for name, good in _GOOD.items():
        bad = next(((i, x) for i, (c, x) in enumerate(_FAULTS) if c == name), None)
        value = good if bad is None else f"case when o_orderkey % 31 = {bad[0]} then {bad[1]} else {good} end"
        if name == "current":
            value = f"case when o_orderkey % 31 = {bad[0]} or o_orderkey % 4 = 0 then '' else {good} end"
        rows = rows.withColumn(name, F.expr(value))
    gate_of = F.create_map(*[F.lit(x) for gate, cause in _CAUSES for x in (cause, f"{gate}:{cause}")])
    return K.publication_gates(rows).select("o_orderkey", "passed", F.array_join(F.transform("causes", lambda c: gate_of[c]), ",").alias("causes"))


@query("map_counts", "v_step v_edge", """
WITH s AS (SELECT flow AS map, ordinal FROM v_step), n AS (SELECT map, count(*) AS n FROM s GROUP BY 1)
SELECT n.map, n AS n_steps, 0 AS n_steps_twice, (SELECT count(*) FROM s WHERE s.map = n.map AND ordinal % 5 = 0) AS n_bare, (SELECT count(*) FROM s WHERE s.map = n.map AND ordinal % 5 = 3) AS n_unknown_refs,
  (SELECT count(*) FROM s WHERE s.map = n.map AND ordinal % 5 NOT IN (0, 3)) AS n_evidence, (SELECT count(*) FROM s WHERE s.map = n.map AND ordinal % 5 = 1) AS n_unbound,
  (SELECT count(*) FROM v_edge e WHERE e.flow = n.map AND (target_ordinal IS NULL OR target_ordinal > n)) AS n_edges_outside FROM n""")
def map_counts(v):
    s = v["v_step"].select(F.col("flow").alias("map"), F.col("ordinal").alias("step"), "path")
    refs = s.filter("step % 5 <> 0").select("map", "step", F.col("step").cast("string").alias("evidence_id"))
    evidence = refs.filter("step % 5 <> 3").select("map", "evidence_id", F.lit("verified").alias("validation"), F.expr("if(step % 5 = 1, 'old', 's')").alias("snapshot"), F.lit("").alias("basis"))
    maps = s.select("map", F.lit("s").alias("snapshot_id"), F.lit("b").alias("basis_id")).distinct()
    edges = v["v_edge"].select(F.col("flow").alias("map"), F.col("step_ordinal").alias("from_step"), F.col("target_ordinal").alias("to_step"))
    out = K.map_counts(s, edges, refs, evidence, maps)
    return out.select("map", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_steps", "n_steps_twice", "n_bare", "n_unknown_refs", "n_evidence", "n_unbound", "n_edges_outside")))


@query("closure_status", "events", """
WITH o AS (SELECT user_id AS closure, CASE event_type WHEN 'click' THEN 'membership' WHEN 'view' THEN 'negative_lookup' WHEN 'purchase' THEN 'dependency_frontier' ELSE event_type END AS name FROM events WHERE value > 60 + 12 * (user_id % 15)),
m AS (SELECT user_id AS closure, coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM o WHERE o.closure = u.user_id), '') AS measured FROM (SELECT DISTINCT user_id FROM events) u),
w AS (SELECT closure, name FROM m, (VALUES ('membership'), ('signup'), ('negative_lookup')) n(name) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.closure = m.closure AND o.name = n.name))
SELECT closure, measured, CASE WHEN closure IN (SELECT closure FROM w) THEN 'open' ELSE 'closed' END AS status, coalesce((SELECT string_agg('not_measured:' || name, ',' ORDER BY name) FROM w WHERE w.closure = m.closure), '') AS reasons FROM m""")
def closure_status(v):
    """Clicks are memberships of the source, views lookups without a hit, purchases frontiers; other types name themselves."""
    category = F.expr("case event_type when 'click' then 'membership' when 'purchase' then 'dependency_frontier' else 'negative_lookup' end")
    kind = F.expr("case event_type when 'click' then 'source_membership' when 'view' then 'negative_lookup' when 'purchase' then 'dependency_frontier' else event_type end")
    rows = v["events"].select(F.col("user_id").alias("closure"), category.alias("category"), kind.alias("kind"), F.expr("value > 60 + 12 * (user_id % 15)").alias("measured"))
    need = rows.select("closure").distinct().select("closure", F.explode(F.array(*[F.lit(n) for n in ("membership", "signup", "negative_lookup")])).alias("name"))
    out = K.closure_status(rows, need)
    return out.select("closure", F.array_join("measured", ",").alias("measured"), "status", F.array_join("reasons", ",").alias("reasons"))
