"""Queries over the rules of execution facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import execution as X
from tracewell.queries.registry import query

# Steps: invocation 1 up to ordinal 3 (1 in every fifth flow) and at the end, between these 2, called from there; some with another place, caller or none.
_STEP = """SELECT flow, ordinal, CASE partkey % 13 WHEN 0 THEN 'await' WHEN 1 THEN 'throw' WHEN 2 THEN 'return' WHEN 3 THEN 'break' WHEN 4 THEN 'continue' WHEN 5 THEN 'branch' WHEN 6 THEN 'guard' WHEN 7 THEN 'mutation' WHEN 8 THEN 'return' ELSE 'call' END AS kind,
  CASE WHEN partkey % 37 = 0 THEN NULL WHEN low THEN 'i1' ELSE 'i2' END AS invocation_id, CASE WHEN partkey % 43 = 0 THEN ordinal + 1 WHEN NOT low THEN top END AS caller_ordinal, CASE WHEN partkey % 47 = 0 THEN 's9' WHEN flow % 3 = 0 OR low THEN 's1' ELSE 's2' END AS symbol, CASE WHEN flow % 4 = 0 AND NOT low THEN 'q' ELSE 'p' END AS path,
  CASE WHEN flow % 2 = 0 THEN 0 ELSE 10 * ordinal END AS byte_start, CASE WHEN suppkey % 6 = 0 THEN 1000 WHEN flow % 2 = 0 THEN 500 ELSE 10 * ordinal + 9 END AS byte_end, 'h' AS file_hash, CASE WHEN partkey % 9 = 0 THEN ordinal - 1 WHEN partkey % 53 = 0 THEN 99 END AS assign_source, CASE partkey % 17 WHEN 0 THEN 'local_binding' WHEN 1 THEN 'other' END AS value_role, partkey, suppkey, top, n
  FROM (SELECT *, ordinal <= top OR ordinal = n AS low FROM (SELECT *, CASE WHEN flow % 5 = 0 THEN 1 ELSE 3 END AS top, count(*) OVER (PARTITION BY flow) AS n FROM v_step) t0) t"""
_EDGE = """SELECT flow, row_number() OVER (PARTITION BY flow ORDER BY part, ordinal) AS edge_idx, step_ordinal, target_ordinal, kind, resolution_status, conditions, CASE WHEN conditions > 0 THEN CASE WHEN partkey % 59 = 0 THEN 1 ELSE ordinal END END AS condition_step, CASE WHEN conditions > 0 THEN CASE suppkey % 5 WHEN 0 THEN 'falsy' WHEN 1 THEN 'maybe' WHEN 2 THEN 'nullish' ELSE 'truthy' END END AS outcome,
  CASE WHEN partkey % 61 = 0 THEN 'x' ELSE concat(to_path, '#', to_name) END AS to_symbol, CASE WHEN suppkey % 7 = 0 THEN 'late' END AS unresolved_reason
  FROM (SELECT e.*, t.path AS to_path, t.symbol AS to_name FROM (
    SELECT 0 AS part, flow, ordinal, ordinal AS step_ordinal, CASE WHEN suppkey % 29 = 0 THEN NULL ELSE ordinal + CAST(suppkey % 5 AS bigint) - 1 END AS target_ordinal, CASE partkey % 15 WHEN 0 THEN 'control_flow' WHEN 1 THEN 'parallel_wait' WHEN 2 THEN 'await_resume' WHEN 3 THEN 'await_loop_back' WHEN 4 THEN 'failure' WHEN 5 THEN 'finally' WHEN 6 THEN 'switch_exit' WHEN 7 THEN 'loop_back' WHEN 8 THEN 'loop_reentry' WHEN 9 THEN 'loop_exit' WHEN 10 THEN 'loop_exit_back' WHEN 11 THEN 'callback_argument' WHEN 12 THEN 'return' WHEN 13 THEN 'resolved_cross_file' ELSE 'control_flow' END AS kind,
      CASE WHEN partkey % 31 = 0 THEN 'dynamic' ELSE 'resolved' END AS resolution_status, CASE WHEN kind IN ('branch', 'guard') OR partkey % 19 = 0 THEN CASE WHEN suppkey % 23 = 0 THEN 2 ELSE 1 END ELSE 0 END AS conditions, partkey, suppkey FROM x_step
    UNION ALL SELECT 1, flow, ordinal, top, ordinal, 'resolved_cross_file', 'resolved', 0, partkey, suppkey FROM x_step WHERE ordinal = top + 1
    UNION ALL SELECT 2, flow, ordinal, top, n, 'control_flow', 'resolved', 0, partkey, suppkey FROM x_step WHERE ordinal = top AND flow % 2 = 0
    UNION ALL SELECT 3, flow, ordinal, ordinal, n, CASE kind WHEN 'throw' THEN 'failure' ELSE 'return' END, 'resolved', 0, partkey, suppkey FROM x_step WHERE kind IN ('return', 'throw') AND ordinal > top AND ordinal < n) e LEFT JOIN x_step t ON t.flow = e.flow AND t.ordinal = e.target_ordinal) u"""


def _facts(v):
    spark = v["v_step"].sparkSession
    head = f"WITH x_step AS ({_STEP}), x_edge AS ({_EDGE}) SELECT * FROM "
    return spark.sql(head + "x_step"), spark.sql(head + "x_edge").withColumn("edge_idx", F.col("edge_idx").cast("long"))


@query("execution_steps", "v_step", f"""
WITH s AS ({_STEP}), g AS (SELECT flow, invocation_id, min(ordinal) AS at, arg_min(coalesce(caller_ordinal, -1), ordinal) AS caller, count(DISTINCT (symbol, path, coalesce(caller_ordinal, -1))) AS places FROM s WHERE invocation_id IS NOT NULL GROUP BY 1, 2)
SELECT flow, 'value_role' AS rule, ordinal AS at FROM s WHERE value_role IS NOT NULL AND (value_role <> 'local_binding' OR kind <> 'mutation')
UNION ALL SELECT flow, 'caller_without_invocation', ordinal FROM s WHERE invocation_id IS NULL AND caller_ordinal IS NOT NULL
UNION ALL SELECT flow, 'invocation_inconsistent', g."at" FROM g WHERE places > 1
UNION ALL SELECT g.flow, 'caller_invalid', g."at" FROM g LEFT JOIN s c ON c.flow = g.flow AND c.ordinal = g.caller WHERE g.caller >= 0 AND (c.flow IS NULL OR c.invocation_id IS NULL OR c.invocation_id = g.invocation_id OR g.caller >= g."at")
UNION ALL SELECT a.flow, CASE WHEN b.flow IS NULL THEN 'assignment_missing' ELSE 'assignment_source' END, a.ordinal FROM s a LEFT JOIN s b ON b.flow = a.flow AND b.ordinal = a.assign_source WHERE a.assign_source IS NOT NULL AND (b.flow IS NULL OR b.byte_start < a.byte_start OR b.byte_end > a.byte_end OR a.assign_source >= a.ordinal)""")
def execution_steps(v):
    return X.step_rules(_facts(v)[0])


@query("execution_edges", "v_step", f"""
WITH x_step AS ({_STEP}), e AS ({_EDGE}), n AS (SELECT flow, invocation_id AS inv, min(ordinal) AS entry FROM x_step WHERE invocation_id IS NOT NULL GROUP BY 1, 2),
j AS (SELECT e.*, a.kind AS ak, b.kind AS bk, d.kind AS dk, c.kind AS ck, a.invocation_id AS ai, b.invocation_id AS bi, c.invocation_id AS ci, a.caller_ordinal AS ac, b.caller_ordinal AS bc, coalesce(to_symbol = b.path || '#' || b.symbol, false) AS named, coalesce(a.path = b.path AND a.symbol = b.symbol, false) AS together, coalesce(a.byte_start <= b.byte_start AND a.byte_end >= b.byte_end, false) AS spans,
    coalesce(b.byte_end > b.byte_start AND b.byte_end <= a.byte_start, false) AS above, m.entry AS be, e.step_ordinal AS s, e.target_ordinal AS t, resolution_status = 'resolved' AS ok,
    EXISTS (SELECT 1 FROM e r WHERE r.flow = e.flow AND r.kind = 'resolved_cross_file' AND r.resolution_status = 'resolved' AND r.step_ordinal = a.caller_ordinal AND r.target_ordinal = k.entry) AS called, EXISTS (SELECT 1 FROM e r WHERE r.flow = e.flow AND r.kind = 'control_flow' AND r.resolution_status = 'resolved' AND r.conditions = 0 AND r.step_ordinal = a.caller_ordinal AND r.target_ordinal = e.target_ordinal) AS continued
  FROM e LEFT JOIN x_step a ON a.flow = e.flow AND a.ordinal = e.step_ordinal LEFT JOIN x_step b ON b.flow = e.flow AND b.ordinal = e.target_ordinal LEFT JOIN x_step d ON d.flow = e.flow AND d.ordinal = e.condition_step LEFT JOIN x_step c ON c.flow = e.flow AND c.ordinal = a.caller_ordinal LEFT JOIN n k ON k.flow = e.flow AND k.inv = a.invocation_id LEFT JOIN n m ON m.flow = e.flow AND m.inv = b.invocation_id),
q AS (SELECT *, coalesce(ck = 'call' AND ci IS NOT DISTINCT FROM bi AND t > ac, false) AS back FROM j),
r AS (SELECT flow, edge_idx AS at, CASE
  WHEN kind = 'callback_argument' THEN CASE WHEN s IS NULL OR t IS NULL OR NOT ok OR conditions > 0 OR unresolved_reason IS NOT NULL THEN 'callback_incomplete' WHEN NOT coalesce(ai <> bi AND bc IS NULL AND be = t AND together AND named AND spans, false) THEN 'callback_reference' END
  WHEN conditions > 0 AND (kind NOT IN ('control_flow', 'loop_back', 'loop_reentry') OR conditions <> 1) THEN 'condition_relation'
  WHEN conditions > 0 AND NOT coalesce(condition_step = s AND dk IN ('branch', 'guard') AND outcome <> 'maybe', false) THEN 'condition_reference'
  WHEN kind = 'return' THEN CASE WHEN t IS NULL OR NOT ok THEN 'return_incomplete' WHEN NOT coalesce(ak = 'return' AND bk IS NOT NULL AND ai IS NOT NULL AND ac IS NOT NULL, false) THEN 'return_without_caller' WHEN NOT (back AND bi IS DISTINCT FROM ai AND named) THEN 'return_continuation' WHEN NOT (called AND continued) THEN 'return_unmatched' END
  WHEN kind = 'resolved_cross_file' THEN CASE WHEN t IS NULL THEN NULL WHEN NOT coalesce(be = t AND named, false) THEN 'target_invalid' WHEN NOT coalesce(s = bc AND ok, false) THEN 'target_caller' END
  WHEN t IS NULL THEN 'flow_incomplete'
  WHEN kind = 'failure' AND ak IS NOT NULL AND bk IS NOT NULL AND ai IS DISTINCT FROM bi THEN CASE WHEN NOT (ak = 'throw' AND ai IS NOT NULL AND ac IS NOT NULL AND bi IS NOT NULL AND ok AND named) THEN 'throw_recovery' WHEN NOT (back AND ci IS DISTINCT FROM ai) THEN 'throw_not_in_caller' WHEN NOT called THEN 'throw_without_call' END
  WHEN NOT coalesce(ai = bi AND together AND named AND ok, false) THEN 'flow_endpoints'
  WHEN (kind IN ('loop_exit', 'loop_exit_back', 'switch_exit')) <> (ak = 'break') OR (ak = 'continue' AND kind <> 'loop_back') THEN 'loop_transfer'
  WHEN kind IN ('loop_exit', 'switch_exit') AND t <= s THEN 'exit_order' WHEN kind = 'loop_exit_back' AND t = s THEN 'exit_to_itself' WHEN kind IN ('loop_back', 'await_loop_back', 'loop_exit_back') AND t > s AND NOT (kind = 'loop_back' AND ak = 'continue' AND bk = 'mutation' AND above) THEN 'loop_back_order'
  WHEN kind = 'loop_reentry' AND NOT coalesce(ak = 'branch' AND t < s AND conditions = 1 AND outcome = 'truthy', false) THEN 'loop_reentry' WHEN kind IN ('await_resume', 'await_loop_back') AND ak <> 'await' THEN 'await_source' WHEN kind = 'parallel_wait' AND NOT (ak = 'call' AND bk = 'await' AND t > s) THEN 'parallel_wait'
  WHEN ak = 'await' AND kind NOT IN ('await_resume', 'await_loop_back', 'failure') THEN 'await_completion' WHEN kind = 'failure' AND ak NOT IN ('await', 'throw') THEN 'failure_source' WHEN kind = 'finally' AND ak NOT IN ('return', 'throw') THEN 'finally_source' WHEN ak IN ('return', 'throw') AND kind NOT IN ('finally', 'failure') THEN 'flow_after_completion' END AS rule FROM q)
SELECT flow, rule, r."at" FROM r WHERE rule IS NOT NULL UNION ALL SELECT flow, 'call_unconfirmed', edge_idx FROM e WHERE kind = 'resolved_cross_file' AND (target_ordinal IS NULL OR resolution_status <> 'resolved')""", by="lineitem.l_orderkey")
def execution_edges(v):
    steps, edges = _facts(v)
    return X.edge_rules(steps, edges).unionByName(X.collected_rules(edges))
