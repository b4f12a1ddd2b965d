"""Queries over proposed reading paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import checks as K
from tracewell.operators import paths as P
from tracewell.queries.registry import query

_ROLES = ["decision", "state_change", "effect", "handoff", "outcome", "boundary"]


def _proposal(v):
    """Each flow's odd steps and every seventh other one, joined by the edges between them, one in nine with a wrong edge."""
    role = F.when(F.col("ordinal") == 1, "entry").otherwise(F.get(F.array(*[F.lit(r) for r in _ROLES]), F.expr("int(partkey % 6)")))
    steps = v["v_step"].withColumn("role", role).withColumn("value_role", F.lit(None).cast("string")).withColumn("caller_ordinal", F.expr("if(partkey % 3 = 0, ordinal - 1, null)")).withColumn("effect", F.expr("quantity % 10 = 0")).withColumn("sourced", F.col("file_hash").isNotNull())
    steps = K.role_check(steps, v["v_edge"], steps.filter("partkey % 13 = 0").select("flow", "ordinal")).withColumnRenamed("valid", "role_ok")
    edges = v["v_edge"].withColumn("condition", F.expr("if(partkey % 5 = 0, 'x', null)")).withColumn("kind", F.expr("case when partkey % 11 = 0 then 'async' when kind = 'sequence' then 'loop_back' when partkey % 7 = 0 then 'return' else kind end"))
    chosen = steps.filter("ordinal % 2 = 1 or partkey % 7 = 0").select("flow", F.col("ordinal").alias("position"), "ordinal", "role", F.expr("if(partkey % 17 = 0, 'other', 'save it')").alias("request_part"), F.expr("if(partkey % 19 = 0, ' ', 'why')").alias("reason"))
    a = edges.filter("target_ordinal = step_ordinal + 2").select("flow", F.col("step_ordinal").alias("from_step"), F.col("target_ordinal").alias("to_step"), F.array(F.expr("if(partkey % 9 = 0, 99L, edge_idx)")).alias("edge_idxs"))
    one = edges.filter("target_ordinal = step_ordinal + 1").select("flow", "step_ordinal", "target_ordinal", "edge_idx", "partkey")
    b = one.alias("x").join(one.select("flow", F.col("step_ordinal").alias("target_ordinal"), F.col("target_ordinal").alias("to_step"), F.col("edge_idx").alias("e2")), ["flow", "target_ordinal"]).select("flow", F.col("step_ordinal").alias("from_step"), "to_step", F.expr("if(partkey % 9 = 0, array(edge_idx, edge_idx), array(edge_idx, e2))").alias("edge_idxs"))
    relations = a.union(b).withColumn("relation", F.concat_ws("-", "from_step", "to_step", F.array_join(F.transform("edge_idxs", lambda x: x.cast("string")), "-")))
    return steps, edges, chosen, relations


_PATHS = f"""
o AS (SELECT flow, step_ordinal AS ordinal, bool_or(resolution_status = 'resolved' AND kind = 'external') AS fx, bool_or(resolution_status <> 'resolved' OR kind = 'callback_argument') AS op FROM v_edge GROUP BY 1, 2),
s AS (SELECT flow, ordinal, kind, invocation_id AS inv, partkey, CASE WHEN ordinal = 1 THEN 'entry' ELSE ({_ROLES!r})[partkey % 6 + 1] END AS role, CASE WHEN partkey % 3 = 0 THEN ordinal - 1 END AS caller, quantity % 10 = 0 AS fx, file_hash IS NOT NULL AS ok FROM v_step),
e AS (SELECT flow, edge_idx AS i, step_ordinal AS a, target_ordinal AS b, partkey, resolution_status = 'resolved' AS ok, partkey % 5 = 0 AS cond, CASE WHEN partkey % 11 = 0 THEN 'async' WHEN kind = 'sequence' THEN 'loop_back' WHEN partkey % 7 = 0 THEN 'return' ELSE kind END AS kind FROM v_edge),
y AS (SELECT DISTINCT e.flow, e.i FROM e JOIN s c ON c.flow = e.flow AND c.ordinal = e.a AND c.kind = 'call' JOIN s r ON r.flow = e.flow AND r.kind = 'return' AND r.caller = c.ordinal AND r.inv <> c.inv JOIN e k ON k.flow = e.flow AND k.a = r.ordinal AND k.b = e.b AND k.kind = 'return' AND k.ok WHERE e.kind = 'control_flow' AND e.ok),
g AS (SELECT e.*, ok AND kind IN ('control_flow', 'resolved_cross_file', 'return', 'async', 'loop_back', 'external') AND (flow, i) NOT IN (SELECT (flow, i) FROM y) AS run FROM e),
c AS (SELECT flow, ordinal, role, partkey FROM s WHERE ordinal % 2 = 1 OR partkey % 7 = 0),
r AS (SELECT flow, a, b, CASE WHEN partkey % 9 = 0 THEN [99] ELSE [i] END AS x FROM e WHERE b = a + 2 UNION ALL SELECT p.flow, p.a, q.b, CASE WHEN p.partkey % 9 = 0 THEN [p.i, p.i] ELSE [p.i, q.i] END FROM e p JOIN e q ON q.flow = p.flow AND q.a = p.b AND q.b = q.a + 1 WHERE p.b = p.a + 1),
n AS (SELECT *, concat_ws('-', a, b, array_to_string(x, '-')) AS relation FROM r),
z AS (SELECT n.flow, relation, n.a, n.b, row_number() OVER (PARTITION BY n.flow, n.a, n.b ORDER BY relation) AS nth, p.kind AS k1, q.kind AS k2, p.cond AS c1, q.cond AS c2, len(x) AS n, x[1] = x[2] AS twice,
  (n.flow, n.a) IN (SELECT (flow, ordinal) FROM c) AND (n.flow, n.b) IN (SELECT (flow, ordinal) FROM c) AS ends, (n.flow, n.a + 1) IN (SELECT (flow, ordinal) FROM c) AS mid, coalesce(p.run, false) AS r1, coalesce(q.run, false) AS r2,
  NOT m.ok AND (m.fx OR m.kind IN ('mutation', 'guard', 'branch', 'decision', 'call', 'await', 'return', 'external_effect')) AS dark
  FROM n LEFT JOIN g p ON p.flow = n.flow AND p.i = x[1] LEFT JOIN g q ON q.flow = n.flow AND q.i = x[2] LEFT JOIN s m ON m.flow = n.flow AND m.ordinal = n.a + 1),
w AS (SELECT flow, relation, a, b, n, k1, k2, c1, c2, CASE WHEN NOT ends THEN 'order' WHEN nth > 1 THEN 'duplicate' WHEN k1 IS NULL THEN 'edge_index' WHEN NOT r1 THEN 'edge' WHEN n = 2 THEN CASE WHEN dark THEN 'hidden' WHEN twice THEN 'edge_index' WHEN NOT r2 THEN 'edge' WHEN mid THEN 'skips' END END AS error FROM z)"""


@query("reading_relations", "v_step v_edge", f"""
WITH {_PATHS} SELECT flow, relation, error, CASE WHEN error IS NULL THEN CASE WHEN 'async' IN (k1, coalesce(k2, '')) THEN 'async_handoff' WHEN c1 OR coalesce(c2, false) OR 'loop_back' IN (k1, coalesce(k2, '')) THEN 'conditional' WHEN 'resolved_cross_file' IN (k1, coalesce(k2, '')) THEN 'direct_call' ELSE 'control_flow' END END AS kind FROM w""", by="lineitem.l_orderkey")
def reading_relations(v):
    steps, edges, chosen, relations = _proposal(v)
    return P.reading_relations(relations, chosen, steps, edges).select("flow", "relation", "error", "kind")


@query("reading_path", "v_step v_edge", f"""
WITH {_PATHS} SELECT flow, ordinal, CASE WHEN ordinal > 1 AND NOT (CASE role WHEN 'decision' THEN s.kind IN ('guard', 'branch', 'decision') WHEN 'state_change' THEN s.kind = 'mutation' WHEN 'effect' THEN s.kind = 'external_effect' OR coalesce(o.fx, false)
  WHEN 'handoff' THEN s.kind IN ('call', 'await') WHEN 'outcome' THEN s.kind IN ('return', 'mutation', 'external_effect') ELSE coalesce(op, false) OR partkey % 13 = 0 END) THEN 'role'
  WHEN partkey % 17 = 0 OR partkey % 19 = 0 THEN 'phrase' WHEN NOT ok THEN 'source' WHEN ordinal > 1 AND pn IS NULL THEN 'disconnected' WHEN nn IS NULL AND role NOT IN ('outcome', 'boundary') THEN 'open_end' END AS error, coalesce(pn, 0) AS n_previous, coalesce(nn, 0) AS n_next
FROM c JOIN s USING (flow, ordinal, role, partkey) LEFT JOIN o USING (flow, ordinal) LEFT JOIN (SELECT flow, a AS ordinal, count(DISTINCT b) AS nn FROM w WHERE error IS NULL GROUP BY 1, 2) x USING (flow, ordinal) LEFT JOIN (SELECT flow, b AS ordinal, count(DISTINCT a) AS pn FROM w WHERE error IS NULL GROUP BY 1, 2) u USING (flow, ordinal)""", by="lineitem.l_orderkey")
def reading_path(v):
    steps, edges, chosen, relations = _proposal(v)
    requests = steps.select("flow").distinct().withColumn("request", F.lit("please save it"))
    out = P.reading_path(chosen, P.reading_relations(relations, chosen, steps, edges), steps, requests)
    return out.select("flow", "ordinal", "error", F.size("previous").cast("long").alias("n_previous"), F.size("next").cast("long").alias("n_next"))
