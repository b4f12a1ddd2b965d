"""Queries over signatures, limitations and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import frames as FR
from tracewell.operators import review as R
from tracewell.queries.registry import query

_LINE = """CASE kind WHEN 'guard' THEN 'class Part {' WHEN 'branch' THEN '  if (x > 0) {' WHEN 'mutation' THEN '    state = 1;' WHEN 'call' THEN concat('  void ', split_part(symbol, '.', 2), '(')
  WHEN 'await' THEN ' ' WHEN 'return' THEN '    int  a)' WHEN 'external_effect' THEN '  } else {' WHEN 'failure' THEN '  // loadOrders() {' WHEN 'boundary' THEN concat('    Future<int> ', split_part(symbol, '.', 2), '() {  ') ELSE 'send' END"""
_HINT = "CASE WHEN partkey % 7 = 0 THEN '' WHEN partkey % 2 = 0 THEN 'loadOrders' ELSE split_part(symbol, '.', 2) END"


@query("signature", "v_step", f"""
WITH l AS (SELECT flow, ordinal, kind, {_LINE} AS raw, {_HINT} AS hint FROM v_step),
t AS (SELECT *, trim(regexp_replace(raw, ' +', ' ', 'g')) AS t, kind IN ('guard', 'call', 'boundary') AS head, CASE kind WHEN 'guard' THEN 0 WHEN 'call' THEN 2 ELSE 4 END AS deep FROM l),
h AS (SELECT DISTINCT hint FROM t WHERE hint <> ''),
x AS (SELECT flow, ordinal, h.hint, t.hint AS own, max(CASE WHEN head AND contains(raw, h.hint) THEN ordinal END) OVER (PARTITION BY flow, h.hint ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, min(CASE WHEN head AND contains(raw, h.hint) THEN ordinal END) OVER (PARTITION BY flow, h.hint) AS any_, arg_max(ordinal, CASE WHEN head THEN ordinal - 1000 * deep END) OVER (PARTITION BY flow, h.hint ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM t, h),
r AS (SELECT t.flow, t.ordinal, CASE WHEN t.hint = '' OR contains(raw, t.hint) THEN t.ordinal ELSE coalesce(above, any_, least, t.ordinal) END AS line FROM t LEFT JOIN x ON x.flow = t.flow AND x.ordinal = t.ordinal AND x.hint = t.hint),
b AS (SELECT r.flow, r.ordinal, r.line, t, row_number() OVER (PARTITION BY r.flow, r.ordinal ORDER BY t.ordinal) AS k FROM r JOIN t ON t.flow = r.flow AND t.ordinal >= r.line AND t <> ''),
c AS (SELECT *, coalesce(sum((suffix(t, '{{') OR suffix(t, ';') OR (suffix(t, ')') AND k > 1))::INT) OVER (PARTITION BY flow, ordinal ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM b),
s AS (SELECT flow, ordinal, string_agg(t, ' ' ORDER BY k) AS s FROM c WHERE k <= 5 AND stops = 0 GROUP BY 1, 2)
SELECT flow, ordinal, line, coalesce(CASE WHEN contains(s, '{{') THEN left(s, position('{{' IN s)) ELSE s END, '') AS signature FROM r LEFT JOIN s USING (flow, ordinal)""")
def signature(v):
    """Each flow is a source text of a line a step; each step asks for its own line, every other one by its byte offset."""
    lines = v["v_step"].select("flow", "ordinal", F.expr(_LINE).alias("raw"), F.expr(_HINT).alias("symbol_hint"), "partkey")
    text = lines.groupBy("flow").agg(F.array_sort(F.collect_list(F.struct("ordinal", "raw"))).alias("all")).select("flow", F.transform("all", lambda x: x["raw"]).alias("all")).withColumn("content", F.array_join("all", "\n"))
    rows = lines.drop("raw").join(text, "flow").withColumn("byte_offset", F.expr("if(partkey % 2 = 0, octet_length(array_join(slice(all, 1, int(ordinal) - 1), '\n')) + 1, 0)")).withColumn("line_hint", F.col("ordinal").cast("int"))
    rows = rows.withColumn("byte_offset", F.expr("if(ordinal = 1, 0, byte_offset)"))
    return R.signatures(rows).select("flow", "ordinal", F.col("line").cast("long").alias("line"), "signature")


def _frames(v):
    """Steps with a caller and a wide band of state changes; every fourth flow has frames of two steps."""
    steps = v["v_step"].withColumn("kind", F.expr("if(kind in ('call', 'await'), 'mutation', kind)")).withColumn("caller_ordinal", F.expr("if(partkey % 3 <> 0, ordinal - 1, null)")).withColumn("symbol", F.lit("s")).withColumn("path", F.expr("string(suppkey % 2)"))
    frames = steps.select("flow", F.expr("if(flow % 4 = 0, (ordinal + 1) div 2, ordinal)").alias("frame"), F.expr("if(kind = 'mutation', 'process', 'other')").alias("role"), "ordinal")
    edges = v["v_edge"].withColumn("condition", F.expr("if(partkey % 10 = 0, 'x', null)"))
    return steps, frames, edges, steps.filter("partkey % 23 = 0").select("flow", "ordinal"), steps.filter("flow % 2 = 0").select("flow").distinct()


_LIMITS = """s AS (SELECT flow, ordinal, CASE WHEN kind IN ('call', 'await') THEN 'mutation' ELSE kind END AS kind, invocation_id AS inv, CASE WHEN partkey % 3 <> 0 THEN ordinal - 1 END AS caller, suppkey % 2 AS p, partkey % 23 = 0 AS own, CASE WHEN flow % 4 = 0 THEN (ordinal + 1) // 2 ELSE ordinal END AS frame FROM v_step),
w AS (SELECT flow, inv FROM s WHERE ordinal = 1 UNION SELECT w.flow, b.inv FROM w JOIN s a ON a.flow = w.flow AND a.inv = w.inv JOIN v_edge e ON e.flow = a.flow AND e.step_ordinal = a.ordinal AND e.kind = 'resolved_cross_file' AND e.resolution_status = 'resolved' JOIN s b ON b.flow = e.flow AND b.ordinal = e.target_ordinal AND b.caller = a.ordinal),
u AS (SELECT flow, frame, bool_and((flow, inv) NOT IN (SELECT (flow, inv) FROM w)) AS all_, bool_or((flow, inv) NOT IN (SELECT (flow, inv) FROM w)) AS any_ FROM s GROUP BY 1, 2),
f AS (SELECT flow, frame, min(ordinal) AS ordinal FROM s GROUP BY 1, 2 HAVING count(*) = 1),
e AS (SELECT * FROM v_edge WHERE kind <> 'callback_argument'),
g AS (SELECT a.flow, a.frame AS x, b.frame AS y FROM f a JOIN f b ON b.flow = a.flow AND b.frame = a.frame + 1 JOIN s i ON i.flow = a.flow AND i.ordinal = a.ordinal JOIN s j ON j.flow = b.flow AND j.ordinal = b.ordinal JOIN e ON e.flow = a.flow AND e.step_ordinal = a.ordinal AND e.target_ordinal = b.ordinal
  WHERE i.kind = 'mutation' AND j.kind = 'mutation' AND i.inv = j.inv AND i.p = j.p AND NOT i.own AND NOT j.own AND e.kind = 'control_flow' AND e.resolution_status = 'resolved' AND e.partkey % 10 <> 0
  AND (SELECT count(*) FROM e o WHERE o.flow = a.flow AND o.step_ordinal = a.ordinal) = 1 AND (SELECT count(*) FROM e o WHERE o.flow = b.flow AND o.target_ordinal = b.ordinal) = 1),
m AS (SELECT flow, frame, 'invocation_unproven' AS code FROM u WHERE any_
  UNION ALL SELECT DISTINCT flow, frame, 'request_relevance_unproven' FROM s WHERE flow % 2 = 0 AND flow NOT IN (SELECT flow FROM s WHERE own)
  UNION ALL SELECT flow, frame, 'grouping_evidence_missing' FROM (SELECT flow, x AS frame FROM g UNION SELECT flow, y FROM g) q JOIN u USING (flow, frame) WHERE NOT all_)"""


@query("limitations", "v_step v_edge", f"WITH RECURSIVE {_LIMITS} SELECT * FROM m", by="lineitem.l_orderkey")
def limitations(v):
    steps, frames, edges, specific, requests = _frames(v)
    return R.limitations(frames, steps, edges, specific, requests)


@query("curation_review", "v_step v_edge", f"""
WITH RECURSIVE {_LIMITS},
r AS (SELECT flow, ordinal, v.kind, partkey, CASE WHEN ordinal = 1 THEN 'entry' WHEN v.kind = 'boundary' THEN 'boundary' WHEN v.kind = 'external_effect' OR EXISTS (SELECT 1 FROM v_edge x WHERE x.flow = v.flow AND x.step_ordinal = v.ordinal AND x.kind = 'external') THEN 'effect'
  WHEN v.kind IN ('guard', 'branch', 'decision', 'failure') THEN 'decision' WHEN v.kind = 'mutation' THEN 'process' WHEN v.kind = 'return' THEN CASE WHEN invocation_id IS NULL THEN 'result' ELSE 'local_completion' END ELSE 'unclassified_process' END AS rule, ['auth', 'limit', 'mixed'][partkey % 3 + 1] AS purpose FROM v_step v),
n AS (SELECT edge_idx, flow, step_ordinal AS ordinal, target_ordinal AS other, kind FROM e UNION ALL SELECT edge_idx, flow, target_ordinal, step_ordinal, kind FROM e WHERE target_ordinal IS NOT NULL)
SELECT r.flow, r.ordinal, rule, CASE WHEN r.flow % 3 = 0 AND r.partkey % 13 = 0 AND (SELECT count(*) FROM r o WHERE o.flow = r.flow AND o.partkey % 13 = 0) = 1 THEN 'criterion' WHEN r.partkey % 6 = 0 OR r.partkey % 6 = 4 THEN 'target' WHEN r.flow % 2 = 0 THEN 'scope' ELSE 'trace' END AS relation,
  CASE WHEN (SELECT count(*) FROM s o WHERE o.flow = r.flow AND o.frame = s.frame) > 1 THEN 'merged' WHEN rule = 'decision' AND (purpose = 'mixed' OR EXISTS (SELECT 1 FROM n JOIN r o ON o.flow = n.flow AND o.ordinal = n.other WHERE n.flow = r.flow AND n.ordinal = r.ordinal AND n.kind = 'control_flow' AND o.kind IN ('guard', 'branch', 'decision') AND o.purpose <> r.purpose)) THEN 'distinct_decisions'
       WHEN rule IN ('entry', 'boundary', 'effect', 'result') THEN 'consequence' ELSE 'no_evidence' END AS reason,
  (SELECT string_agg(o.ordinal, ',' ORDER BY o.ordinal) FROM s o WHERE o.flow = r.flow AND o.frame = s.frame) AS members, coalesce((SELECT string_agg(DISTINCT n.edge_idx, ',' ORDER BY n.edge_idx) FROM n WHERE n.flow = r.flow AND n.ordinal = r.ordinal), '') AS edges, EXISTS (SELECT 1 FROM m WHERE m.flow = r.flow AND m.frame = s.frame) AS limited
FROM r JOIN s ON s.flow = r.flow AND s.ordinal = r.ordinal""", by="lineitem.l_orderkey")
def curation_review(v):
    made, frames, edges, specific, requests = _frames(v)
    steps = FR.step_role(v["v_step"].withColumn("state_after", F.lit(None).cast("string")), v["v_edge"]).withColumn("purpose", F.expr("element_at(array('auth', 'limit', 'mixed'), int(partkey % 3) + 1)"))
    steps = steps.withColumn("rules", F.expr("case partkey % 6 when 0 then array('x', 'essential:a') when 1 then array('essentials') when 4 then array('request_target') end"))
    aligned = steps.filter("flow % 3 = 0 and partkey % 13 = 0").select("flow", F.lit("c").alias("criterion_id"), "ordinal")
    out = R.curation_review(steps, frames, edges, aligned, R.limitations(frames, made, edges, specific, requests), requests)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("flow", "ordinal", "rule", "relation", "reason", text("members"), text("edges"), "limited")
