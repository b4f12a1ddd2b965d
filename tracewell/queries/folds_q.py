"""Queries over merges of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import folds as M
from tracewell.queries.registry import query


@query("merge_decisions", "v_step v_edge", """
WITH RECURSIVE s AS (SELECT *, sum((kind IN ('mutation', 'external_effect', 'boundary'))::INT) OVER (PARTITION BY flow ORDER BY ordinal) AS walls FROM v_step),
d AS (SELECT flow, ordinal, walls, partkey % 2 AS purpose FROM s WHERE quantity % 3 > 0 AND kind NOT IN ('mutation', 'external_effect')),
w AS (SELECT DISTINCT e.flow, step_ordinal AS a, target_ordinal AS b FROM v_edge e WHERE resolution_status = 'resolved' AND kind IN ('control_flow', 'sequence')),
l AS (SELECT w.flow, a, b, x.purpose AS p, y.purpose AS q, x.walls AS u, y.walls AS v, count(*) OVER (PARTITION BY w.flow, a) AS outs, count(*) OVER (PARTITION BY w.flow, b) AS ins FROM w JOIN d x ON x.flow = w.flow AND x.ordinal = a JOIN d y ON y.flow = w.flow AND y.ordinal = b),
k AS (SELECT flow, a, b FROM l WHERE outs = 1 AND ins = 1 AND p = q AND u = v),
r AS (SELECT flow, a AS ordinal, a AS chain FROM k WHERE (flow, a) NOT IN (SELECT (flow, b) FROM k) UNION ALL SELECT r.flow, k.b, r.chain FROM r JOIN k ON k.flow = r.flow AND k.a = r.ordinal)
SELECT * FROM r""", by="lineitem.l_orderkey")
def merge_decisions(v):
    steps = v["v_step"].select("flow", "ordinal", "kind", F.when(F.expr("quantity % 3 > 0"), "decision").otherwise("process").alias("role"), F.expr("if(partkey % 2 = 0, 'auth', 'limit')").alias("purpose"), (~F.col("kind").isin("mutation", "external_effect")).alias("plain"), F.lit(1).alias("invocation_id"), F.lit("s").alias("symbol"), F.lit("p").alias("path"))
    return M.merge_decisions(steps, v["v_edge"])


@query("merge_assignments", "v_step v_edge", """
WITH s AS (SELECT *, CASE WHEN partkey % 2 = 0 AND ordinal > 1 THEN ordinal - 1 END AS src FROM v_step),
o AS (SELECT flow, step_ordinal, count(*) AS n, min(target_ordinal) AS dest, bool_and(resolution_status = 'resolved') AS ok FROM v_edge WHERE kind = 'control_flow' GROUP BY 1, 2),
i AS (SELECT flow, target_ordinal, count(*) AS n FROM v_edge WHERE target_ordinal IS NOT NULL GROUP BY 1, 2)
SELECT t.flow, c.ordinal AS call, t.ordinal AS target FROM s t JOIN v_step c ON c.flow = t.flow AND c.ordinal = t.src JOIN o ON o.flow = t.flow AND o.step_ordinal = c.ordinal JOIN i ON i.flow = t.flow AND i.target_ordinal = t.ordinal
WHERE t.kind NOT IN ('branch', 'guard', 'decision', 'external_effect', 'boundary') AND c.kind NOT IN ('branch', 'guard', 'decision', 'external_effect', 'boundary') AND t.invocation_id = c.invocation_id AND o.n = 1 AND o.dest = t.ordinal AND o.ok AND i.n = 1""")
def merge_assignments(v):
    steps = v["v_step"].withColumn("assign_source", F.expr("if(partkey % 2 = 0 and ordinal > 1, ordinal - 1, null)")).withColumn("symbol", F.lit("s")).withColumn("path", F.lit("p"))
    return M.merge_assignments(steps, v["v_edge"])


@query("merge_leaf_calls", "v_step", """
WITH a AS (SELECT *, lag(invocation_id) OVER w AS p, lag(kind) OVER w AS k FROM v_step WINDOW w AS (PARTITION BY flow ORDER BY ordinal)),
b AS (SELECT *, sum((p IS DISTINCT FROM invocation_id)::INT) OVER (PARTITION BY flow ORDER BY ordinal) AS run, count(*) OVER (PARTITION BY flow, invocation_id) AS total FROM a)
SELECT flow, min(ordinal) - 1 AS caller, min(ordinal) AS first, max(ordinal) AS last FROM b GROUP BY flow, run HAVING count(*) >= 2 AND count(*) = max(total) AND arg_min(k, ordinal) = 'call' AND min(ordinal) > 1 AND count(*) FILTER (kind IN ('guard', 'branch', 'decision')) <= 1 AND NOT bool_or(kind IN ('failure', 'throw', 'external_effect'))""")
def merge_leaf_calls(v):
    return M.leaf_runs(v["v_step"])


@query("return_edges", "v_step v_edge", """
WITH e AS (SELECT flow, step_ordinal, min(target_ordinal) AS into_, count(*) AS n FROM v_edge WHERE kind = 'resolved_cross_file' AND resolution_status = 'resolved' GROUP BY 1, 2 HAVING count(*) = 1),
g AS (SELECT flow, step_ordinal, min(target_ordinal) AS next, count(*) AS n FROM v_edge WHERE kind IN ('control_flow', 'sequence') AND resolution_status = 'resolved' GROUP BY 1, 2 HAVING count(*) = 1),
b AS (SELECT flow, invocation_id, min(ordinal) AS source FROM v_step WHERE kind = 'return' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT DISTINCT e.flow, b.source, g.next AS target FROM e JOIN g ON g.flow = e.flow AND g.step_ordinal = e.step_ordinal JOIN v_step s ON s.flow = e.flow AND s.ordinal = e.into_ JOIN b ON b.flow = e.flow AND b.invocation_id = s.invocation_id WHERE b.source >= e.into_""")
def return_edges(v):
    return M.return_edges(v["v_step"], v["v_edge"])


@query("merge_expressions", "v_step", """
WITH s AS (SELECT flow, ordinal, partkey, count(*) OVER (PARTITION BY flow) AS n FROM v_step), m AS (SELECT *, ordinal >= n - 2 AS inside FROM s),
g AS (SELECT flow, max(n) AS n, flow % 3 = 1 AS fork, count(*) FILTER (inside AND partkey % 12 = 0) AS edges, bool_or(inside AND partkey % 6 = 0) AS unknown, bool_or(inside AND partkey % 6 = 1) AS partial FROM m GROUP BY flow
  HAVING max(n) > 1 AND (flow % 3 <> 2 OR count(DISTINCT partkey % 2) = 1) AND NOT bool_or(ordinal = n - 3 AND partkey % 14 = 0) AND NOT bool_or(inside AND (partkey % 29 = 0 OR (ordinal < n AND (partkey % 10 = 0 OR partkey % 8 = 0))))),
k AS (SELECT *, CASE WHEN edges = 1 THEN 'boundary' WHEN n <= 3 THEN 'entry' WHEN fork THEN 'decision' ELSE 'process' END AS role, CASE WHEN unknown THEN 'unknown' WHEN partial THEN 'partial' ELSE 'verified' END AS status FROM g WHERE edges = 0 OR (edges = 1 AND NOT fork AND n > 3))
SELECT m.flow, m.ordinal, CASE WHEN inside AND k.flow IS NOT NULL THEN greatest(m.n - 2, 1) ELSE m.ordinal END AS frame, CASE WHEN inside THEN role END AS merged_role, CASE WHEN inside THEN status END AS merged_status FROM m LEFT JOIN k USING (flow)""", by="lineitem.l_orderkey")
def merge_expressions(v):
    """The last step of each flow is a return or guard around the two before it; the others are calls or, in every third flow, branches."""
    s = v["v_step"].select("flow", "ordinal", "partkey", F.expr("count(*) over (partition by flow)").alias("n"))
    steps = s.select(
        "flow", "ordinal", "partkey", "n", F.lit(1).alias("invocation_id"), F.lit("s").alias("symbol"), F.lit("h").alias("file_hash"), F.expr("if(flow % 3 = 2, concat('p', partkey % 2), 'p')").alias("path"), F.expr("100 * if(ordinal = n, greatest(n - 2, 1), ordinal)").alias("byte_start"),
        F.expr("if(ordinal = n - 3 and partkey % 14 = 0, 100 * (n - 2) + 10, 100 * ordinal + 50)").alias("byte_end"), F.expr("case when ordinal = n and flow % 6 = 1 then 'guard' when ordinal = n then 'return' when partkey % 10 = 0 then 'mutation' when flow % 3 = 1 then 'branch' else 'call' end").alias("kind"),
        F.expr("partkey % 29 = 0").alias("effect"), F.expr("partkey % 12 = 0").alias("boundary"), F.lit(True).alias("single"), F.lit(None).cast("string").alias("state_after"), F.lit(None).cast("string").alias("guard_condition"), F.expr("case partkey % 6 when 0 then 'unknown' when 1 then 'partial' else 'verified' end").alias("status"),
    )
    steps = steps.withColumn("role", F.expr("case when ordinal = 1 then 'entry' when effect then 'effect' when kind in ('branch', 'guard') then 'decision' else 'process' end"))
    ways = "case when ordinal < n and flow % 3 <> 1 then array(struct(ordinal + 1 as b, cast(null as string) as outcome)) when ordinal < n then array(struct(ordinal + 1 as b, 'truthy' as outcome), struct(if(ordinal < n - 2, ordinal + 1, n) as b, 'falsy' as outcome)) when kind = 'guard' then array(struct(n + 1 as b, 'truthy' as outcome), struct(n + 2 as b, 'falsy' as outcome)) end"
    edges = steps.select("flow", F.col("ordinal").alias("step_ordinal"), F.expr(f"inline({ways})").alias("target_ordinal", "outcome"), "partkey", "n").select("flow", "step_ordinal", "target_ordinal", "outcome", F.expr("if(outcome is null, null, step_ordinal)").alias("condition_step"), F.lit("control_flow").alias("kind"), F.expr("if(partkey % 8 = 0 and step_ordinal < n, 'unresolved', 'resolved')").alias("resolution_status"))
    merged = M.merge_expressions(steps, edges)
    frames = M.renumber(steps.select("flow", F.col("ordinal").alias("frame"), "ordinal"), merged)
    return frames.join(merged.select("flow", "ordinal", F.col("role").alias("merged_role"), F.col("status").alias("merged_status")), ["flow", "ordinal"], "left")
