"""Queries over smaller contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import contracts as K
from tracewell.queries.flows_q import _TOKENS
from tracewell.queries.registry import query


@query("delta_dimensions", "v_path nation", """
WITH d AS (SELECT page_id % 40 AS repo, page_id % 9 AS kind, CASE page_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' ELSE 'renamed' END AS change FROM v_path WHERE page_id % 40 < 30),
b AS (SELECT repo, bool_or(change <> 'modified') AS m, bool_or(kind = 7 AND change <> 'renamed') AS r, bool_or(kind IN (3, 4, 5)) AS i FROM d GROUP BY 1), s AS (SELECT n_nationkey AS repo, n_nationkey % 3 = 0 AS differs FROM nation)
SELECT repo, coalesce(m, false) AS membership, coalesce(r, false) AS resolution, coalesce(i, false) AS "index", coalesce(r, false) OR coalesce(differs, false) AS configuration, coalesce(i, false) AS contract FROM b FULL JOIN s USING (repo)""")
def delta_dimensions(v):
    delta = v["v_path"].filter("page_id % 40 < 30").select(F.expr("page_id % 40").alias("repo"), "path", F.expr("case page_id % 4 when 0 then 'added' when 1 then 'modified' when 2 then 'deleted' else 'renamed' end").alias("change"))
    return K.delta_dimensions(delta, v["nation"].select(F.col("n_nationkey").alias("repo"), F.lit("a").alias("before"), F.expr("if(n_nationkey % 3 = 0, null, 'a')").alias("after")))


@query("impact_map_rules", "v_step v_edge", """
WITH s AS (SELECT flow AS map, CASE WHEN partkey % 41 = 0 THEN '' WHEN partkey % 43 = 0 THEN 's1' ELSE 's' || ordinal END AS step, CASE WHEN partkey % 47 = 0 THEN ' ' ELSE symbol END AS technical, CASE WHEN partkey % 5 = 0 THEN NULL ELSE 'in.' || symbol END AS enclosing, CASE WHEN partkey % 53 = 0 THEN '' ELSE path END AS path FROM v_step),
e AS (SELECT flow AS map, 'e' || edge_idx AS edge, 's' || step_ordinal AS a, 's' || target_ordinal AS b, CASE WHEN edge_idx % 3 = 0 THEN 'in.' || to_symbol WHEN edge_idx % 11 = 0 THEN 'other' ELSE to_symbol END AS t, kind FROM v_edge),
j AS (SELECT e.*, (SELECT count(*) FROM s WHERE s.map = e.map AND s.step = a) AS na, (SELECT count(*) FROM s WHERE s.map = e.map AND s.step = b) AS nb, (SELECT count(*) FROM s WHERE s.map = e.map AND s.step = b AND (technical = t OR enclosing = t)) AS same FROM e)
SELECT DISTINCT map, step AS "at", 'step_identity' AS rule FROM s WHERE step = '' OR (trim(technical) = '' AND enclosing IS NULL) OR path = '' UNION ALL SELECT map, step, 'step_repeated' FROM s GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT map, edge, 'edge_unresolved' FROM j WHERE b IS NULL OR t IS NULL OR na = 0 OR nb = 0 UNION ALL SELECT map, edge, 'edge_symbol' FROM j WHERE b IS NOT NULL AND t IS NOT NULL AND na > 0 AND nb > 0 AND same = 0""")
def impact_map_rules(v):
    s = v["v_step"].select(F.col("flow").alias("map"), F.expr("case when partkey % 41 = 0 then '' when partkey % 43 = 0 then 's1' else concat('s', ordinal) end").alias("step"), F.expr("if(partkey % 47 = 0, ' ', symbol)").alias("technical"), F.expr("if(partkey % 5 = 0, null, concat('in.', symbol))").alias("enclosing"), F.expr("if(partkey % 53 = 0, '', path)").alias("path"))
    e = v["v_edge"].select(F.col("flow").alias("map"), F.expr("concat('e', edge_idx)").alias("edge"), F.expr("concat('s', step_ordinal)").alias("from_step"), F.expr("concat('s', target_ordinal)").alias("to_step"), F.expr("case when edge_idx % 3 = 0 then concat('in.', to_symbol) when edge_idx % 11 = 0 then 'other' else to_symbol end").alias("to_symbol"), "kind")
    return K.impact_map_rules(s, e)


_FRAMES = """
c_step AS (SELECT flow, ordinal AS step, ordinal AS position, partkey % 5 > 0 AS verified, partkey % 31 = 0 AS boundary, partkey FROM v_step),
c_member AS (SELECT flow, (step + 1) // 2 AS frame, CASE WHEN partkey % 13 = 0 THEN 10 - step ELSE step END AS place, CASE WHEN partkey % 37 = 0 THEN 99 WHEN partkey % 17 = 0 THEN 1 ELSE step END AS step FROM c_step WHERE partkey % 19 > 0),
c_frame AS (SELECT flow, (step + 1) // 2 AS frame, CASE WHEN max(partkey) % 23 = 0 THEN 1 ELSE (step + 1) // 2 END AS ordinal, CASE WHEN max(partkey) % 2 = 0 THEN 'verified' ELSE 'partial' END AS status, max(step) AS primary FROM c_step GROUP BY flow, (step + 1) // 2),
c_limit AS (SELECT flow, CASE WHEN partkey % 29 = 0 THEN 77 ELSE (step + 1) // 2 END AS frame FROM c_step WHERE partkey % 7 = 0)"""


@query("frame_rules", "v_step", f"""
WITH {_FRAMES},
m AS (SELECT c.flow, c.frame, c.place, c.step, s.position, s.verified, s.boundary, count(*) OVER (PARTITION BY c.flow, c.step) AS n, lag(s.position) OVER (PARTITION BY c.flow, c.frame ORDER BY c.place) AS before FROM c_member c LEFT JOIN c_step s ON s.flow = c.flow AND s.step = c.step),
b AS (SELECT flow, frame, bool_or(position IS NULL) AS missing, bool_or(n > 1) AS shared, bool_or(position <= before) AS disorder, min(place) AS p, bool_or(NOT coalesce(verified, false) OR coalesce(boundary, false)) AS weak, list(step) AS steps FROM m GROUP BY 1, 2),
f AS (SELECT b.*, m.position AS first FROM b JOIN m ON m.flow = b.flow AND m.frame = b.frame AND m.place = b.p),
r AS (SELECT c.*, f.* EXCLUDE (flow, frame), row_number() OVER (PARTITION BY c.flow ORDER BY ordinal, c.frame) AS rank, lag(f.first) OVER (PARTITION BY c.flow ORDER BY ordinal, c.frame) AS last FROM c_frame c LEFT JOIN f ON f.flow = c.flow AND f.frame = c.frame)
SELECT flow, frame, 'frame_ordinal' AS rule FROM r WHERE ordinal <> rank UNION ALL SELECT flow, frame, 'frame_empty' FROM r WHERE steps IS NULL UNION ALL SELECT flow, frame, 'step_missing' FROM r WHERE missing UNION ALL SELECT flow, frame, 'step_shared' FROM r WHERE shared UNION ALL SELECT flow, frame, 'children_order' FROM r WHERE disorder
UNION ALL SELECT flow, frame, 'frame_order' FROM r WHERE first <= last UNION ALL SELECT flow, frame, 'promoted' FROM r WHERE status = 'verified' AND weak UNION ALL SELECT flow, frame, 'primary' FROM r WHERE steps IS NOT NULL AND NOT list_contains(steps, r.primary)
UNION ALL SELECT DISTINCT flow, NULL::BIGINT, 'step_uncovered' FROM c_step s WHERE NOT EXISTS (SELECT 1 FROM c_member c WHERE c.flow = s.flow AND c.step = s.step)
UNION ALL SELECT l.flow, l.frame, 'limitation' FROM c_limit l LEFT JOIN c_frame c ON c.flow = l.flow AND c.frame = l.frame GROUP BY 1, 2 HAVING count(*) > 1 OR bool_or(c.flow IS NULL)""")
def frame_rules(v):
    spark = v["v_step"].sparkSession
    table = lambda name: spark.sql(f"WITH {_FRAMES.replace('//', 'div')} SELECT * FROM {name}")
    return K.frame_rules(table("c_frame"), table("c_member"), table("c_step").drop("partkey"), table("c_limit"))


@query("trace_rules", "events", """
WITH n AS (SELECT 't' || user_id AS trace, 'n' || event_id AS node, event_type, event_id FROM events)
SELECT trace, node AS "at", 'evidence_missing' AS rule FROM n WHERE event_type IN ('view', 'click') AND event_id % 5 = 0 UNION ALL SELECT DISTINCT trace, NULL, 'conflict_hidden' FROM n WHERE event_type = 'error' AND trace IN (SELECT 't' || user_id FROM events GROUP BY 1 HAVING max(event_id) % 2 = 0)
UNION ALL SELECT trace, 'o' || event_id, 'approval_missing' FROM n WHERE event_id % 7 = 0 AND event_id % 3 > 0""")
def trace_rules(v):
    e = v["events"].withColumn("trace", F.expr("concat('t', user_id)"))
    nodes = e.select("trace", F.expr("concat('n', event_id)").alias("node"), F.expr("case event_type when 'view' then 'runtime_observed' when 'click' then 'corroborated' when 'error' then 'conflicting' else 'static' end").alias("status"), F.expr("if(event_id % 5 = 0, cast(array() as array<string>), array('e'))").alias("evidence"))
    seen = e.select("trace", F.expr("concat('o', event_id)").alias("observation"), F.expr("if(event_id % 7 = 0, 'trusted_local', 'sandbox')").alias("isolation"), F.expr("if(event_id % 3 = 0, true, null)").alias("approved"))
    return K.trace_rules(e.groupBy("trace").agg((F.max("event_id") % 2 > 0).alias("has_conflicts")), nodes, seen)


@query("flow_catalog", "orders", """
WITH o AS (SELECT o_custkey % 50 AS domain, 'f' || CASE WHEN o_orderkey % 37 = 0 THEN 0 ELSE o_orderkey END AS flow, o_orderkey AS position, o_orderkey % 11 - CASE WHEN o_orderkey % 41 = 0 THEN 20 ELSE 0 END AS complexity, o_orderkey % 23 = 0 AS bare FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY complexity DESC, flow, position) AS place, row_number() OVER (PARTITION BY domain, flow ORDER BY position) AS n, lag(complexity) OVER w AS c, lag(flow) OVER w AS f FROM o WINDOW w AS (PARTITION BY domain ORDER BY position))
SELECT domain, place, flow, CASE WHEN bare OR complexity < 0 THEN 'ungrounded' WHEN n > 1 THEN 'repeated' WHEN complexity > c OR (complexity = c AND flow < f) THEN 'order' END AS rule FROM r""")
def flow_catalog(v):
    o = v["orders"].select(F.expr("o_custkey % 50").alias("domain"), F.expr("concat('f', if(o_orderkey % 37 = 0, 0, o_orderkey))").alias("flow"), F.col("o_orderkey").alias("position"), F.expr("o_orderkey % 11 - if(o_orderkey % 41 = 0, 20, 0)").alias("complexity"), F.expr("if(o_orderkey % 23 = 0 and o_orderkey % 2 = 0, ' ', 'm')").alias("map"), F.expr("if(o_orderkey % 23 = 0 and o_orderkey % 2 = 1, cast(array() as array<string>), array('e'))").alias("evidence"))
    return K.catalog(o)


@query("batch_targets", "v_gen_a", """
WITH c AS (SELECT DISTINCT CASE WHEN k % 4 = 0 THEN k + 1 ELSE k END AS step FROM v_gen_a WHERE k % 7 > 0 AND k % 5 > 1), s AS (SELECT c.step FROM c JOIN v_gen_a a ON a.k = c.step WHERE a.k % 3 = 0)
SELECT step FROM s WHERE step % 2 = 0 OR step % 11 < 6""")
def batch_targets(v):
    g = v["v_gen_a"]
    name = lambda x: F.concat(F.lit("s"), F.expr(x).cast("string"))
    changes = g.select(name("k").alias("step"), F.when(F.expr("k % 4 = 0"), name("k + 1")).otherwise("").alias("to_step"), F.expr("if(k % 7 = 0, 'candidate', 'verified')").alias("validation"), F.expr("case k % 5 when 0 then 'unknown' when 1 then 'unobserved' end").alias("epistemic"))
    batch = g.filter("k % 3 = 0").select("path", F.expr("concat('r', k)").alias("revision"))
    proofs = g.filter("k % 2 = 1").select(name("k").alias("step"), F.expr("if(k % 11 < 6, concat('r', k), 'other')").alias("revision"))
    return K.batch_targets(batch, changes, g.select(name("k").alias("step"), "path"), proofs).select(F.substring("step", 2, 20).cast("long").alias("step"))


@query("alignment_run", "v_criterion v_turn", f"""
WITH a AS (SELECT criterion_id, {_TOKENS.format("text")} AS t FROM v_criterion), s AS (SELECT flow * 100 + ordinal AS step, lower(text) AS said, flow % 45 AS rule, flow FROM v_turn WHERE flow % 9 > 0),
m AS (SELECT criterion_id, step, flow FROM a JOIN s ON rule = criterion_id OR (criterion_id % 4 = 0 AND (len(list_filter(t, lambda x: contains(said, x))) >= 2 OR (len(t) = 1 AND contains(said, t[1]))))),
r AS (SELECT *, flow % 12 AS k FROM m WHERE step % 5 > 1),
b AS (SELECT criterion_id, bool_or(k IN (1, 5)) AS odd, bool_or(k IN (2, 3, 4)) AS old, bool_or(k IN (0, 1, 2, 6, 7, 8, 9, 10, 11)) AS code, bool_or(k = 7) AS other FROM r GROUP BY 1)
SELECT c.criterion_id, (SELECT count(DISTINCT step) FROM m WHERE m.criterion_id = c.criterion_id) AS steps, CASE WHEN c.criterion_id NOT IN (SELECT criterion_id FROM m) THEN 'not_observed' WHEN odd IS NULL THEN 'unknown' WHEN odd THEN 'conflicting' WHEN old OR c.criterion_id % 3 = 0 OR NOT code OR other THEN 'partial' ELSE 'confirmed' END AS status,
  CASE WHEN NOT odd AND NOT old AND c.criterion_id % 3 > 0 AND code AND other THEN 'current_evidence_incomplete' END AS reason FROM v_criterion c LEFT JOIN b USING (criterion_id)""")
def alignment_run(v):
    """Criteria not divisible by 4 are named by rules alone; evidence is of an agent, in conflict, old, stale, unknown, of another snapshot, or good."""
    criteria = v["v_criterion"].select("criterion_id", F.expr("if(criterion_id % 4 = 0, text, '')").alias("text"), F.expr("if(criterion_id % 3 = 0, array('test'), array('code'))").alias("required"))
    turns = v["v_turn"].filter("flow % 9 > 0").withColumn("step", F.expr("flow * 100 + ordinal"))
    steps = turns.select("step", "text", F.array(F.expr("flow % 45").cast("string")).alias("rules"))
    own = turns.filter("step % 5 > 1").withColumn("evidence_id", F.concat(F.lit("e"), F.col("step").cast("string")))
    evidence = own.filter("flow % 12 <> 4").select("evidence_id", F.lit("code").alias("kind"), F.expr("if(flow % 12 = 1, 'agent', 'code')").alias("authority"), F.expr("if(flow % 12 = 2, 'old', 'b')").alias("basis"), F.expr("case flow % 12 when 3 then 'stale' when 5 then 'conflicting' else 'verified' end").alias("validation"), F.expr("if(flow % 12 = 7, 't', 's')").alias("snapshot"))
    proofs = v["v_turn"].sparkSession.createDataFrame([("b", "s", True), ("b", "t", True), ("a", "s", True)], "basis string, snapshot string, passed boolean")
    return K.align(criteria, steps, own.select("step", "evidence_id"), evidence, "b", "s", proofs)
