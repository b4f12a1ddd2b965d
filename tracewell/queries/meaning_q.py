"""Queries over classifications, views and smaller checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import anchors as A
from tracewell.operators import graph as H
from tracewell.operators import meaning as N
from tracewell.queries.registry import query


@query("decision_purpose", "v_step", """
SELECT flow, ordinal, CASE partkey % 5 WHEN 0 THEN CASE WHEN partkey % 2 = 0 THEN 'limit' ELSE 'unknown' END WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' WHEN 3 THEN 'mixed' ELSE 'auth' END AS purpose FROM v_step""")
def decision_purpose(v):
    rules = F.when(F.expr("partkey % 5 = 4"), F.array(F.lit("Check Role"))).when(F.expr("partkey % 10 = 0"), F.array(F.lit("daily quota"), F.lit("x")))
    return v["v_step"].select("flow", "ordinal", N.decision_purpose(rules, F.col("symbol")).alias("purpose"))


@query("step_status_v1", "v_step", """
SELECT flow, ordinal, CASE WHEN kind = 'boundary' OR partkey % 7 = 0 THEN 'unknown' WHEN file_hash IS NULL OR partkey % 2 = 0 THEN 'partial' ELSE 'verified' END AS status FROM v_step""")
def step_status_v1(v):
    fresh = F.expr("case when partkey % 7 = 0 then 'orphaned' when file_hash is null then 'stale' else 'fresh' end")
    return v["v_step"].select("flow", "ordinal", N.step_status(F.col("kind"), F.expr("if(partkey % 2 = 0, 'derived', 'approved')"), fresh, F.lit(0.9), F.col("path")).alias("status"))


@query("code_lens", "v_doc", """
WITH d AS (SELECT doc_id, 1 + length(content) - length(replace(content, chr(10), '')) AS n FROM v_doc)
SELECT doc_id, 1 AS focus_start, CASE WHEN doc_id % 2 = 0 THEN least(n, 120) ELSE least(n, 13) END AS view_end FROM d""")
def code_lens(v):
    d = v["v_doc"]
    size = F.octet_length("content")
    anchors = d.select("doc_id", "path", F.lit(0).alias("byte_start"), F.lit(1).alias("byte_end"), F.lit(0).alias("symbol_start"), F.when(F.expr("doc_id % 2 = 0"), size + 1).otherwise(0).alias("symbol_end"))
    return N.code_lens(anchors, d.select("path", "content")).select("doc_id", "focus_start", "view_end")


@query("intent_norm", "v_turn", """
SELECT flow, ordinal, 'task-' || substr(sha256(text), 1, 16) AS task_id, CASE WHEN contains(lower(trim(text)), ' either ') OR starts_with(lower(trim(text)), 'either ') THEN 'needs_confirmation' ELSE 'parsed' END AS status FROM v_turn""")
def intent_norm(v):
    return v["v_turn"].select("flow", "ordinal", N.normalise_request(F.col("text")).alias("r")).select("flow", "ordinal", "r.task_id", "r.status")


@query("detect_lang", "v_path", "SELECT page_id % 50 AS repo_id, CASE WHEN bool_or(page_id % 9 = 5 AND page_id % 4 = 0) THEN 'go' ELSE 'unknown' END AS language FROM v_path GROUP BY 1")
def detect_lang(v):
    rows = v["v_path"].select(F.expr("page_id % 50").alias("repo_id"), F.expr("if(page_id % 9 = 5 and page_id % 4 = 0, 'x/go.mod', path)").alias("path"))
    return N.detect_project(rows)


@query("request_langs", "v_doc", "SELECT DISTINCT repo_id, CASE doc_id % 6 WHEN 0 THEN 'dart' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' WHEN 3 THEN 'dart' WHEN 4 THEN 'typescript' END AS language FROM v_doc WHERE doc_id % 6 <> 5 UNION ALL SELECT repo_id, 'unknown' FROM v_doc GROUP BY 1 HAVING bool_and(doc_id % 6 = 5)")
def request_langs(v):
    return N.request_languages(v["v_doc"])


@query("path_pattern", "v_step", "SELECT flow, ordinal, CASE suppkey % 6 WHEN 0 THEN 'Views' ELSE 'data' END AS layer FROM v_step WHERE suppkey % 6 = 0 OR (suppkey % 6 = 4 AND suppkey % 10 NOT IN (0, 4))")
def path_pattern(v):
    patterns = v["v_step"].sparkSession.createDataFrame([("Views", "lib/views/**"), ("data", "lib/**/m0.dart"), ("data", "lib/data/m[4].dart"), ("data", "lib/*/m4.dart")], "layer string, pattern string")
    return N.path_pattern(v["v_step"].withColumn("layer", F.col("raw_layer")), patterns)


@query("profile_merge", "part", "SELECT p_name AS name, p_brand AS pattern, true AS known FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT n, p_brand, p_brand IS NOT NULL FROM (SELECT p_partkey AS k, p_type || p_partkey AS n FROM part WHERE p_partkey % 3 = 0) c LEFT JOIN part p ON p.p_partkey = c.k AND p.p_partkey % 2 = 1")
def profile_merge(v):
    p = v["part"]
    name = F.concat("p_type", F.col("p_partkey").cast("string")).alias("name")
    return N.profile_merge(p.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("name"), F.col("p_brand").alias("pattern")), p.filter("p_partkey % 2 = 1").select(name, F.col("p_brand").alias("pattern")), p.filter("p_partkey % 3 = 0").select(name))


@query("structural_ids", "v_step", """
WITH b AS (SELECT *, 'step-' || substr(sha256(concat_ws(chr(0), flow::varchar, path, symbol, kind)), 1, 16) AS base FROM v_step)
SELECT flow, ordinal, CASE WHEN row_number() OVER (PARTITION BY flow, base ORDER BY ordinal) = 1 THEN base ELSE 'step-' || substr(sha256(concat_ws(chr(0), base, byte_start::varchar, byte_end::varchar)), 1, 16) END AS step_id, false AS error FROM b""")
def structural_ids(v):
    return N.structural_ids(v["v_step"]).select("flow", "ordinal", "step_id", "error")


@query("query_identity", "v_edge", "SELECT flow AS query_id, sha256(string_agg(DISTINCT kind, ',' ORDER BY kind) || chr(0) || '3' || chr(0) || '50') AS identity FROM v_edge GROUP BY 1")
def query_identity(v):
    return N.query_identity(v["v_edge"].select(F.col("flow").alias("query_id"), F.lit(3).alias("depth"), F.lit(50).alias("budget"), F.col("kind").alias("relation")))


@query("closure_digest", "orders", "SELECT o_orderkey, o_orderkey % 3 > 0 AS valid FROM orders")
def closure_digest(v):
    rows = v["orders"].select("o_orderkey", "o_orderstatus")
    right = F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.lit("\u0000"), "o_orderstatus", F.lit("\u0000")), 256)
    return N.row_digest(rows.withColumn("digest", F.when(F.expr("o_orderkey % 3 > 0"), right).otherwise("x")), "digest").select("o_orderkey", "valid")


@query("frame_match", "v_turn", "WITH f AS (SELECT flow, kind || '|' || kind AS key, count(*) AS n, min(ordinal) AS f FROM v_turn GROUP BY 1, 2) SELECT t.flow, t.kind || '|' || t.kind AS key, CASE WHEN n = 1 THEN f END AS frame FROM v_turn t JOIN f ON f.flow = t.flow AND f.key = t.kind || '|' || t.kind")
def frame_match(v):
    frames = v["v_turn"].select("flow", F.col("ordinal").alias("frame"), F.col("kind").alias("role"), F.lit("").alias("symbol"), F.col("kind").alias("title"))
    return N.frame_match(frames, v["v_turn"].select("flow", F.concat("kind", F.lit("|"), "kind").alias("key")))


@query("exec_edges", "v_edge", "SELECT flow, edge_idx, kind <> 'callback_argument' AND resolution_status = 'resolved' AS executes FROM v_edge")
def exec_edges(v):
    return N.execution_edges(v["v_edge"]).select("flow", "edge_idx", "executes")


@query("branch_gap", "v_edge", "SELECT flow, count(*) AS open FROM (SELECT DISTINCT flow, step_ordinal, target_ordinal FROM v_edge WHERE target_ordinal IS DISTINCT FROM step_ordinal + 1 AND (flow, step_ordinal) IN (SELECT (flow, step_ordinal) FROM v_edge WHERE target_ordinal = step_ordinal + 1)) GROUP BY 1")
def branch_gap(v):
    return N.branch_gap(v["v_edge"].filter("target_ordinal = step_ordinal + 1").select("flow", "step_ordinal", "target_ordinal"), v["v_edge"])


@query("change_side", "v_gen_a v_gen_b", """
SELECT k AS step, CASE WHEN a.k % 4 = 0 THEN 'removed' ELSE 'changed_rule' END AS kind, CASE WHEN a.k % 4 <> 0 AND b.k IS NOT NULL THEN b.path ELSE a.path END AS symbol, CASE WHEN a.k % 4 <> 0 AND b.k IS NOT NULL THEN 'current' ELSE 'baseline' END AS side
FROM v_gen_a a LEFT JOIN v_gen_b b USING (k)""")
def change_side(v):
    side = lambda df: df.select(F.col("k").alias("step"), F.col("path").alias("symbol"))
    changes = v["v_gen_a"].select(F.col("k").alias("step"), F.expr("if(k % 4 = 0, 'removed', 'changed_rule')").alias("kind"))
    return N.change_side(changes, side(v["v_gen_a"]), side(v["v_gen_b"]))


@query("domain_rollup", "part", "SELECT p_brand AS domain, p_type AS kind, count(*) AS flows, count(*) FILTER (p_size > 20) AS covered FROM part GROUP BY ROLLUP (p_brand, p_type)")
def domain_rollup(v):
    return N.domain_rollup(v["part"].select(F.col("p_brand").alias("domain"), F.col("p_type").alias("kind"), (F.col("p_size") > 20).alias("covered")))


@query("trace_checks", "lineitem", """
WITH b AS (SELECT l_orderkey AS trace, l_partkey AS span, bool_or(l_returnflag = 'R') AS c, count(DISTINCT l_linestatus) AS f FROM lineitem GROUP BY 1, 2)
SELECT trace, round(count(*) FILTER (c) / count(*), 6) AS ratio, bool_or(f > 1) AS conflict FROM b GROUP BY 1""")
def trace_checks(v):
    rows = v["lineitem"].select(F.col("l_orderkey").alias("trace"), F.col("l_partkey").alias("span"), (F.col("l_returnflag") == "R").alias("covered"), (F.col("l_linestatus") == "F").alias("failed"))
    return N.trace_checks(rows).withColumn("ratio", F.round("ratio", 6))


@query("impact_map_refs", "v_step v_edge", "SELECT e.flow, 'target_missing' AS rule, count(*) AS n FROM v_edge e LEFT JOIN v_step s ON s.flow = e.flow AND s.ordinal = e.target_ordinal AND s.partkey % 9 <> 0 WHERE e.target_ordinal IS NOT NULL AND s.flow IS NULL GROUP BY 1")
def impact_map_refs(v):
    return N.map_refs(v["v_step"].filter("partkey % 9 <> 0"), v["v_edge"])


@query("alignment_promote", "v_criterion", """
SELECT criterion_id, CASE WHEN criterion_id % 3 = 0 AND criterion_id % 2 = 0 AND criterion_id % 5 <> 0 THEN 'confirmed' WHEN criterion_id % 3 = 0 THEN 'partial' ELSE 'unknown' END AS new_status,
       CASE WHEN criterion_id % 3 = 0 THEN CASE WHEN criterion_id % 2 = 1 THEN 'current_proof_mismatch' WHEN criterion_id % 5 = 0 THEN 'current_evidence_incomplete' END END AS reason FROM v_criterion""")
def alignment_promote(v):
    c = F.col("criterion_id")
    rows = v["v_criterion"].select("criterion_id", c.alias("map"), F.when(c % 3 == 0, "partial").otherwise("unknown").alias("status"), (c % 5 != 0).alias("complete"))
    return N.promote(rows, v["v_criterion"].filter("criterion_id % 2 = 0").select(c.alias("map"))).select("criterion_id", "new_status", "reason")


@query("batch_roots", "v_gen_a v_gen_b", "SELECT a.k AS step FROM v_gen_a a JOIN v_gen_b b USING (k) WHERE a.status <> b.status AND a.path IN (SELECT path FROM v_gen_a WHERE k % 3 = 0)")
def batch_roots(v):
    b = v["v_gen_b"].select("k", F.col("status").alias("now"))
    changes = v["v_gen_a"].join(b, "k").select(F.col("k").alias("step"), (F.col("status") != F.col("now")).alias("verified"))
    return N.batch_roots(changes, v["v_gen_a"].select(F.col("k").alias("step"), "path"), v["v_gen_a"].filter("k % 3 = 0"))


@query("brace_span", "events", "SELECT event_id AS doc_id, 0 AS start, strlen(props) AS \"end\" FROM events")
def brace_span(v):
    return A.brace_spans(v["events"].select(F.col("event_id").alias("doc_id"), F.col("props").alias("content"), F.lit(0).cast("long").alias("start")))


@query("decl_find", "v_step", "SELECT flow, ordinal, CASE WHEN partkey % 2 = 0 THEN 'func ' || split_part(symbol, '.', 2) || '(a int) {' END AS line FROM v_step")
def decl_find(v):
    name = F.split_part("symbol", F.lit("."), F.lit(2))
    rows = v["v_step"].select("flow", "ordinal", "symbol", F.concat(F.lit("// "), name, F.expr("if(partkey % 2 = 0, '\\n  func ', '\\n x ')"), name, F.lit("(a int) {\n}\n")).alias("content"))
    return N.find_declaration(rows).select("flow", "ordinal", F.ltrim("line").alias("line"))


@query("scope_closure", "v_call", """
WITH RECURSIVE b AS (SELECT DISTINCT caller AS node FROM v_call WHERE caller IN ('n1', 'n2') UNION SELECT caller FROM b JOIN v_call ON callee = node WHERE caller LIKE 's%' OR caller LIKE 'p%')
SELECT node FROM b""")
def scope_closure(v):
    """Everything that leads to a scope, but for the callers at the entry."""
    back = v["v_call"].filter("caller like 's%' or caller like 'p%'").select(F.col("callee").alias("source"), F.col("caller").alias("target"))
    roots = v["v_call"].filter(F.col("caller").isin("n1", "n2")).select(F.lit(0).alias("root"), F.col("caller").alias("node")).distinct()
    return H.reachable(roots, back).select("node").distinct()


@query("scope_closure_all", "v_call_all", """
WITH RECURSIVE b AS (SELECT DISTINCT caller AS scope, caller AS node FROM v_call_all WHERE caller LIKE 'n%' UNION SELECT scope, caller FROM b JOIN v_call_all ON callee = node WHERE caller LIKE 's%' OR caller LIKE 'p%')
SELECT scope, node FROM b""")
def scope_closure_all(v):
    """What leads to each nation, but for the callers at the entry."""
    edges = v["v_call_all"]
    back = edges.filter("caller like 's%' or caller like 'p%'").select(F.col("callee").alias("source"), F.col("caller").alias("target"))
    roots = edges.filter("caller like 'n%'").select(F.col("caller").alias("root"), F.col("caller").alias("node")).distinct()
    return H.reachable(roots, back).select(F.col("root").alias("scope"), "node")


@query("focus_resolve", "v_call", """
WITH n AS (SELECT caller, count(DISTINCT callee) AS n, min(callee) AS only_one FROM v_call WHERE status = 'verified' AND caller LIKE 's%' GROUP BY 1)
SELECT c.caller AS symbol, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS outcome, CASE WHEN n = 1 THEN only_one END AS focus FROM (SELECT DISTINCT caller FROM v_call) c LEFT JOIN n USING (caller)""")
def focus_resolve(v):
    from tracewell.operators.fuse import carry_selection

    calls = v["v_call"].filter("status = 'verified' and caller like 's%'").select(F.col("caller").alias("identity"), F.col("callee").alias("step")).distinct()
    some = calls.select(F.col("identity").alias("symbol"), F.lit(True).alias("_some")).distinct()
    out = carry_selection(v["v_call"].select(F.col("caller").alias("identity")).distinct(), calls).withColumnRenamed("identity", "symbol").join(some, "symbol", "left")
    return out.select("symbol", F.when(~F.col("identity_lost"), "resolved").when(F.col("_some"), "ambiguous").otherwise("unresolved").alias("outcome"), F.col("step").alias("focus"))
