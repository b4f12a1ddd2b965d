"""Queries over graphs, generations, rules and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import diff as I
from tracewell.operators import graph as H
from tracewell.operators import rules as J
from tracewell.queries.registry import query
from tracewell.streaming import twins as K

_DELTA = """
d AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.content_id <> b.content_id THEN 'modified' END AS change, a.content_id AS old, b.content_id AS new FROM v_gen_a a FULL JOIN v_gen_b b ON a.path = b.path)"""


@query("snapshot_delta", "v_gen_a v_gen_b", f"WITH {_DELTA} SELECT path, change FROM d WHERE change IS NOT NULL")
def snapshot_delta(v):
    return I.snapshot_delta(v["v_gen_a"], v["v_gen_b"]).select("path", "change")


@query("rename_detect", "v_gen_a v_gen_b", f"WITH {_DELTA}, n AS (SELECT new, min(path) AS p FROM d WHERE change = 'added' GROUP BY 1 HAVING count(*) = 1) SELECT path AS old_path, p AS new_path FROM d JOIN n ON d.old = n.new WHERE change = 'deleted'")
def rename_detect(v):
    return I.renames(I.snapshot_delta(v["v_gen_a"], v["v_gen_b"]))


@query("delta_flags", "v_gen_a v_gen_b v_path", "SELECT true AS membership, bool_or(page_id % 9 = 7) AS resolution, bool_or(page_id % 9 IN (3, 4, 5)) AS index, false AS configuration FROM v_path")
def delta_flags(v):
    p = v["v_path"].select("path", F.lit("c").alias("content_id"))
    return I.delta_flags(I.snapshot_delta(p.limit(0), p))


@query("flow_delta", "v_gen_a v_gen_b", """
WITH a AS (SELECT k % 1000 AS symbol, arg_max(status, k) AS s FROM v_gen_a GROUP BY 1), b AS (SELECT k % 1000 AS symbol, arg_max(status, k) AS s FROM v_gen_b GROUP BY 1)
SELECT coalesce(a.symbol, b.symbol) AS symbol, CASE WHEN a.symbol IS NULL THEN 'added' WHEN b.symbol IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (symbol) WHERE a.s IS DISTINCT FROM b.s""")
def flow_delta(v):
    spec = lambda df: df.select(F.expr("k % 1000").alias("symbol"), F.col("k").alias("ordinal"), F.col("status").alias("name"), F.lit("x").alias("kind"))
    return I.flow_delta(spec(v["v_gen_a"]), spec(v["v_gen_b"]))


@query("comparable", "orders", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'identity_missing' WHEN o_orderkey % 3 = 0 THEN 'repo' WHEN o_orderkey % 2 = 0 THEN 'epoch' END AS reason FROM orders")
def comparable(v):
    side = lambda g, r, e: F.struct(F.expr(g).alias("generation"), F.lit(1).alias("schema"), F.expr(r).alias("repo"), F.lit("m").alias("mode"), F.lit("t").alias("task"), F.expr(e).alias("epoch"))
    rows = v["orders"].select(F.col("o_orderkey").alias("k"), side("if(o_orderkey % 5 = 0, null, 'g')", "'r'", "0").alias("a"), side("'h'", "if(o_orderkey % 3 = 0, 'q', 'r')", "(o_orderkey + 1) % 2").alias("b"))
    return I.comparable(rows).select("k", "reason")


@query("semantic_delta", "v_gen_a v_gen_b", """
WITH a AS (SELECT path AS id, k % 10000000 AS structure, status AS behavior, content_id AS evidence FROM v_gen_a), b AS (SELECT path AS id, k % 10000000 AS structure, status AS behavior, content_id AS evidence FROM v_gen_b),
ra AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM b)), rb AS (SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)),
c AS (SELECT structure, (SELECT count(*) FROM ra WHERE ra.structure = x.structure) AS na, (SELECT count(*) FROM rb WHERE rb.structure = x.structure) AS nb FROM (SELECT structure FROM ra UNION SELECT structure FROM rb) x),
m AS (SELECT a.id AS aid, b.id AS bid, a.behavior AS ab, b.behavior AS bb, a.evidence AS ae, b.evidence AS be, a.structure AS sa, b.structure AS sb FROM a JOIN b ON a.id = b.id
  UNION ALL SELECT ra.id, rb.id, ra.behavior, rb.behavior, ra.evidence, rb.evidence, ra.structure, rb.structure FROM ra JOIN rb USING (structure) JOIN c USING (structure) WHERE na = 1 AND nb = 1)
SELECT bid AS step, CASE WHEN ab <> bb THEN 'changed_rule' WHEN ae <> be THEN 'evidence_updated' ELSE 'structural_only' END AS change FROM m WHERE ab <> bb OR ae <> be OR aid <> bid OR sa <> sb
UNION ALL SELECT id, CASE WHEN nb = 0 THEN 'removed_behavior' ELSE 'ambiguous_move' END FROM ra JOIN c USING (structure) WHERE NOT (na = 1 AND nb = 1)
UNION ALL SELECT id, CASE WHEN na = 0 THEN 'added_behavior' ELSE 'ambiguous_move' END FROM rb JOIN c USING (structure) WHERE NOT (na = 1 AND nb = 1)""")
def semantic_delta(v):
    steps = lambda df: df.select(F.col("path").alias("id"), F.expr("k % 10000000").alias("structure"), F.col("status").alias("behavior"), F.col("content_id").alias("evidence"))
    return I.semantic_delta(steps(v["v_gen_a"]), steps(v["v_gen_b"]))


@query("relation_delta", "v_edge", """
WITH r AS (SELECT step_ordinal AS source, to_symbol AS target, flow * 1000 + edge_idx AS seq, kind AS state, flow % 2 AS g FROM v_edge),
a AS (SELECT source, target, arg_max(state, seq) AS s FROM r WHERE g = 0 GROUP BY 1, 2), b AS (SELECT source, target, arg_max(state, seq) AS s FROM r WHERE g = 1 GROUP BY 1, 2)
SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.source = b.source AND a.target = b.target WHERE a.s IS DISTINCT FROM b.s""")
def relation_delta(v):
    rows = v["v_edge"].select(F.col("step_ordinal").alias("source"), F.col("to_symbol").alias("target"), F.expr("flow * 1000 + edge_idx").alias("seq"), F.col("kind").alias("state"), F.expr("flow % 2").alias("g"))
    return I.relation_delta(rows.filter("g = 0"), rows.filter("g = 1"))


@query("change_facets", "v_gen_a v_gen_b", "SELECT a.k, concat_ws(',', CASE WHEN a.status <> b.status THEN 'behavior' END, CASE WHEN a.content_id <> b.content_id THEN 'evidence' END, CASE WHEN a.path <> b.path THEN 'structure' END) AS facets FROM v_gen_a a JOIN v_gen_b b USING (k)")
def change_facets(v):
    b = v["v_gen_b"].select("k", *(F.col(c).alias(f"b_{c}") for c in ("status", "content_id", "path")))
    pairs = v["v_gen_a"].join(b, "k")
    return I.change_facets(pairs, {"behavior": ("status", "b_status"), "evidence": ("content_id", "b_content_id"), "structure": ("path", "b_path")}).select("k", F.array_join("facets", ",").alias("facets"))


@query("already_applied", "v_gen_a v_gen_b", "SELECT a.k // 5 AS batch, bool_and(b.content_id IS NOT NULL AND a.content_id = b.content_id) AS applied FROM v_gen_a a LEFT JOIN v_gen_b b ON a.path = b.path GROUP BY 1")
def already_applied(v):
    return I.already_applied(v["v_gen_a"].select(F.expr("k div 5").alias("batch"), "path", "content_id"), v["v_gen_b"])


@query("reachable", "v_call", """
WITH RECURSIVE w AS (SELECT caller AS root, callee AS node, 1 AS depth FROM v_call WHERE caller IN ('c1', 'c2', 'c7') AND status = 'verified'
  UNION SELECT root, callee, depth + 1 FROM w JOIN v_call ON caller = node WHERE status = 'verified' AND depth < 6)
SELECT root, node, min(depth) AS depth FROM w GROUP BY 1, 2 UNION ALL SELECT DISTINCT caller, caller, 0 FROM v_call WHERE caller IN ('c1', 'c2', 'c7')""")
def reachable(v):
    roots = v["v_call"].filter(F.col("caller").isin("c1", "c2", "c7")).select(F.col("caller").alias("root"), F.col("caller").alias("node")).distinct()
    return H.reachable(roots, v["v_call"].filter("status = 'verified'").select(F.col("caller").alias("source"), F.col("callee").alias("target")))


@query("reachable_all", "v_call_all", """
WITH RECURSIVE w AS (SELECT DISTINCT caller AS root, caller AS node, 0 AS depth FROM v_call_all WHERE caller LIKE 'c%'
  UNION SELECT root, callee, depth + 1 FROM w JOIN v_call_all ON caller = node WHERE status = 'verified')
SELECT root, node, min(depth) AS depth FROM w GROUP BY 1, 2""")
def reachable_all(v):
    """From every customer, over all parts."""
    edges = v["v_call_all"]
    roots = edges.filter("caller like 'c%'").select(F.col("caller").alias("root"), F.col("caller").alias("node")).distinct()
    return H.reachable_in_passes(roots, edges.filter("status = 'verified'").select(F.col("caller").alias("source"), F.col("callee").alias("target")))


def _impact(v):
    edges = v["v_call"].groupBy("caller", "callee").agg(F.max("status").alias("status")).withColumn("idx", F.hash("caller"))
    roots = v["nation"].select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("root")).withColumn("node", F.col("root"))
    return H.impact(roots, edges, depth=3, budget=30)


@query("impact_callers", "v_call nation")
def impact_callers(v):
    """Claims of callers up to three levels, within thirty nodes of each nation."""
    return _impact(v)[0]


@query("impact_frontiers", "v_call nation")
def impact_frontiers(v):
    """Where the walk of impact_callers stopped, and why."""
    return _impact(v)[1]


@query("call_expand", "v_call", """
WITH RECURSIVE p AS (SELECT DISTINCT caller, callee FROM v_call),
w AS (SELECT DISTINCT caller AS entry, [caller] AS path, caller AS node, 0 AS depth, false AS cycle FROM p WHERE caller IN ('c1', 'c2')
  UNION ALL SELECT entry, list_append(path, callee), callee, depth + 1, list_contains(path, callee) FROM w JOIN p ON p.caller = w.node WHERE NOT cycle AND depth < 3)
SELECT entry, array_to_string(path, '>') AS path, depth, cycle, depth = 3 AND NOT cycle AND node IN (SELECT caller FROM p) AS truncated FROM w""")
def call_expand(v):
    entries = v["v_call"].filter(F.col("caller").isin("c1", "c2")).select(F.col("caller").alias("node")).distinct()
    return H.expand_calls(entries, v["v_call"], 3).select("entry", F.array_join("path", ">").alias("path"), "depth", "cycle", "truncated")


@query("call_expand_all", "v_call_all", """
WITH p AS (SELECT DISTINCT caller, callee FROM v_call_all),
l1 AS (SELECT c.caller AS entry, c.callee AS a FROM p c WHERE c.caller LIKE 'c%'), l2 AS (SELECT entry, a, callee AS b FROM l1 JOIN p ON caller = a)
SELECT DISTINCT entry, entry AS path, 0 AS depth, false AS cycle, false AS truncated FROM l1 UNION ALL SELECT entry, concat_ws('>', entry, a), 1, false, false FROM l1 UNION ALL SELECT entry, concat_ws('>', entry, a, b), 2, false, true FROM l2""")
def call_expand_all(v):
    """Every customer's call tree to the second call; no node calls back here."""
    entries = v["v_call_all"].filter("caller like 'c%'").select(F.col("caller").alias("node")).distinct()
    return H.expand_calls(entries, v["v_call_all"], 2).select("entry", F.array_join("path", ">").alias("path"), "depth", "cycle", "truncated")


@query("source_boundary", "v_step v_edge", """
WITH RECURSIVE e AS (SELECT DISTINCT flow, step_ordinal, target_ordinal FROM v_edge WHERE target_ordinal IS NOT NULL), s AS (SELECT flow, ordinal, file_hash IS NOT NULL AS readable FROM v_step),
w AS (SELECT flow, ordinal FROM s WHERE NOT readable UNION SELECT e.flow, e.step_ordinal FROM w JOIN s ON s.flow = w.flow AND s.ordinal = w.ordinal AND NOT s.readable JOIN e ON e.flow = w.flow AND e.target_ordinal = w.ordinal)
SELECT DISTINCT flow, ordinal FROM w JOIN s USING (flow, ordinal) WHERE readable""")
def source_boundary(v):
    return H.source_boundary(v["v_step"].withColumn("readable", F.col("file_hash").isNotNull()), v["v_edge"].filter("target_ordinal is not null"))


@query("exec_refs", "v_step v_edge", """
WITH k AS (SELECT flow, ordinal, invocation_id, kind FROM v_step),
j AS (SELECT e.flow, edge_idx, e.kind, e.target_ordinal, a.invocation_id AS ai, a.kind AS ak, b.invocation_id AS bi FROM v_edge e LEFT JOIN k a ON a.flow = e.flow AND a.ordinal = e.step_ordinal LEFT JOIN k b ON b.flow = e.flow AND b.ordinal = e.target_ordinal)
SELECT flow, 'target_missing' AS rule, edge_idx AS at FROM j WHERE target_ordinal IS NOT NULL AND bi IS NULL
UNION ALL SELECT flow, 'crosses_invocation', edge_idx FROM j WHERE ai <> bi AND kind NOT IN ('resolved_cross_file', 'return', 'callback_argument')
UNION ALL SELECT flow, 'after_return', edge_idx FROM j WHERE ak = 'return' AND kind = 'sequence'""")
def exec_refs(v):
    return J.execution_refs(v["v_step"], v["v_edge"])


@query("assign_refs", "v_step", """
WITH s AS (SELECT *, CASE WHEN partkey % 4 = 0 THEN ordinal - 1 END AS src FROM v_step)
SELECT a.flow, a.ordinal FROM s a LEFT JOIN s b ON b.flow = a.flow AND b.ordinal = a.src WHERE a.src IS NOT NULL AND (b.flow IS NULL OR b.suppkey % 5 IS DISTINCT FROM a.suppkey % 5)""")
def assign_refs(v):
    """Later steps span earlier ones here; only those of one file hold."""
    rows = v["v_step"].withColumn("assign_source", F.expr("if(partkey % 4 = 0, ordinal - 1, null)"))
    return J.assignment_refs(rows.withColumn("byte_start", -F.col("ordinal")).withColumn("file_hash", F.expr("suppkey % 5")))


@query("sequence_refs", "v_step", """
WITH f AS (SELECT flow, ordinal FROM v_step WHERE partkey % 7 <> 0 UNION ALL SELECT flow, ordinal FROM v_step WHERE partkey % 11 = 0), n AS (SELECT flow, ordinal, count(*) AS n FROM f GROUP BY 1, 2)
SELECT s.flow, s.ordinal, CASE WHEN n IS NULL THEN 'uncovered' ELSE 'shared' END AS rule FROM v_step s LEFT JOIN n USING (flow, ordinal) WHERE n IS NULL OR n > 1""")
def sequence_refs(v):
    f = v["v_step"].select("flow", "ordinal", F.col("ordinal").alias("frame"), "partkey")
    return J.sequence_refs(f.filter("partkey % 7 <> 0").union(f.filter("partkey % 11 = 0")).drop("partkey"), v["v_step"])


@query("size_caps", "v_step v_edge", "SELECT flow, 'steps' AS what, count(*) AS n FROM v_step GROUP BY 1 HAVING count(*) > 9 UNION ALL SELECT flow, 'edges', count(*) FROM v_edge GROUP BY 1 HAVING count(*) > 9")
def size_caps(v):
    return J.size_caps(v["v_step"], v["v_edge"], 9)


@query("read_set", "v_doc v_doc_prev", """
SELECT d.doc_id, CASE WHEN p.path IS NULL THEN 'missing' WHEN p.content <> d.content THEN 'content' WHEN d.doc_id % 7 = 0 THEN 'version' END AS rule FROM v_doc d LEFT JOIN v_doc_prev p USING (repo_id, path)""")
def read_set(v):
    d = v["v_doc"].select("doc_id", "path", F.sha2("content", 256).alias("content_id"), F.expr("doc_id % 4 + if(doc_id % 7 = 0, 2, 1)").alias("version"), F.octet_length("content").alias("byte_length"))
    s = v["v_doc_prev"].select("path", F.sha2("content", 256).alias("content_id"), "version", F.octet_length("content").alias("byte_length"))
    return J.read_set(d, s).select("doc_id", "rule")


@query("publication_gate", "v_step", """
WITH m AS (SELECT flow, count(*) FILTER (file_hash IS NULL) AS stale, count(*) FILTER (kind = 'boundary') AS open, count(*) AS n FROM v_step GROUP BY 1)
SELECT flow, stale = 0 AND open = 0 AND n >= 2 AS passed, concat_ws(',', CASE WHEN stale > 0 THEN 'snapshot' END, CASE WHEN open > 0 THEN 'closure' END, CASE WHEN n < 2 THEN 'comprehension' END) AS causes FROM m""")
def publication_gate(v):
    maps = v["v_step"].groupBy("flow").agg(F.count_if(F.col("file_hash").isNull()).alias("stale"), F.count_if(F.col("kind") == "boundary").alias("open"), F.count("*").alias("n"))
    return J.publication_gate(maps, {"snapshot": "stale = 0", "closure": "open = 0", "comprehension": "n >= 2"}).select("flow", "passed", F.array_join("causes", ",").alias("causes"))


@query("refinement_check", "orders", """
WITH f AS (SELECT *, first_value(o_orderkey) OVER w AS fk, first_value(o_orderstatus) OVER w AS fs FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey AS basis, fk AS first, o_orderkey AS later, o_orderstatus = fs AS allowed FROM f WHERE o_orderkey > fk""")
def refinement_check(v):
    return J.refinement_check(v["orders"].select(F.col("o_custkey").alias("basis"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("digest")), ["digest"])


@query("approval_history", "v_ledger", """
WITH l AS (SELECT subject, seq, kind, coalesce(lag(kind) OVER (PARTITION BY subject ORDER BY seq), '') AS b FROM v_ledger WHERE kind <> 'note')
SELECT subject, seq, b || '>' || kind AS rule FROM l WHERE (kind = 'approve' AND b NOT IN ('', 'reject')) OR (kind = 'reject' AND b <> 'approve')""")
def approval_history(v):
    return J.approval_history(v["v_ledger"])


@query("metric_report", "events", """
WITH b AS (SELECT user_id AS scenario, quantile_cont(value, 0.95) AS p, count(*) AS n, count(DISTINCT event_id % 97) AS runs FROM events GROUP BY 1)
SELECT scenario, 'over_threshold' AS rule FROM b WHERE p > 30 UNION ALL SELECT scenario, 'duplicate_run' FROM b WHERE n > runs""")
def metric_report(v):
    rows = v["events"].select(F.col("user_id").alias("scenario"), F.expr("event_id % 97").alias("run"), "value")
    return J.metric_report(rows, rows.select("scenario").distinct().withColumn("most", F.lit(30.0)))


@query("settlement", "v_step", """
SELECT flow AS map, CASE WHEN flow % 4 < 2 THEN 'pending' WHEN count(*) FILTER (kind IN ('failure', 'boundary')) > 0 THEN 'failed' ELSE 'passed' END AS gate, count(*) FILTER (kind IN ('failure', 'boundary')) AS blocking FROM v_step GROUP BY 1""")
def settlement(v):
    state = F.expr("case kind when 'failure' then 'blocking' when 'boundary' then 'unresolved' else 'ok' end")
    return J.settlement(v["v_step"].select(F.col("flow").alias("map"), F.expr("concat('Q', flow % 4 + 1)").alias("stage"), state.alias("state"), F.col("ordinal").cast("string").alias("ref")))


@query("coalesce", "events", """
WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS seq, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT key, n, seq, t, t AS t0, NULL::BIGINT AS done, NULL::DOUBLE AS due FROM r WHERE n = 1
  UNION ALL SELECT r.key, r.n, r.seq, r.t, CASE WHEN r.t - w.t >= 21600 OR r.t - w.t0 >= 86400 THEN r.t ELSE w.t0 END, CASE WHEN r.t - w.t >= 21600 OR r.t - w.t0 >= 86400 THEN w.seq END, least(w.t + 21600, w.t0 + 86400)
  FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1)
SELECT key, done AS seq, round(due, 3) AS emit_at FROM w WHERE done IS NOT NULL
UNION ALL SELECT key, seq, round(least(t + 21600, t0 + 86400), 3) FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1""")
def coalesce(v):
    rows = v["events"].select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return K.coalesce(rows, 21600.0, 86400.0).withColumn("emit_at", F.round("emit_at", 3))


@query("versioned_ingest", "v_change", """
WITH b AS (SELECT *, CASE WHEN source = 'other' THEN 'source' WHEN kind = 'error' THEN 'kind' END AS bad FROM v_change)
SELECT seq, coalesce(bad, CASE WHEN version <= max(CASE WHEN bad IS NULL THEN version END) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'stale' END) AS reason FROM b""")
def versioned_ingest(v):
    return K.versioned_ingest(v["v_change"], kinds=("click", "view", "purchase", "signup")).select("seq", "reason")


@query("batch_idempotent", "v_change", """
WITH f AS (SELECT seq // 3 AS batch, seq, source, first_value(seq) OVER w AS fs, first_value(source) OVER w AS fo FROM v_change WINDOW w AS (PARTITION BY seq // 3 ORDER BY seq))
SELECT batch, seq, CASE WHEN seq = fs THEN 'new' WHEN source = fo THEN 'repeated' ELSE 'error' END AS outcome FROM f""")
def batch_idempotent(v):
    return K.batch_idempotent(v["v_change"].select(F.expr("seq div 3").alias("batch"), "seq", "source")).select("batch", "seq", "outcome")


@query("txn_commit", "v_change", "SELECT path AS txn, count(*) FILTER (seq % 5 NOT IN (0) AND seq % 601 <> 1) AS edits FROM v_change GROUP BY 1 HAVING count(*) FILTER (seq % 5 = 0) > 0 AND count(*) FILTER (seq % 601 = 1 AND seq % 5 <> 0) = 0")
def txn_commit(v):
    return K.txn_commit(v["v_change"].select(F.col("path").alias("txn"), F.expr("case when seq % 5 = 0 then 'commit' when seq % 601 = 1 then 'abort' else kind end").alias("kind")))


@query("watch_stable", "v_change", "SELECT seq, NOT (seq % 3 = 0 OR seq % 5 = 0) AS accepted FROM v_change")
def watch_stable(v):
    s = F.col("seq")
    return K.watch_stable(v["v_change"].select("seq", F.lit(1).alias("size_before"), F.when(s % 3 == 0, 2).otherwise(1).alias("size_after"), F.lit(0).alias("time_before"), F.lit(0).alias("time_after"), F.lit("h").alias("hash_before"), F.when(s % 5 == 0, F.lit(None)).otherwise(F.lit("h")).alias("hash_after"))).select("seq", "accepted")


@query("reconcile", "v_gen_a", "SELECT path FROM v_gen_a WHERE k % 6 NOT IN (0, 2)")
def reconcile(v):
    targets = v["v_gen_a"].filter("k % 2 = 0").select("path", F.expr("case k % 6 when 0 then 'delete' when 2 then 'event_loss' else 'edit' end").alias("kind"))
    return K.reconcile(v["v_gen_a"], targets).select("path")


@query("epochs", "events", """
WITH a AS (SELECT user_id AS key, event_id AS seq, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT key, seq, sum(CASE WHEN p IS NOT NULL AND p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS epoch FROM a""")
def epochs(v):
    return K.epochs(v["events"].select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_type"), ["event_type"]).select("key", "seq", "epoch")


@query("activity", "events", """
WITH d AS (SELECT user_id AS key, coalesce(max(event_id) FILTER (event_type = 'purchase'), -1) AS d, max(ts) AS now FROM events GROUP BY 1),
l AS (SELECT user_id AS key, count(*) AS pending, (epoch_us(max(now)) - epoch_us(min(ts))) // 1000 AS lag_ms FROM events JOIN d ON d.key = user_id WHERE event_id > d GROUP BY 1)
SELECT key, coalesce(pending, 0) AS pending, coalesce(lag_ms, 0) AS lag_ms FROM d LEFT JOIN l USING (key)""")
def activity(v):
    return K.activity(v["events"].select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("analysed")))


@query("sequence_check", "lineitem", """
WITH a AS (SELECT l_orderkey AS stream, l_linenumber AS sequence, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem)
SELECT stream, sequence, CASE WHEN sequence = p THEN 'duplicate' ELSE 'gap' END AS rule FROM a WHERE sequence = p OR sequence > p + 1""")
def sequence_check(v):
    return K.sequence_check(v["lineitem"].select(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").alias("sequence"), F.col("l_partkey").alias("id")))


@query("pointer_chain", "v_publish", """
WITH RECURSIVE w AS (SELECT key, min(seq) AS seq FROM v_publish WHERE expected IN ('', '*') GROUP BY 1
  UNION ALL SELECT key, (SELECT min(p.seq) FROM v_publish p WHERE p.key = w.key AND p.seq > w.seq AND (p.expected = '*' OR p.expected = 'g' || w.seq)) FROM w WHERE w.seq IS NOT NULL)
SELECT key, seq FROM w WHERE seq IS NOT NULL""")
def pointer_chain(v):
    return K.pointer_chain(v["v_publish"])


@query("failure_timeline", "events part", """
SELECT user_id AS trace, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, event_type AS kind, CASE WHEN event_id % 500 IN (SELECT p_partkey FROM part WHERE p_size > 25) THEN 'corroborated' ELSE 'runtime' END AS source FROM events""")
def failure_timeline(v):
    observed = v["events"].select(F.col("user_id").alias("trace"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.expr("event_id % 500").alias("symbol"))
    return K.failure_timeline(observed, v["part"].filter("p_size > 25").select(F.col("p_partkey").alias("symbol")))
