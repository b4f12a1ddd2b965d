"""Queries over candidates, steps, edges and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import ids
from tracewell.operators import candidates as C
from tracewell.operators import frames as G
from tracewell.operators import fuse as E
from tracewell.queries.registry import query
from tracewell.sources import documents as D

_FAN = """
tok AS (SELECT unnest(regexp_extract_all(content, '[A-Za-z0-9_]+')) AS t FROM v_doc WHERE regexp_matches(lower(path), '\\.(dart|tsx?|jsx?|mjs|cjs|kts?|java|swift|py|go|rs)$') AND NOT regexp_matches(lower(path), '(\\.g\\.dart|\\.min\\.js)$')),
cnt AS (SELECT t, count(*) AS n FROM tok GROUP BY 1),
fan AS (SELECT class_name, coalesce(max(n), 0) AS fan_in FROM (SELECT DISTINCT class_name FROM v_candidate) c LEFT JOIN cnt ON t = class_name AND class_name <> '' GROUP BY 1)"""
_SCORED = f"""{_FAN},
scored AS (SELECT c.*, f.fan_in, least(1.0, greatest(0.0, CASE marker_kind WHEN 'usecase_call' THEN 0.9 WHEN 'notifier_method' THEN 0.8 WHEN 'bloc_handler' THEN 0.75 WHEN 'route_callback' THEN 0.6 WHEN 'lifecycle_callback' THEN 0.5 WHEN 'state_mutation' THEN 0.45 ELSE 0 END::DOUBLE * 0.85::DOUBLE + least(f.fan_in / 20.0::DOUBLE, 1.0::DOUBLE) * 0.1::DOUBLE)) AS score,
       CASE marker_kind WHEN 'usecase_call' THEN 5 WHEN 'notifier_method' THEN 4 WHEN 'bloc_handler' THEN 3 WHEN 'route_callback' THEN 2 WHEN 'lifecycle_callback' THEN 1 WHEN 'state_mutation' THEN 0 ELSE -1 END AS mrank
  FROM v_candidate c JOIN fan f USING (class_name)),
ranked AS (SELECT *, row_number() OVER w - 1 AS tie_break_rank, first_value(candidate_id) OVER w AS winner FROM scored WINDOW w AS (PARTITION BY root_equivalence_key ORDER BY score DESC, mrank DESC, entry_symbol_path))"""


def _scored(v):
    docs = D.source_files(v["v_doc"])
    out = v["v_candidate"].join(C.fan_in(v["v_candidate"], docs), "class_name")
    return C.score(C.boundary_reach(out, docs))


def _ranked(v):
    return C.dedup_roots(_scored(v))


@query("fan_in", "v_doc v_candidate", f"WITH {_FAN} SELECT * FROM fan")
def fan_in(v):
    return C.fan_in(v["v_candidate"], D.source_files(v["v_doc"]))


@query("boundary_reach", "v_doc v_candidate", "SELECT candidate_id, coalesce((SELECT bool_or(regexp_matches(content, '(Repository|ApiClient|DataSource|Service)\\b')) FROM v_doc WHERE path = split_part(entry_symbol_path, '#', 1)), false) AS boundary_reachable FROM v_candidate")
def boundary_reach(v):
    return C.boundary_reach(v["v_candidate"], v["v_doc"]).select("candidate_id", "boundary_reachable")


@query("candidate_score", "v_doc v_candidate", f"WITH {_SCORED} SELECT candidate_id, round(score, 9) AS score FROM scored")
def candidate_score(v):
    return _scored(v).select("candidate_id", F.round("score", 9).alias("score"))


@query("root_dedup", "v_doc v_candidate", f"WITH {_SCORED} SELECT candidate_id, tie_break_rank, CASE WHEN tie_break_rank > 0 THEN winner END AS deduped_into FROM ranked")
def root_dedup(v):
    return _ranked(v).select("candidate_id", "tie_break_rank", "deduped_into")


@query("manifest_apply", "v_doc v_candidate v_manifest", f"""
WITH {_SCORED} SELECT candidate_id, m.rule AS override, CASE WHEN m.rule = 'pinned' THEN m.pin_name ELSE derived_name END AS derived_name, CASE WHEN tie_break_rank > 0 AND m.rule IS DISTINCT FROM 'pinned' THEN winner END AS deduped_into
FROM ranked LEFT JOIN v_manifest m ON m.entry = entry_symbol_path""")
def manifest_apply(v):
    return C.apply_manifest(_ranked(v), v["v_manifest"]).select("candidate_id", "override", "derived_name", "deduped_into")


@query("candidate_rank", "v_doc v_candidate v_manifest", f"""
WITH {_SCORED} SELECT row_number() OVER (ORDER BY (m.rule IS NOT DISTINCT FROM 'pinned') DESC, score DESC, mrank DESC, entry_symbol_path) AS place, candidate_id, round(score, 9) AS score, coalesce(m.rule = 'pinned', false) AS pinned
FROM ranked LEFT JOIN v_manifest m ON m.entry = entry_symbol_path
WHERE m.rule = 'pinned' OR (m.rule IS NULL AND tie_break_rank = 0 AND trigger_class <> 'use_case_invocation')
ORDER BY 1 LIMIT 100""")
def candidate_rank(v):
    """The hundred entry points to publish first: score, roots, overrides, selection."""
    out = C.apply_manifest(_ranked(v), v["v_manifest"]).filter("override is null or override = 'pinned'")
    out = out.withColumn("pinned", F.col("override").eqNullSafe("pinned")).filter("pinned or (deduped_into is null and trigger_class <> 'use_case_invocation')")
    top = out.orderBy(F.col("pinned").desc(), *C.priority()).limit(100)
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.col("pinned").desc(), *C.priority()))
    return top.select(place.alias("place"), "candidate_id", F.round("score", 9).alias("score"), "pinned")


@query("publish_select", "v_doc v_candidate v_manifest", f"""
WITH {_SCORED} SELECT candidate_id FROM ranked LEFT JOIN v_manifest m ON m.entry = entry_symbol_path
WHERE m.rule = 'pinned' OR (tie_break_rank = 0 AND trigger_class <> 'use_case_invocation')
QUALIFY row_number() OVER (PARTITION BY split_part(entry_symbol_path, '/', 2) ORDER BY (m.rule IS NOT DISTINCT FROM 'pinned') DESC, score DESC, entry_symbol_path) <= 50""")
def publish_select(v):
    rows = C.apply_manifest(_ranked(v), v["v_manifest"]).withColumn("repo_id", F.split_part("entry_symbol_path", F.lit("/"), F.lit(2)))
    return D.publish_select(rows, 50).select("candidate_id")


@query("literal_hits", "v_candidate part customer", """
WITH q AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 29 = 0 THEN [] WHEN c_custkey % 13 = 0 THEN ['zq'] WHEN c_custkey % 7 = 0 THEN [lower(substr(p_name, 2, 2))] ELSE [lower(substr(p_name, 1, 4)), lower(right(p_brand, 2))] END AS terms FROM customer JOIN part ON p_partkey = c_custkey % (SELECT count(*) FROM part) + 1),
u AS (SELECT query_id, list_filter(terms, lambda t: trim(t) <> '') AS terms FROM (SELECT query_id, flatten(list_transform(terms, lambda t: string_split(t, ' '))) AS terms FROM q) x),
h AS (SELECT query_id, candidate_id FROM u JOIN v_candidate ON len(terms) > 0 AND len(list_filter(terms, lambda t: contains(lower(derived_name), t) OR contains(lower(root_equivalence_key), t))) = len(terms))
SELECT query_id, candidate_id, 'matched' AS status FROM h UNION ALL SELECT query_id, NULL, CASE WHEN len(terms) > 0 THEN 'no_literal_match' ELSE 'empty_query' END FROM u WHERE query_id NOT IN (SELECT query_id FROM h)""")
def literal_hits(v):
    """A query for each customer: parts of a name and of a brand, two letters, nothing that is there, or no term."""
    n = v["part"].count()
    rows = v["customer"].join(v["part"], F.col("p_partkey") == F.col("c_custkey") % n + 1)
    text = F.expr("case when c_custkey % 29 = 0 then ' ' when c_custkey % 13 = 0 then 'zq' when c_custkey % 7 = 0 then substr(p_name, 2, 2) else concat(left(p_name, 4), ' ', upper(right(p_brand, 2))) end")
    return C.literal_hits(v["v_candidate"], rows.select(F.col("c_custkey").alias("query_id"), text.alias("query")), ["derived_name", "root_equivalence_key"])


@query("literal_search", "v_candidate", """
WITH q(query_id, terms) AS (VALUES (1, ['red']), (2, ['ring', 'small']), (3, ['nothing', 'red'])),
h AS (SELECT query_id, candidate_id, len([t for t in terms if contains(lower(derived_name), t) OR contains(lower(root_equivalence_key), t)]) = len(terms) AS hit FROM v_candidate, q),
s AS (SELECT query_id, bool_or(hit) AS found FROM h GROUP BY 1)
SELECT query_id, candidate_id, CASE WHEN found THEN 'matched' ELSE 'no_literal_match' END AS status FROM h JOIN s USING (query_id) WHERE hit OR NOT found""")
def literal_search(v):
    spark = v["v_candidate"].sparkSession
    queries = spark.createDataFrame([(1, "Red"), (2, "ring  small"), (3, "nothing red")], "query_id int, query string")
    return C.literal_search(v["v_candidate"], queries, ["derived_name", "root_equivalence_key"])


@query("target_resolve", "v_candidate", """
WITH n AS (SELECT derived_name, count(*) AS n FROM v_candidate GROUP BY 1)
SELECT p_partkey AS query_id, CASE WHEN p_partkey % 4 = 0 THEN 'resolved' WHEN p_partkey % 4 = 1 THEN 'resolved' WHEN p_partkey % 4 = 2 THEN 'unknown_flow' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status,
       CASE p_partkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN entry_symbol_path END AS target, CASE WHEN p_partkey % 4 = 3 THEN n ELSE 0 END AS n
FROM v_candidate JOIN n USING (derived_name)""")
def target_resolve(v):
    c = v["v_candidate"].withColumn("flow_id", ids.flow_id(F.col("entry_symbol_path")))
    turn = F.expr("p_partkey % 4")
    queries = c.select(F.col("p_partkey").alias("query_id"), F.when(turn == 0, "S").alias("symbol"), F.when(turn == 1, F.col("flow_id")).when(turn == 2, F.lit("flow-none")).alias("flow_id"), F.when(turn == 3, F.upper("derived_name")).alias("text"))
    return C.resolve_target(queries, c)


@query("ledger_replay", "v_ledger", """
WITH d AS (SELECT subject, max(seq) FILTER (kind = 'reject') AS dead FROM v_ledger GROUP BY 1)
SELECT l.subject, arg_max(name, seq) FILTER (kind = 'approve') AS approved, arg_max(name, seq) FILTER (kind = 'draft') AS draft
FROM v_ledger l JOIN d USING (subject) WHERE kind IN ('approve', 'draft') AND seq > coalesce(dead, -1) GROUP BY 1""")
def ledger_replay(v):
    return E.replay_ledger(v["v_ledger"])


@query("authority_fuse", "v_step v_ledger", """
WITH d AS (SELECT subject, max(seq) FILTER (kind = 'reject') AS dead FROM v_ledger GROUP BY 1),
r AS (SELECT l.subject, arg_max(name, seq) FILTER (kind = 'approve') AS approved, arg_max(name, seq) FILTER (kind = 'draft') AS draft FROM v_ledger l JOIN d USING (subject) WHERE kind IN ('approve', 'draft') AND seq > coalesce(dead, -1) GROUP BY 1)
SELECT flow, ordinal, CASE WHEN approved IS NOT NULL THEN 'approved' WHEN draft IS NOT NULL THEN 'session' ELSE 'derived' END AS provenance, CASE WHEN approved IS NOT NULL THEN 1.0 WHEN draft IS NOT NULL THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence, coalesce(approved, draft, symbol) AS step_name
FROM v_step LEFT JOIN r ON r.subject = suppkey""")
def authority_fuse(v):
    steps = v["v_step"].withColumn("subject", F.col("suppkey"))
    return E.fuse_authority(steps, E.replay_ledger(v["v_ledger"]), "subject").select("flow", "ordinal", "provenance", "confidence", "step_name")


@query("fuse_project", "v_step", "SELECT flow, ordinal, CASE WHEN kind = 'external_effect' THEN 'call' ELSE kind END AS fused_kind, CASE WHEN kind = 'mutation' AND partkey % 2 = 0 THEN 'idle' END AS before, CASE WHEN kind = 'mutation' AND partkey % 2 = 0 THEN state_after END AS after, guard_condition AS branch FROM v_step")
def fuse_project(v):
    return E.project(v["v_step"].withColumn("value_role", F.expr("if(partkey % 2 = 1, 'local_binding', null)")).withColumn("state_before", F.lit(None).cast("string")))


@query("edge_unknowns", "v_edge", """
SELECT flow, to_symbol AS subject, CASE resolution_status WHEN 'dynamic' THEN 'unresolved_dynamic_call' ELSE CASE WHEN partkey % 3 = 0 THEN 'no_evidence' ELSE 'unresolved_type' END END AS reason
FROM v_edge WHERE resolution_status = 'dynamic' OR resolution_status = 'unresolved'""")
def edge_unknowns(v):
    status = F.when(F.col("resolution_status") == "dynamic", "unresolved_dynamic").otherwise(F.col("resolution_status"))
    reason = F.when(F.col("resolution_status") == "unresolved", F.expr("if(partkey % 3 = 0, 'no_evidence', 'odd')"))
    return E.edge_unknowns(v["v_edge"].withColumn("unresolved_reason", reason).withColumn("resolution_status", status))


@query("anchor_check", "v_doc", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'missing_document' WHEN 1 THEN 'bad_range' WHEN 2 THEN 'file_hash' END AS reason FROM v_doc")
def anchor_check(v):
    d = v["v_doc"]
    anchors = d.select("doc_id", F.expr("if(doc_id % 4 = 0, 'none', path)").alias("path"), F.lit(0).alias("byte_start"), F.expr("if(doc_id % 4 = 1, octet_length(content) + 1, octet_length(content))").alias("byte_end"), F.expr("if(doc_id % 4 = 2, 'x', sha2(content, 256))").alias("file_hash"))
    return E.anchor_check(anchors, d).select("doc_id", "reason")


@query("evidence_extract", "v_doc", "SELECT doc_id, sha256(content) AS span_hash, strlen(content) AS span_bytes, true AS valid_utf8, 1 AS line_start, 1 + length(content) - length(replace(content, chr(10), '')) AS line_end FROM v_doc")
def evidence_extract(v):
    anchors = v["v_doc"].select("doc_id", "path", F.lit(0).alias("byte_start"), F.octet_length("content").alias("byte_end"))
    return E.evidence(anchors, v["v_doc"]).select("doc_id", "span_hash", "span_bytes", "valid_utf8", "line_start", "line_end")


@query("freshness", "v_doc v_doc_prev", """
SELECT p.path, p.repo_id, CASE WHEN p.version = 1 THEN 'orphaned' WHEN p.content = d.content OR p.version % 2 = 0 THEN 'fresh' ELSE 'stale' END AS freshness
FROM v_doc_prev p JOIN v_doc d USING (repo_id, path)""")
def freshness(v):
    first = F.sha2(F.substring(F.encode("content", "UTF-8"), 1, 5), 256)
    anchors = v["v_doc_prev"].select("repo_id", F.expr("if(version = 1, concat('gone/', path), path)").alias("path"), F.lit(0).alias("byte_start"), F.lit(5).alias("byte_end"), F.sha2("content", 256).alias("file_hash"), F.when(F.expr("version % 2 = 0"), first).otherwise("x").alias("span_hash"))
    return E.freshness(anchors, v["v_doc"].drop("repo_id")).select(F.regexp_replace("path", "^gone/", "").alias("path"), "repo_id", "freshness")


@query("edge_resolve", "v_edge v_step", """
WITH s AS (SELECT flow, symbol, count(*) AS n, min(ordinal) AS lone FROM v_step GROUP BY 1, 2)
SELECT e.flow, edge_idx, CASE WHEN t.ordinal IS NOT NULL THEN 'ordinal' WHEN e.target_ordinal IS NULL AND n = 1 THEN 'symbol' ELSE 'boundary' END AS outcome,
       CASE WHEN t.ordinal IS NOT NULL THEN t.ordinal WHEN e.target_ordinal IS NULL AND n = 1 THEN lone END AS target
FROM v_edge e LEFT JOIN v_step t ON t.flow = e.flow AND t.ordinal = e.target_ordinal LEFT JOIN s ON s.flow = e.flow AND s.symbol = e.to_symbol""")
def edge_resolve(v):
    return E.resolve_edges(v["v_edge"], v["v_step"]).select("flow", "edge_idx", "outcome", "target")


@query("neighbors", "v_call", "SELECT symbol, sum(i) AS callers, sum(o) AS callees FROM (SELECT callee AS symbol, count(DISTINCT caller) AS i, 0 AS o FROM v_call GROUP BY 1 UNION ALL SELECT caller, 0, count(DISTINCT callee) FROM v_call GROUP BY 1) GROUP BY 1")
def neighbors(v):
    return E.neighbors(v["v_call"])


@query("dispatch", "v_call", "SELECT callee AS symbol, caller AS implementation FROM v_call WHERE kind = 'implementation'")
def dispatch(v):
    return v["v_call"].filter("kind = 'implementation'").select(F.col("callee").alias("symbol"), F.col("caller").alias("implementation"))


@query("direct_relation", "v_step v_edge", """
SELECT s.flow, s.ordinal, CASE WHEN o IS NOT NULL THEN 'outgoing' WHEN i IS NOT NULL THEN 'incoming' ELSE 'none' END AS direction, coalesce(o, i) AS edge_idx
FROM v_step s LEFT JOIN (SELECT flow, step_ordinal, min(edge_idx) AS o FROM v_edge GROUP BY 1, 2) a ON a.flow = s.flow AND a.step_ordinal = s.ordinal
LEFT JOIN (SELECT flow, target_ordinal, min(edge_idx) AS i FROM v_edge GROUP BY 1, 2) b ON b.flow = s.flow AND b.target_ordinal = s.ordinal""")
def direct_relation(v):
    return E.direct_relation(v["v_step"], v["v_edge"])


_SCOPES = "(VALUES ('f/1', 'document'), ('f/2', 'membership'), ('f', 'frontier'), ('moved/f/3', 'lookup'))"


@query("closure_hits", "v_gen_b", f"SELECT DISTINCT path, cause, scope FROM v_gen_b, {_SCOPES} s(scope, cause) WHERE path = scope OR starts_with(path, scope || '/')")
def closure_hits(v):
    scopes = v["v_gen_b"].sparkSession.createDataFrame([("f/1", "document"), ("f/2", "membership"), ("f", "frontier"), ("moved/f/3", "lookup")], "scope string, cause string")
    return E.closure_hits(v["v_gen_b"], scopes)


@query("selection_carry", "v_gen_a v_gen_b", """
WITH n AS (SELECT content_id, count(*) AS n, min(k) AS k FROM v_gen_b GROUP BY 1)
SELECT a.k, CASE WHEN n.n = 1 THEN n.k END AS step, n.n IS DISTINCT FROM 1 AS identity_lost FROM v_gen_a a LEFT JOIN n USING (content_id)""")
def selection_carry(v):
    selected = v["v_gen_a"].select("k", F.col("content_id").alias("identity"))
    return E.carry_selection(selected, v["v_gen_b"].select(F.col("content_id").alias("identity"), F.col("k").alias("step"))).drop("identity")


@query("label_merge", "v_turn", """
WITH f AS (SELECT flow, bool_and(NOT (kind = 'system' AND flow % 2 = 0)) AS every FROM v_turn GROUP BY 1)
SELECT flow, ordinal AS frame, CASE WHEN every THEN 'L' || ordinal ELSE kind END AS label, CASE WHEN every THEN 'labelled' ELSE 'fallback' END AS status FROM v_turn JOIN f USING (flow)""")
def label_merge(v):
    frames = v["v_turn"].select("flow", F.col("ordinal").alias("frame"), F.col("kind").alias("title"))
    labels = v["v_turn"].filter("not (kind = 'system' and flow % 2 = 0)").select("flow", F.col("ordinal").alias("frame"), F.concat(F.lit("L"), F.col("ordinal").cast("string")).alias("label"))
    return E.merge_labels(frames, labels)


@query("flow_index", "v_step", "SELECT flow, count(*) AS steps, bool_or(file_hash IS NULL) AS has_stale, bool_or(kind = 'boundary') AS has_unknown FROM v_step GROUP BY 1")
def flow_index(v):
    return E.flow_index(v["v_step"].withColumn("freshness", F.expr("if(file_hash is null, 'stale', 'fresh')")).withColumn("provenance", F.expr("if(kind = 'boundary', 'unknown', 'derived')")))


@query("compact", "v_turn", "SELECT flow, count(*) AS frames, string_agg(kind || ' (' || ordinal || ')', ' · ' ORDER BY ordinal) AS summary FROM v_turn GROUP BY 1")
def compact(v):
    return E.compact(v["v_turn"].select("flow", F.col("ordinal").alias("frame"), F.col("kind").alias("title"), F.col("ordinal").alias("steps")))


@query("coverage_roots", "v_step", "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM v_step WHERE NOT (path LIKE 'lib/data/%' OR path LIKE 'lib/domain/%')")
def coverage_roots(v):
    return E.coverage_roots(v["v_step"], v["v_step"].sparkSession.createDataFrame([("lib/data",), ("lib/domain",)], "root string"))


@query("quality", "v_step v_edge", """
WITH s AS (SELECT flow, bool_or(kind IN ('return', 'result')) AS result, count(*) AS n FROM v_step GROUP BY 1),
e AS (SELECT flow, count(DISTINCT step_ordinal) FILTER (resolution_status = 'resolved') AS chained, bool_or(resolution_status <> 'resolved') AS open FROM v_edge GROUP BY 1)
SELECT flow, u.obligation, CASE u.obligation WHEN 'entry' THEN true WHEN 'result' THEN result WHEN 'causal_chain' THEN coalesce(chained >= n - 1, n = 1) ELSE NOT coalesce(open, false) END AS met
FROM s LEFT JOIN e USING (flow), (VALUES ('entry'), ('result'), ('causal_chain'), ('no_unknown')) u(obligation)""")
def quality(v):
    return E.quality(v["v_step"], v["v_edge"])


_TOKENS = "list_distinct([x for x in regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}_-]+') if length(x) > 2 AND x NOT LIKE 'ac-%'])"


@query("alignment", "v_criterion v_turn", f"""
WITH a AS (SELECT criterion_id, unnest({_TOKENS.format('text')}) AS t FROM v_criterion), b AS (SELECT flow * 100 + ordinal AS step, unnest({_TOKENS.format('text')}) AS t FROM v_turn),
p AS (SELECT criterion_id, step FROM a JOIN b USING (t) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT criterion_id, count(step) AS steps FROM v_criterion LEFT JOIN p USING (criterion_id) GROUP BY 1""")
def alignment(v):
    from tracewell.functions.text import significant_tokens

    tokens = significant_tokens(F.col("text")).alias("tokens")
    return E.alignments(v["v_criterion"].select("criterion_id", tokens), v["v_turn"].select(F.expr("flow * 100 + ordinal").alias("step"), tokens))


@query("capability", "events", """
WITH f AS (SELECT user_id AS repo, list_distinct(list(event_type)) AS k FROM events GROUP BY 1)
SELECT repo, array_to_string(list_sort([x for x in ['click', 'refund', 'signup'] if list_contains(k, x)]), ',') AS supported, array_to_string(list_sort([x for x in ['click', 'refund', 'signup'] if NOT list_contains(k, x)]), ',') AS missing FROM f""")
def capability(v):
    features = v["events"].groupBy(F.col("user_id").alias("repo")).agg(F.collect_set(F.concat(F.lit("relation:"), "event_type")).alias("features"))
    return E.capabilities(features, ["click", "refund", "signup"]).select("repo", F.array_join("supported", ",").alias("supported"), F.array_join("missing", ",").alias("missing"))


@query("ordinal_check", "v_turn", "SELECT flow, ordinal, row_number() OVER (PARTITION BY flow ORDER BY ordinal) AS expected FROM v_turn QUALIFY expected <> ordinal")
def ordinal_check(v):
    return E.ordinals(v["v_turn"])


_LAYER = "CASE WHEN suppkey % 6 < 5 THEN suppkey % 6 ELSE 7 END"


@query("layer_order", "v_step", f"SELECT flow, ordinal, top AS below FROM (SELECT flow, ordinal, kind, {_LAYER} AS r, max({_LAYER}) OVER (PARTITION BY flow ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v_step) WHERE r < top AND kind <> 'branch'")
def layer_order(v):
    from tracewell.functions.text import layer_norm

    return G.layer_order(v["v_step"].withColumn("layer", layer_norm(F.col("raw_layer")))).drop("layer")


_ROLE = """
ext AS (SELECT DISTINCT flow, step_ordinal FROM v_edge WHERE kind IN ('external', 'async')),
rol AS (SELECT s.*, CASE WHEN ordinal = 1 THEN 'entry' WHEN kind = 'boundary' THEN 'boundary' WHEN kind = 'external_effect' OR x.flow IS NOT NULL THEN 'effect' WHEN kind IN ('guard', 'branch', 'decision', 'failure') THEN 'decision' WHEN kind IN ('mutation', 'return') THEN 'process' ELSE 'intermediate' END AS role
  FROM v_step s LEFT JOIN ext x ON x.flow = s.flow AND x.step_ordinal = s.ordinal)"""


@query("step_role", "v_step v_edge", f"WITH {_ROLE} SELECT flow, ordinal, role FROM rol")
def step_role(v):
    return G.step_role(v["v_step"], v["v_edge"]).select("flow", "ordinal", "role")


@query("step_status", "v_step", "SELECT flow, ordinal, CASE WHEN partkey % 5 = 0 THEN 'partial' WHEN partkey % 5 = 1 THEN 'verified' WHEN partkey % 5 = 2 THEN 'unknown' ELSE 'partial' END AS status FROM v_step")
def step_status(v):
    refs = F.expr("case partkey % 5 when 1 then array('verified', 'verified') when 2 then array('unknown', 'invalid') when 3 then array('verified', 'unknown') when 4 then array('partial') end")
    return G.step_status(v["v_step"], v["v_step"].select("flow", "ordinal", F.explode(refs).alias("validation")))


_FOLD = f"""{_ROLE},
way AS (SELECT * FROM v_edge WHERE kind <> 'callback_argument'),
outs AS (SELECT flow, step_ordinal, count(*) AS outs, min(target_ordinal) AS dest, bool_and(kind IN ('sequence', 'control_flow') AND resolution_status = 'resolved') AS plain, bool_or(resolution_status = 'resolved' AND kind IN ('resolved_cross_file', 'external', 'async')) AS enters FROM way GROUP BY 1, 2),
ins AS (SELECT flow, target_ordinal, count(*) AS ins FROM way WHERE target_ordinal IS NOT NULL GROUP BY 1, 2),
fol AS (SELECT r.*, coalesce(p.guard_condition IS NULL AND r.guard_condition IS NULL AND p.kind NOT IN ('guard', 'branch', 'decision', 'await', 'return') AND r.kind NOT IN ('await', 'return') AND p.invocation_id = r.invocation_id AND p.symbol = r.symbol AND p.path = r.path
    AND NOT coalesce(ro.enters, false) AND po.outs = 1 AND i.ins = 1 AND po.dest = r.ordinal AND po.plain, false) AS fold
  FROM rol r LEFT JOIN v_step p ON p.flow = r.flow AND p.ordinal = r.ordinal - 1 LEFT JOIN outs po ON po.flow = r.flow AND po.step_ordinal = r.ordinal - 1 LEFT JOIN outs ro ON ro.flow = r.flow AND ro.step_ordinal = r.ordinal LEFT JOIN ins i ON i.flow = r.flow AND i.target_ordinal = r.ordinal)"""


def _coarse(v):
    """Steps of one symbol, file and invocation per flow, so that some fold."""
    return v["v_step"]


@query("can_fold", "v_step v_edge", f"WITH {_FOLD} SELECT flow, ordinal, fold FROM fol")
def can_fold(v):
    return G.can_fold(_coarse(v), v["v_edge"]).select("flow", "ordinal", "fold")


@query("frame_build", "v_step v_edge", """
WITH RECURSIVE s AS (SELECT flow, ordinal, CASE WHEN ordinal = 1 THEN 'entry' WHEN kind = 'boundary' THEN 'boundary' WHEN kind = 'external_effect' THEN 'effect' WHEN kind = 'return' THEN 'result' WHEN kind IN ('call', 'await', 'failure') THEN 'intermediate' ELSE 'process' END AS role, partkey % 3 > 0 AND ordinal > 1 AS fold FROM v_step),
w AS (SELECT flow, ordinal, role AS frame_role, 1::BIGINT AS frame FROM s WHERE ordinal = 1
  UNION ALL SELECT s.flow, s.ordinal, CASE WHEN s.role = 'intermediate' AND s.fold AND w.frame_role NOT IN ('boundary', 'effect', 'result') THEN w.frame_role WHEN s.role = 'intermediate' THEN 'process' ELSE s.role END,
    CASE WHEN s.role = 'intermediate' AND s.fold AND w.frame_role NOT IN ('boundary', 'effect', 'result') THEN w.frame ELSE w.frame + 1 END
  FROM w JOIN s ON s.flow = w.flow AND s.ordinal = w.ordinal + 1)
SELECT flow, ordinal, frame FROM w""")
def frame_build(v):
    role = F.expr("case when ordinal = 1 then 'entry' when kind = 'boundary' then 'boundary' when kind = 'external_effect' then 'effect' when kind = 'return' then 'result' when kind in ('call', 'await', 'failure') then 'intermediate' else 'process' end")
    return G.build_frames(v["v_step"].withColumn("role", role).withColumn("fold", F.expr("partkey % 3 > 0 and ordinal > 1"))).select("flow", "ordinal", "frame")


@query("cycle_collapse", "v_step", """
WITH a AS (SELECT flow, symbol, ordinal, lag(ordinal) OVER (PARTITION BY flow, symbol ORDER BY ordinal) AS b FROM v_step)
SELECT flow, arg_min(symbol, ordinal) AS symbol, arg_min(b, ordinal) AS first, min(ordinal) AS last FROM a WHERE b < ordinal - 1 GROUP BY 1""")
def cycle_collapse(v):
    return G.cycle_collapse(v["v_step"])


@query("macro_clump", "v_step", """
WITH RECURSIVE s AS (SELECT flow, ordinal, CASE WHEN quantity % 3 = 0 THEN 'process' WHEN quantity % 3 = 1 THEN 'decision' ELSE 'intermediate' END AS role, 'f' || partkey % 2 AS symbol, CASE WHEN suppkey % 3 = 0 THEN '' ELSE 'c' END AS category FROM v_step),
w AS (SELECT flow, ordinal, 1::BIGINT AS clump, CASE WHEN role <> 'intermediate' THEN role || symbol || category END AS last, role AS lr, category AS lc FROM s WHERE ordinal = 1
  UNION ALL SELECT s.flow, s.ordinal, CASE WHEN s.role = 'intermediate' THEN w.clump WHEN w.last IS NOT NULL AND w.lr = s.role AND starts_with(w.last, s.role || s.symbol) AND (s.role = 'process' OR (w.lc = s.category AND s.category <> '')) THEN w.clump ELSE w.clump + 1 END,
    CASE WHEN s.role = 'intermediate' THEN w.last ELSE s.role || s.symbol || s.category END, CASE WHEN s.role = 'intermediate' THEN w.lr ELSE s.role END, CASE WHEN s.role = 'intermediate' THEN w.lc ELSE s.category END
  FROM w JOIN s ON s.flow = w.flow AND s.ordinal = w.ordinal + 1)
SELECT flow, ordinal, clump FROM w""")
def macro_clump(v):
    rows = v["v_step"].select("flow", "ordinal", F.expr("case quantity % 3 when 0 then 'process' when 1 then 'decision' else 'intermediate' end").alias("role"), F.expr("concat('f', partkey % 2)").alias("symbol"), F.expr("if(suppkey % 3 = 0, '', 'c')").alias("category"))
    return G.macro_clump(rows).select("flow", "ordinal", "clump")


@query("significance_top7", "v_step", """
WITH e AS (SELECT flow, ordinal, quantity AS score, count(*) OVER (PARTITION BY flow) AS n FROM v_step),
r AS (SELECT *, row_number() OVER (PARTITION BY flow, ordinal IN (1, n) ORDER BY score DESC, ordinal) AS r FROM e),
k AS (SELECT *, n <= 7 OR ordinal IN (1, n) OR r <= 5 AS kept FROM r)
SELECT flow, ordinal, kept, (SELECT max(b.ordinal) FROM k b WHERE b.flow = a.flow AND b.ordinal <= a.ordinal AND b.kept) AS "into" FROM k a""")
def significance_top7(v):
    return G.significance_top(v["v_step"].select("flow", "ordinal", F.col("quantity").alias("score"))).select("flow", "ordinal", "kept", "into")


@query("significance_frames", "v_step", """
WITH e AS (SELECT flow, ordinal, quantity + CASE WHEN partkey % 7 = 0 THEN 1000 ELSE 0 END AS score, symbol AS ref, CASE partkey % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'partial' WHEN 2 THEN 'verified' END AS given, kind = 'boundary' AS edge, suppkey % 3 + 1 AS steps, count(*) OVER (PARTITION BY flow) AS n FROM v_step),
k AS (SELECT *, n <= 4 OR ordinal IN (1, n) OR row_number() OVER (PARTITION BY flow, ordinal IN (1, n) ORDER BY score DESC, ref, ordinal) <= 2 AS kept FROM e),
p AS (SELECT *, sum(kept::INT) OVER (PARTITION BY flow ORDER BY ordinal)::BIGINT AS place FROM k)
SELECT flow, place, min(ordinal) AS ordinal, CASE WHEN arg_min(coalesce(given, CASE WHEN edge THEN 'unknown' ELSE 'verified' END), ordinal) = 'verified' AND bool_or(NOT kept AND (given IN ('unknown', 'partial') OR edge)) THEN 'partial' ELSE arg_min(coalesce(given, CASE WHEN edge THEN 'unknown' ELSE 'verified' END), ordinal) END AS status, coalesce(sum(steps) FILTER (NOT kept), 0)::BIGINT AS absorbed FROM p GROUP BY 1, 2""")
def significance_frames(v):
    """The best four frames; every seventh part's are recursions."""
    rows = v["v_step"].select("flow", "ordinal", F.col("quantity").alias("score"), F.expr("partkey % 7 = 0").alias("recursion"), F.col("symbol").alias("step_ref"), F.expr("case partkey % 6 when 0 then 'unknown' when 1 then 'partial' when 2 then 'verified' end").alias("status"), F.col("kind").alias("role"), F.expr("suppkey % 3 + 1").alias("steps"))
    return G.significance_frames(rows, 4)


@query("obligations", "v_step v_edge", """
SELECT flow, 'entry' AS kind, min(ordinal) AS target, 'verified' AS status FROM v_step GROUP BY 1 UNION ALL SELECT flow, 'result', max(ordinal), 'verified' FROM v_step GROUP BY 1 UNION ALL SELECT DISTINCT flow, 'causal_chain', NULL::BIGINT, 'pending' FROM v_step
UNION ALL SELECT DISTINCT flow, 'no_critical_unknown', NULL::BIGINT, CASE WHEN flow IN (SELECT flow FROM v_edge WHERE resolution_status <> 'resolved') THEN 'unknown' ELSE 'verified' END FROM v_step UNION ALL SELECT flow, 'critical_branch', ordinal, 'verified' FROM v_step WHERE kind IN ('guard', 'branch', 'decision')""")
def obligations(v):
    return E.obligations(v["v_step"], v["v_edge"].filter("resolution_status <> 'resolved'"))


@query("obligation_summary", "v_step v_edge", """
WITH u AS (SELECT DISTINCT flow FROM v_edge WHERE resolution_status <> 'resolved')
SELECT flow, 4 + count(*) FILTER (kind IN ('guard', 'branch', 'decision')) AS required, 4 + count(*) FILTER (kind IN ('guard', 'branch', 'decision')) - max(CASE WHEN u.flow IS NULL THEN 0 ELSE 1 END) AS verified, max(CASE WHEN u.flow IS NULL THEN 0 ELSE 1 END)::BIGINT AS unresolved FROM v_step LEFT JOIN u USING (flow) GROUP BY 1""")
def obligation_summary(v):
    return E.obligation_summary(obligations(v))


@query("criterion_matches", "v_criterion v_turn", f"""
WITH a AS (SELECT criterion_id, {_TOKENS.format("text")} AS t FROM v_criterion), s AS (SELECT flow * 100 + ordinal AS step, lower(text) AS said, flow % 45 AS rule FROM v_turn)
SELECT criterion_id, step FROM a JOIN s ON rule = criterion_id OR len(list_filter(t, lambda x: contains(said, x))) >= 2 OR (len(t) = 1 AND contains(said, t[1]))""")
def criterion_matches(v):
    """Every turn names one criterion as its rule, in another case and with spaces."""
    steps = v["v_turn"].select(F.expr("flow * 100 + ordinal").alias("step"), "text", F.array(F.lit("x"), F.concat(F.lit(" "), F.expr("flow % 45").cast("string"))).alias("rules"))
    return E.criterion_matches(v["v_criterion"], steps)


@query("display_fold", "v_step", """
WITH a AS (SELECT flow, ordinal, partkey % 5 = 0 AS c, count(*) OVER (PARTITION BY flow) AS n, sum((partkey % 5 = 0)::INT) OVER (PARTITION BY flow ORDER BY ordinal) AS run FROM v_step)
SELECT flow, min(ordinal) AS first, max(ordinal) AS last, count(*) - 2 AS hidden FROM a WHERE NOT c AND n > 4 GROUP BY flow, run HAVING count(*) > 2""")
def display_fold(v):
    return G.display_fold(v["v_step"].select("flow", "ordinal", F.expr("partkey % 5 = 0").alias("critical")), 4)
