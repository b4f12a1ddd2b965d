"""Purposes, views, requests and projects: classifications by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import ids
from tracewell.functions.text import glob_match, has_any, language, line_at

# Words by which a decision's purpose is known.
PURPOSES = {
    "auth": ["permission", "authorize", "role", "credential", "access", "forbidden", "unauthorized", "allow", "token", "authenticate", "authenticated", "authentication", "권한", "인증", "인가", "접근", "토큰"],
    "limit": ["limit", "quota", "rate", "threshold", "balance", "amount", "budget", "한도", "잔액", "초과"],
    "validation": ["validate", "valid", "schema", "format", "required", "verify", "검증", "유효", "형식", "누락"],
    "precondition": ["ready", "init", "state", "status", "enabled", "active", "상태", "준비", "활성"],
}
# Closing words of a request.
REQUEST_ENDINGS = ["분석해줘", "보여줘", "알려줘", "설명해줘", "찾아줘"]
# Marker files of projects, in order of precedence.
PROJECT_MARKERS = [("pubspec.yaml", "dart"), ("package.json", "typescript"), ("build.gradle.kts", "kotlin"), ("Package.swift", "swift"), ("pyproject.toml", "python"), ("go.mod", "go"), ("Cargo.toml", "rust")]
MARGIN, MOST_LINES = 12, 120


def purposes_in(text: Column) -> Column:
    """The purposes whose words a lower-case text has; ``auth`` also as part of a token that isn't about an author."""
    tokens = F.split(text, "[^a-z0-9_]+")
    auth = F.exists(tokens, lambda t: F.contains(t, F.lit("auth")) & ~F.contains(t, F.lit("author")))
    return F.array_compact(F.array(*[F.when(has_any(text, *words) | (auth if name == "auth" else F.lit(False)), F.lit(name)) for name, words in PURPOSES.items()]))


def decision_purpose(rules: Column, text: Column) -> Column:
    """A decision's purpose: of its rules (an array), else of its text; several are mixed, none is unknown."""
    by_rule = F.array_distinct(F.flatten(F.transform(F.coalesce(rules, F.array().cast("array<string>")), lambda r: purposes_in(F.lower(r)))))
    found = F.when(F.size(by_rule) > 0, by_rule).otherwise(purposes_in(F.lower(F.coalesce(text, F.lit("")))))
    return F.when(F.size(found) > 1, "mixed").when(F.size(found) == 1, found[0]).otherwise("unknown")


def step_status(kind: Column, provenance: Column, fresh: Column, confidence: Column, path: Column) -> Column:
    """Status of a fused step."""
    unknown = (kind == "boundary") | (provenance == "unknown") | (fresh == "orphaned")
    partial = (F.coalesce(path, F.lit("")) == "") | (fresh == "stale") | (provenance == "derived") | ((confidence > 0) & (confidence < 0.5))
    return F.when(unknown, "unknown").when(partial, "partial").otherwise("verified")


def code_lens(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """``anchors`` with focus and view lines: the symbol's lines, at most 120 around the focus, else twelve more on each side."""
    rows = anchors.join(docs.select("path", "content"), "path")
    at = lambda c: line_at(F.col("content"), c)
    rows = rows.withColumn("focus_start", at(F.col("byte_start"))).withColumn("focus_end", at(F.greatest("byte_start", F.col("byte_end") - 1))).withColumn("_n", at(F.octet_length("content")))
    rows = rows.withColumn("_a", F.when(F.col("symbol_end") > F.col("symbol_start"), at(F.col("symbol_start")))).withColumn("_b", F.when(F.col("symbol_end") > F.col("symbol_start"), at(F.col("symbol_end") - 1)))
    long = F.col("_b") - F.col("_a") + 1 > MOST_LINES
    start = F.greatest("_a", F.col("focus_start") - MOST_LINES // 2)
    end = F.least("_b", start + MOST_LINES - 1)
    start = F.greatest("_a", F.least(start, end - MOST_LINES + 1))
    has = F.col("_a").isNotNull()
    view_a = F.when(has & long, start).when(has, F.col("_a")).otherwise(F.col("focus_start") - MARGIN)
    view_b = F.when(has & long, end).when(has, F.col("_b")).otherwise(F.col("focus_end") + MARGIN)
    rows = rows.withColumn("view_start", F.greatest(F.lit(1), F.least(view_a, F.col("focus_start")))).withColumn("view_end", F.least("_n", F.greatest(view_b, F.col("focus_end"))))
    return rows.drop("content", "_n", "_a", "_b")


def normalise_request(request: Column) -> Column:
    """struct(task_id, outcome, status) of a request; its id is of the exact bytes."""
    text = F.trim(request)
    outcome = text
    for ending in REQUEST_ENDINGS:
        outcome = F.trim(F.regexp_replace(outcome, ending + "$", ""))
    unsure = has_any(text, "인지", "혹은", "또는") | F.contains(F.lower(text), F.lit(" either ")) | F.startswith(F.lower(text), F.lit("either "))
    return F.struct(ids.short_id("task", request).alias("task_id"), outcome.alias("outcome"), F.when(text == "", "empty").when(unsure, "needs_confirmation").otherwise("parsed").alias("status"))


def detect_project(docs: DataFrame) -> DataFrame:
    """(repo_id, language) by the first marker file that a repository has, else unknown."""
    name = F.element_at(F.split("path", "/"), -1)
    flags = docs.groupBy("repo_id").agg(*[F.bool_or(name == marker).alias(f"m{i}") for i, (marker, _) in enumerate(PROJECT_MARKERS)])
    out = None
    for i, (_, lang) in enumerate(PROJECT_MARKERS):
        out = F.when(F.col(f"m{i}"), lang) if out is None else out.when(F.col(f"m{i}"), lang)
    return flags.select("repo_id", out.otherwise("unknown").alias("language"))


def request_languages(docs: DataFrame) -> DataFrame:
    """(repo_id, language): the languages of a repository's sources, unknown where there are none."""
    known = docs.select("repo_id", language(F.col("path")).alias("language")).filter("language <> 'unknown'").distinct()
    rest = docs.select("repo_id").distinct().join(known, "repo_id", "left_anti").withColumn("language", F.lit("unknown"))
    return known.unionByName(rest)


# Kinds of symbols of a code graph that start flows.
ENTRY_KINDS = ["route", "entrypoint"]


def entry_symbols(symbols: DataFrame, kind: str = "kind", kinds: list[str] = ENTRY_KINDS) -> DataFrame:
    """The symbols of a kind that starts flows; their place tells their order."""
    return symbols.filter(F.col(kind).isin(*kinds))


def lane_labels(steps: DataFrame) -> DataFrame:
    """(layer, label, n): the convention that most steps (layer, convention, place) of a layer have; of equal ones, the first seen."""
    counts = steps.groupBy("layer", "convention").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    best = F.max_by(F.struct("convention", "n"), F.struct("n", -F.col("first")))
    return counts.groupBy("layer").agg(best.alias("b")).select("layer", F.col("b.convention").alias("label"), "b.n")


def path_pattern(steps: DataFrame, patterns: DataFrame) -> DataFrame:
    """Steps (flow, ordinal, layer, path) whose layer has path patterns none of which matches."""
    layers = patterns.groupBy("layer").agg(F.collect_set("pattern").alias("patterns"))
    rows = steps.join(layers, "layer")
    return rows.filter(~F.exists("patterns", lambda p: glob_match(F.col("path"), p))).select("flow", "ordinal", "layer")


def profile_merge(built_in: DataFrame, extra: DataFrame, chosen: DataFrame) -> DataFrame:
    """(name, pattern, known): the rules of built-in profiles and of those chosen, in order; unknown names are rows without a pattern."""
    picked = chosen.join(extra, "name", "left")
    return built_in.select("name", "pattern", F.lit(True).alias("known")).unionByName(picked.select("name", "pattern", F.col("pattern").isNotNull().alias("known")))


def structural_ids(steps: DataFrame) -> DataFrame:
    """``steps`` with step_id of (flow, path, symbol, kind): the first keeps the base id, later ones add their span; a remaining double is an error."""
    base = ids.short_id("step", F.col("flow"), F.col("path"), F.col("symbol"), F.col("kind"))
    rows = steps.withColumn("_base", base).withColumn("_n", F.row_number().over(Window.partitionBy("flow", "_base").orderBy("ordinal")))
    more = ids.short_id("step", F.col("_base"), F.col("byte_start"), F.col("byte_end"))
    rows = rows.withColumn("step_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(more))
    return rows.withColumn("error", F.count("*").over(Window.partitionBy("flow", "step_id")) > 1).drop("_base", "_n")


def query_identity(relations: DataFrame) -> DataFrame:
    """(query_id, identity): a hash of a query's sorted distinct relations and its bounds."""
    return relations.groupBy("query_id", "depth", "budget").agg(F.array_sort(F.collect_set("relation")).alias("r")).select("query_id", ids.sha256(F.array_join("r", ","), F.col("depth"), F.col("budget")).alias("identity"))


def row_digest(rows: DataFrame, digest: str) -> DataFrame:
    """``rows`` with whether ``digest`` is the hash of their other columns in order of name."""
    rest = sorted(c for c in rows.columns if c != digest)
    return rows.withColumn("valid", F.col(digest) == ids.sha256(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest], F.lit("")))


def frame_match(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (flow, key) with the only frame of that key (role, then symbol or title), null if none or several has it."""
    key = F.concat("role", F.lit("|"), F.coalesce(F.nullif("symbol", F.lit("")), F.nullif("title", F.lit("")), F.lit("")))
    by = frames.withColumn("key", key).groupBy("flow", "key").agg(F.count("*").alias("_n"), F.min("frame").alias("_f"))
    return wanted.join(by, ["flow", "key"], "left").select("flow", "key", F.when(F.col("_n") == 1, F.col("_f")).alias("frame"))


def execution_edges(edges: DataFrame) -> DataFrame:
    """``edges`` with executes: resolved, of an executable kind, no passed callback, and no return that another continuation bypasses."""
    kinds = ["control_flow", "sequence", "resolved_cross_file", "return", "failure", "finally", "async", "await_resume", "loop_back", "loop_exit", "external", "calls"]
    calls = edges.filter("kind in ('sequence', 'control_flow')").select("flow", F.col("step_ordinal").alias("_c"), "target_ordinal").distinct()
    bypass = edges.filter("kind = 'return'").join(calls, ["flow", "target_ordinal"]).select("flow", "edge_idx").distinct().withColumn("_b", F.lit(True))
    out = edges.join(bypass, ["flow", "edge_idx"], "left")
    return out.withColumn("executes", F.col("kind").isin(kinds) & (F.col("resolution_status") == "resolved") & F.col("_b").isNull()).drop("_b")


def branch_gap(taken: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow, open): ways out of a path's steps that the path doesn't take."""
    own = edges.select("flow", "step_ordinal", "target_ordinal").distinct().join(taken.select("flow", F.col("step_ordinal")).distinct(), ["flow", "step_ordinal"], "left_semi")
    return own.join(taken, ["flow", "step_ordinal", "target_ordinal"], "left_anti").groupBy("flow").agg(F.count("*").alias("open"))


def change_side(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``changes`` (step, kind) with symbol and side: removed ones from before, others from after, else from before."""
    a, b = before.select("step", F.col("symbol").alias("_a")), after.select("step", F.col("symbol").alias("_b"))
    out = changes.join(a, "step", "left").join(b, "step", "left")
    after_first = (F.col("kind") != "removed") & F.col("_b").isNotNull()
    return out.select("step", "kind", F.when(after_first, F.col("_b")).otherwise(F.col("_a")).alias("symbol"), F.when(after_first, "current").when(F.col("_a").isNotNull(), "baseline").otherwise("none").alias("side"))


def domain_rollup(flows: DataFrame) -> DataFrame:
    """(domain, kind, flows, covered): counts of each domain and kind, of each domain, and of all (nulls)."""
    return flows.rollup("domain", "kind").agg(F.count("*").alias("flows"), F.count_if("covered").alias("covered"))


def trace_checks(events: DataFrame) -> DataFrame:
    """(trace, ratio, conflict): covered spans of all, and whether a span both failed and succeeded."""
    by = events.groupBy("trace", "span").agg(F.bool_or("covered").alias("c"), F.count_distinct("failed").alias("f"))
    return by.groupBy("trace").agg((F.count_if("c") / F.count("*")).alias("ratio"), F.bool_or(F.col("f") > 1).alias("conflict"))


def map_refs(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow, rule, n): repeated steps and edges with ends that are no steps."""
    twice = steps.groupBy("flow", "ordinal").agg(F.count("*").alias("c")).filter("c > 1").groupBy("flow").agg(F.count("*").alias("n")).select("flow", F.lit("repeated_step").alias("rule"), "n")
    ends = edges.filter("target_ordinal is not null").select("flow", F.col("target_ordinal").alias("ordinal"))
    lost = ends.join(steps.select("flow", "ordinal"), ["flow", "ordinal"], "left_anti").groupBy("flow").agg(F.count("*").alias("n")).select("flow", F.lit("target_missing").alias("rule"), "n")
    return twice.unionByName(lost)


def promote(alignments: DataFrame, proofs: DataFrame) -> DataFrame:
    """``alignments`` (criterion_id, map, status, complete) under current proofs (map, snapshot): partial ones with complete evidence are confirmed."""
    p = proofs.select("map", F.lit(True).alias("_p")).distinct()
    out = alignments.join(p, "map", "left")
    waits = F.col("status") == "partial"
    proof = F.coalesce("_p", F.lit(False))
    reason = F.when(waits & ~proof, "current_proof_mismatch").when(waits & ~F.col("complete"), "current_evidence_incomplete")
    return out.withColumn("new_status", F.when(waits & proof & F.col("complete"), "confirmed").otherwise(F.col("status"))).withColumn("reason", reason).drop("_p")


def batch_roots(changes: DataFrame, steps: DataFrame, batch: DataFrame) -> DataFrame:
    """Steps of verified changes whose file is in the batch."""
    return changes.filter("verified").join(steps, "step").join(batch.select("path").distinct(), "path", "left_semi").select("step").distinct()


def find_declaration(rows: DataFrame) -> DataFrame:
    """``rows`` (symbol, content) with line: the first line that declares the symbol's last name, to its end; null if none does."""
    name = F.regexp_extract("symbol", r"([A-Za-z0-9_$]+)\s*$", 1)
    words = r"(?m)^[ \t]*(?:export[ \t]+|default[ \t]+|async[ \t]+|public[ \t]+|private[ \t]+|static[ \t]+|final[ \t]+)*(?:def|func|function|fn|class|type|interface|struct|enum)[ \t]+(?:\([^)]*\)[ \t]+)?\Q"
    found = F.regexp_substr("content", F.concat(F.lit(words), name, F.lit(r"\E\b[^\n]*")))
    return rows.withColumn("line", F.when(name != "", found))


def detect_architecture(docs: DataFrame) -> DataFrame:
    """(repo_id, pattern) of repositories by their directories and marker files; five patterns in order."""
    p = F.col("path")
    under = lambda *dirs: F.bool_or(p.rlike("^(" + "|".join(dirs) + ")/"))
    named = lambda *files: F.bool_or(p.isin(*files))
    either = lambda d: (d, f"src/{d}")
    package = F.max(F.when(p == "package.json", F.col("content")))
    flags = docs.groupBy("repo_id").agg(
        under(*either("features")).alias("features"), under(*either("entities")).alias("entities"), under(*either("widgets")).alias("widgets"), under(*either("pages")).alias("pages"), under(*either("app")).alias("app"),
        named("next.config.js", "next.config.mjs", "next.config.ts").alias("next"), F.bool_or(p.rlike(r"^(src/)?app/((page|layout)\.(tsx|jsx|js|ts)|route\.(ts|js))$")).alias("routes"), package.alias("package"),
        under(*[x for d in ("components", "hooks", "contexts", "stores", "views") for x in either(d)]).alias("spa"), named("vite.config.ts", "vite.config.js", "vite.config.mjs").alias("vite"),
        named("pubspec.yaml", "go.mod").alias("native"), under("domain", "usecases?", "controllers", "repositories", "lib/features", "lib/presentation").alias("clean"), named("tsconfig.json").alias("ts"), under("src").alias("src"),
    )
    depends = lambda *names: F.coalesce(F.col("package").rlike('"(' + "|".join(names) + r')"\s*:'), F.lit(False))
    next_ = F.col("next") | depends("next")
    pattern = (
        F.when((F.col("features") & F.col("entities")) | (F.col("widgets") & (F.col("features") | F.col("pages"))), "feature_sliced_design")
        .when((next_ & (F.col("app") | F.col("pages"))) | F.col("routes"), "next_app_router")
        .when(depends("react", "react-dom", "@reduxjs/toolkit", "zustand", "recoil", "mobx", "@tanstack/react-query", "vue", "svelte") | (F.col("spa") & F.col("package").isNotNull()) | F.col("vite"), "standard_react_spa")
        .when(F.col("native") | F.col("clean"), "clean_architecture")
        .when(F.col("package").isNotNull() | F.col("ts") | F.col("src"), "generic_frontend")
        .otherwise("clean_architecture")
    )
    return flags.select("repo_id", pattern.alias("pattern"))


def reanchor(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """``anchors`` (path, symbol, span, a text) with outcome: verified where the span stands in the document, adjusted (with the declaration's line) where only its symbol is declared, else unknown_boundary."""
    rows = anchors.join(docs.select("path", "content"), "path", "left")
    rows = find_declaration(rows)
    outcome = F.when(F.contains("content", F.col("span")), "verified").when(F.col("line").isNotNull(), "adjusted").otherwise("unknown_boundary")
    return rows.withColumn("outcome", F.coalesce(outcome, F.lit("unknown_boundary"))).withColumn("span_hash", F.when(F.col("outcome") == "verified", F.sha2("span", 256)).when(F.col("outcome") == "adjusted", F.sha2("line", 256))).drop("content", "line")


def impact_effects(roots: DataFrame, edges: DataFrame, steps: DataFrame, depth: int, budget: int) -> DataFrame:
    """(root, node, depth, kind, target, direct): state changes and outside effects of what each root's calls reach.

    The walk is that of the callers, over the same edges turned round; a claim
    within one call is direct.
    """
    from tracewell.functions.text import effect_split
    from tracewell.operators.graph import impact_claims

    turned = edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"), "idx", "status")
    reached = impact_claims(roots, turned, depth, budget)
    hit = reached.select("root", "node", "depth").join(steps, "node")
    effect = hit.filter("effect is not null").withColumn("e", effect_split(F.col("effect"))).select("root", "node", "depth", F.col("e.kind").alias("kind"), F.col("e.target").alias("target"))
    state = hit.filter("state is not null").select("root", "node", "depth", F.lit("state_mutation").alias("kind"), F.col("state").alias("target"))
    return effect.unionByName(state).withColumn("direct", F.col("depth") <= 1)
