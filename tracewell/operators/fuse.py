"""Steps, edges and evidence: authority, references, alignments and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay_ledger(events: DataFrame, key: str = "subject") -> DataFrame:
    """(key, approved, draft): each key's last approval and draft after its last rejection, in order of seq."""
    dead = events.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("kind") == "reject", F.col("seq"))), F.lit(-1)).alias("_dead"))
    live = events.filter(F.col("kind").isin("approve", "draft")).join(dead, key).filter(F.col("seq") > F.col("_dead"))
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("name")), F.when(F.col("kind") == kind, F.col("seq")))
    return live.groupBy(key).agg(last("approve").alias("approved"), last("draft").alias("draft"))


def fuse_authority(steps: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """``steps`` with step_name, provenance and confidence: approved beats session drafts, which beat derived names."""
    out = steps.join(ledger.select(key, "approved", "draft"), key, "left")
    source = F.when(F.col("approved").isNotNull(), "approved").when(F.col("draft").isNotNull(), "session").otherwise("derived")
    sure = F.when(source == "approved", 1.0).when(source == "session", 0.9).otherwise(0.85)
    return out.withColumn("provenance", source).withColumn("confidence", sure).withColumn("step_name", F.coalesce("approved", "draft", "symbol")).drop("approved", "draft")


def project(steps: DataFrame) -> DataFrame:
    """Kind, state and branch of fused steps: effects are calls, a mutation has a state before and after."""
    moves = (F.col("kind") == "mutation") & ~F.coalesce(F.col("value_role") == "local_binding", F.lit(False))
    return steps.select("flow", "ordinal", F.when(F.col("kind") == "external_effect", "call").otherwise(F.col("kind")).alias("fused_kind"), F.when(moves, F.coalesce("state_before", F.lit("idle"))).alias("before"), F.when(moves, F.coalesce("state_after", F.lit("updated"))).alias("after"), F.col("guard_condition").alias("branch"))


def edge_unknowns(edges: DataFrame) -> DataFrame:
    """(flow, subject, reason) for each edge whose target isn't proven."""
    code = F.col("unresolved_reason")
    known = code.isin("unresolved_dynamic_call", "unresolved_type", "truncated_traversal", "no_evidence", "stale_anchor", "adapter_error")
    by_status = F.when(F.col("resolution_status") == "unresolved_dynamic", "unresolved_dynamic_call").when(F.col("resolution_status") == "truncated", "truncated_traversal").otherwise("unresolved_type")
    reason = F.when(F.coalesce(code, F.lit("")) != "", F.when(known, code).otherwise(by_status)).when(F.col("resolution_status") == "unresolved_dynamic", "unresolved_dynamic_call")
    return edges.select("flow", F.col("to_symbol").alias("subject"), reason.alias("reason")).filter("reason is not null")


def anchor_check(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """``anchors`` (path, byte_start, byte_end, file_hash) with the first rule that fails against the document; null if none does."""
    d = docs.select("path", F.octet_length("content").alias("_size"), F.sha2("content", 256).alias("_hash"))
    reason = (
        F.when(F.col("_size").isNull(), "missing_document")
        .when((F.col("byte_start") < 0) | (F.col("byte_end") < F.col("byte_start")) | (F.col("byte_end") > F.col("_size")), "bad_range")
        .when(~F.col("file_hash").eqNullSafe(F.col("_hash")), "file_hash")
    )
    return anchors.join(d, "path", "left").withColumn("reason", reason).drop("_size", "_hash")


def evidence(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """``anchors`` with the hash, length and validity of the bytes they span, and their lines."""
    body = F.encode("content", "UTF-8")
    out = anchors.join(docs.select("path", "content"), "path")
    span = F.substring(body, F.col("byte_start").cast("int") + 1, (F.col("byte_end") - F.col("byte_start")).cast("int"))
    out = out.withColumn("_span", span)
    from tracewell.functions.text import line_at

    return out.withColumn("span_hash", F.sha2("_span", 256)).withColumn("span_bytes", F.octet_length("_span").cast("long")).withColumn("valid_utf8", F.is_valid_utf8(F.col("_span").cast("string"))).withColumn("line_start", line_at(F.col("content"), F.col("byte_start"))).withColumn("line_end", line_at(F.col("content"), F.col("byte_end"))).drop("_span", "content")


def freshness(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """``anchors`` with freshness: orphaned without a document, fresh if the file or the span is unchanged, else stale."""
    d = docs.select("path", F.sha2("content", 256).alias("_hash"), F.encode("content", "UTF-8").alias("_body"))
    span = F.sha2(F.substring("_body", F.col("byte_start").cast("int") + 1, (F.col("byte_end") - F.col("byte_start")).cast("int")), 256)
    state = F.when(F.col("_hash").isNull(), "orphaned").when((F.col("_hash") == F.col("file_hash")) | (span == F.col("span_hash")), "fresh").otherwise("stale")
    return anchors.join(d, "path", "left").withColumn("freshness", state).drop("_hash", "_body")


def resolve_edges(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """``edges`` with target and outcome: an explicit ordinal that exists, else the only step of that symbol, else a boundary."""
    by_ordinal = steps.select("flow", F.col("ordinal").alias("target_ordinal"), F.lit(True).alias("_there"))
    by_symbol = steps.groupBy("flow", F.col("symbol").alias("to_symbol")).agg(F.count("*").alias("_n"), F.min("ordinal").alias("_only"))
    out = edges.join(by_ordinal, ["flow", "target_ordinal"], "left").join(by_symbol, ["flow", "to_symbol"], "left")
    outcome = F.when(F.col("_there"), "ordinal").when(F.col("target_ordinal").isNull() & (F.col("_n") == 1), "symbol").otherwise("boundary")
    target = F.when(outcome == "ordinal", F.col("target_ordinal")).when(outcome == "symbol", F.col("_only"))
    return out.withColumn("outcome", outcome).withColumn("target", target).drop("_there", "_n", "_only")


def neighbors(calls: DataFrame) -> DataFrame:
    """(symbol, callers, callees): distinct direct neighbours of every symbol."""
    into = calls.groupBy(F.col("callee").alias("symbol")).agg(F.count_distinct("caller").alias("callers"))
    out = calls.groupBy(F.col("caller").alias("symbol")).agg(F.count_distinct("callee").alias("callees"))
    return into.join(out, "symbol", "full_outer").na.fill(0)


def direct_relation(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow, ordinal, direction, edge_idx) of each step: its first outgoing edge, else the first incoming one, else none."""
    out = edges.select("flow", F.col("step_ordinal").alias("ordinal"), F.lit("outgoing").alias("direction"), "edge_idx", F.lit(0).alias("p"))
    into = edges.filter("target_ordinal is not null").select("flow", F.col("target_ordinal").alias("ordinal"), F.lit("incoming").alias("direction"), "edge_idx", F.lit(1).alias("p"))
    best = out.unionByName(into).groupBy("flow", "ordinal").agg(F.min_by(F.struct("direction", "edge_idx"), F.struct("p", "edge_idx")).alias("b"))
    return steps.select("flow", "ordinal").join(best, ["flow", "ordinal"], "left").select("flow", "ordinal", F.coalesce("b.direction", F.lit("none")).alias("direction"), "b.edge_idx")


def ancestors(path) -> object:
    """All ancestors of a path, itself and "." included."""
    parts = F.split(path, "/")
    return F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit(".")))


def closure_hits(changed: DataFrame, scopes: DataFrame) -> DataFrame:
    """(path, cause, scope): observed scopes that a changed path lies in; an equi-join on the path's ancestors."""
    return changed.select("path", F.explode(ancestors(F.col("path"))).alias("scope")).distinct().join(scopes, "scope").select("path", "cause", "scope")


def carry_selection(selected: DataFrame, steps: DataFrame) -> DataFrame:
    """``selected`` (identity) with the step of the new generation that alone has this identity, else identity_lost."""
    alone = steps.groupBy("identity").agg(F.count("*").alias("_n"), F.min("step").alias("_step"))
    out = selected.join(alone, "identity", "left")
    return out.select(*selected.columns, F.when(F.col("_n") == 1, F.col("_step")).alias("step"), (~F.coalesce(F.col("_n") == 1, F.lit(False))).alias("identity_lost"))


def merge_labels(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """``frames`` (flow, frame, title) with label: proposals count only if they are unique, not blank and cover all frames of the flow."""
    given = labels.groupBy("flow", "frame").agg(F.count("*").alias("_n"), F.min("label").alias("_label"))
    out = frames.join(given, ["flow", "frame"], "left")
    good = F.coalesce((F.col("_n") == 1) & (F.trim("_label") != ""), F.lit(False))
    every = out.groupBy("flow").agg(F.min(good).alias("_all"))
    out = out.join(every, "flow")
    return out.select("flow", "frame", F.when(F.col("_all"), F.col("_label")).otherwise(F.col("title")).alias("label"), F.when(F.col("_all"), "labelled").otherwise("fallback").alias("status"))


def flow_index(steps: DataFrame) -> DataFrame:
    """(flow, steps, has_stale, has_unknown) of fused steps."""
    return steps.groupBy("flow").agg(F.count("*").alias("steps"), F.bool_or(F.col("freshness") != "fresh").alias("has_stale"), F.bool_or(F.col("provenance") == "unknown").alias("has_unknown"))


def compact(frames: DataFrame) -> DataFrame:
    """(flow, frames, summary): titles with step counts, joined by a middle dot in order."""
    item = F.concat("title", F.lit(" ("), F.col("steps").cast("string"), F.lit(")"))
    rows = F.sort_array(F.collect_list(F.struct("frame", item.alias("item"))))
    return frames.groupBy("flow").agg(F.count("*").alias("frames"), F.array_join(F.transform(rows, lambda r: r["item"]), " · ").alias("summary"))


def coverage_roots(steps: DataFrame, roots: DataFrame) -> DataFrame:
    """Directories of steps that lie under no coverage root."""
    dirs = steps.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).distinct()
    inside = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("root")).join(roots.select("root"), "root", "left_semi")
    return dirs.join(inside.select("dir"), "dir", "left_anti")


def quality(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow, obligation, met): entry, result, causal_chain and no_unknown of each flow."""
    s = steps.groupBy("flow").agg(F.bool_or(F.col("ordinal") == 1).alias("entry"), F.bool_or(F.col("kind").isin("return", "result")).alias("result"), F.count("*").alias("n"))
    e = edges.groupBy("flow").agg(F.count_distinct(F.when(F.col("resolution_status") == "resolved", F.col("step_ordinal"))).alias("chained"), F.bool_or(F.col("resolution_status") != "resolved").alias("open"))
    out = s.join(e, "flow", "left")
    flags = {"entry": F.col("entry"), "result": F.col("result"), "causal_chain": F.coalesce(F.col("chained") >= F.col("n") - 1, F.col("n") == 1), "no_unknown": ~F.coalesce("open", F.lit(False))}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("obligation"), x.alias("met")) for k, x in flags.items()]))
    return out.select("flow", rows.alias("r")).select("flow", "r.obligation", "r.met")


def obligations(steps: DataFrame, unknowns: DataFrame) -> DataFrame:
    """(flow, kind, target, status) of what a flow must prove: its entry and result, its causal chain (pending until it is proved), each decision by itself, and that nothing critical is unknown."""
    ends = steps.groupBy("flow").agg(F.min("ordinal").alias("entry"), F.max("ordinal").alias("result"))
    open_ = ends.join(unknowns.select("flow", F.lit(True).alias("_open")).distinct(), "flow", "left")
    row = lambda kind, target, status: F.struct(F.lit(kind).alias("kind"), target.cast("long").alias("target"), status.alias("status"))
    fixed = F.array(row("entry", F.col("entry"), F.lit("verified")), row("result", F.col("result"), F.lit("verified")), row("causal_chain", F.lit(None), F.lit("pending")), row("no_critical_unknown", F.lit(None), F.when(F.col("_open"), "unknown").otherwise("verified")))
    one = open_.select("flow", F.explode(fixed).alias("o")).select("flow", "o.*")
    decides = steps.filter(F.col("kind").isin("guard", "branch", "decision")).select("flow", F.lit("critical_branch").alias("kind"), F.col("ordinal").cast("long").alias("target"), F.lit("verified").alias("status"))
    return one.unionByName(decides)


def obligation_summary(owed: DataFrame) -> DataFrame:
    """(flow, required, verified, unresolved): how many obligations there are, all but unknown ones counted as verified."""
    by = owed.groupBy("flow").agg(F.count("*").alias("required"), F.count_if(F.col("status") == "unknown").alias("unresolved"))
    return by.select("flow", "required", (F.col("required") - F.col("unresolved")).alias("verified"), "unresolved")


def criterion_matches(criteria: DataFrame, steps: DataFrame) -> DataFrame:
    """(criterion_id, step): steps that name a criterion among their rules, or whose text has two of its tokens in it (or its only one).

    criteria have text, steps have text and rules. A token is looked up by the
    rarest run of three characters in it; of a criterion's different tokens,
    the one whose run most steps have is no key, as another one must match too.
    Tokens that a criterion repeats count each time.
    """
    from tracewell.functions.text import significant_tokens

    named = steps.select("step", F.explode("rules").alias("rule")).withColumn("_id", F.lower(F.trim("rule")))
    ruled = criteria.select("criterion_id", F.lower(F.trim(F.col("criterion_id").cast("string"))).alias("_id")).join(named, "_id").select("criterion_id", "step")

    runs = lambda text: F.when(F.length(text) > 2, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    told = steps.select("step", F.lower("text").alias("said"))
    index = told.select("step", F.explode(F.array_distinct(runs(F.col("said")))).alias("run"))
    tokens = criteria.select("criterion_id", significant_tokens(F.col("text")).alias("tokens"))
    each = tokens.select("criterion_id", F.explode("tokens").alias("token")).groupBy("criterion_id", "token").agg(F.count("*").alias("times"))
    keyed = each.select("*", F.explode(F.array_distinct(runs(F.col("token")))).alias("run"))
    df = index.join(keyed.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("df"))
    rarest = keyed.join(df, "run", "left").groupBy("criterion_id", "token", "times").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "run")).alias("k"))
    often = F.row_number().over(Window.partitionBy("criterion_id").orderBy(F.desc("k.df"), "token"))
    others = F.count("*").over(Window.partitionBy("criterion_id"))
    keys = rarest.withColumn("_often", often).withColumn("_n", others).filter("_often > 1 or _n = 1 or times > 1").select("criterion_id", "token", F.col("k.run").alias("run"))
    pairs = keys.join(index, "run").select("criterion_id", "step").distinct().join(tokens, "criterion_id").join(told, "step")
    hits = F.size(F.filter("tokens", lambda t: F.contains(F.col("said"), t)))
    return ruled.union(pairs.filter((hits >= 2) | ((hits == 1) & (F.size("tokens") == 1))).select("criterion_id", "step")).distinct()


def alignments(criteria: DataFrame, steps: DataFrame, least: int = 2) -> DataFrame:
    """(criterion_id, steps): how many steps share ``least`` significant tokens with a criterion; 0 is not_observed.

    Tokens are in order of their number of steps, rarest first. Two rows with
    ``least`` tokens in common share one among all but the last least - 1 of
    each, so only those are keys of the join; the rarest token that a pair
    shares keeps it, once.
    """
    rows = steps.select("step", F.array_distinct("tokens").alias("tokens"))
    rank = rows.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"))

    def ordered(df: DataFrame, key: str) -> DataFrame:
        place = df.select(key, F.explode(F.array_distinct("tokens")).alias("t")).join(rank, "t")
        return place.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias(f"{key}_tokens")).filter(F.size(f"{key}_tokens") >= least)

    keys = lambda df, key: df.withColumn("t", F.explode(F.slice(f"{key}_tokens", F.lit(1), F.size(f"{key}_tokens") - (least - 1))))
    pairs = keys(ordered(criteria, "criterion_id"), "criterion_id").join(keys(ordered(rows, "step"), "step"), "t")
    shared = F.array_intersect("criterion_id_tokens", "step_tokens")
    pairs = pairs.withColumn("_shared", shared).filter((F.size("_shared") >= least) & (F.element_at("_shared", 1) == F.col("t")))
    hits = pairs.groupBy("criterion_id").agg(F.count("*").alias("steps"))
    return criteria.select("criterion_id").join(hits, "criterion_id", "left").select("criterion_id", F.coalesce("steps", F.lit(0)).alias("steps"))


def capabilities(features: DataFrame, requested: list[str]) -> DataFrame:
    """(repo, supported, missing): requested relations a repository's features (``relation:<kind>``) cover."""
    kinds = F.transform(F.filter("features", lambda f: f.startswith("relation:")), lambda f: F.substring_index(f, ":", -1))
    want = F.array(*[F.lit(r) for r in requested])
    return features.select("repo", F.array_sort(F.array_intersect(want, kinds)).alias("supported"), F.array_sort(F.array_except(want, kinds)).alias("missing"))


def ordinals(steps: DataFrame) -> DataFrame:
    """Steps whose ordinal isn't their place in the flow."""
    w = Window.partitionBy("flow").orderBy("ordinal")
    return steps.withColumn("expected", F.row_number().over(w).cast("long")).filter(F.col("expected") != F.col("ordinal")).select("flow", "ordinal", "expected")
