"""What a reader of flows is told: signatures of declarations, limitations of frames, the review of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.graph import reachable

# Lines scanned above a place, lines and characters of a signature, bytes of a text that is scanned.
SCAN_LINES, SIGNATURE_LINES, SIGNATURE_CHARS, SCAN_BYTES = 40, 5, 200, 524288
# Words that open a branch or a loop, and words that open a type.
CONTROL = ["if", "for", "while", "switch", "catch", "try", "else", "do"]
TYPES = ["class", "mixin", "extension", "enum"]


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def opens_declaration(line: Column) -> Column:
    """Whether a stripped line heads a type, or a function whose parameters or body begin there."""
    head = F.regexp_replace(line, r"[({]$", "")
    control = head.rlike(rf"^({'|'.join(CONTROL)})([ \t(]|$)")
    type_ = head.rlike(rf"^({'|'.join(TYPES)}) ")
    comment = line.startswith("//") | line.startswith("*")
    call = line.endswith("(") & (_stripped(head) != "")
    body = line.endswith("{") & head.contains("(") & ~head.startswith("}") & ~head.contains(";")
    return ~comment & ((line.endswith("{") & type_) | (~control & (call | body)))


def signatures(rows: DataFrame) -> DataFrame:
    """``rows`` (content, byte_offset, line_hint, symbol_hint) with signature and line.

    The place is the line of a byte offset inside the text, else the hinted
    line. If that line doesn't name the symbol, the nearest declaration above
    that does is taken (SCAN_LINES lines), else the first in the text, else
    the nearest of the least indented ones above, else the place itself. A
    signature ends with a brace, a semicolon or the parenthesis of a later
    line. Empty and null texts, texts over SCAN_BYTES and places beyond the
    end give an empty signature and line 0.
    """
    size, offset, hint = F.octet_length("content"), F.col("byte_offset"), F.coalesce("symbol_hint", F.lit(""))
    before = F.expr("size(split(string(substring(binary(content), 1, int(byte_offset))), '\n'))")
    out = rows.withColumn("_lines", F.when(size.between(1, SCAN_BYTES), F.split("content", "\n"))).withColumn("_text", F.transform("_lines", _stripped))
    out = out.withColumn("_start", F.greatest(F.when((offset > 0) & (offset < size), before).otherwise(F.coalesce("line_hint", F.lit(0))), F.lit(1)).cast("int"))
    out = out.withColumn("_lines", F.when(F.col("_start") <= F.size("_lines"), F.col("_lines"))).withColumn("_heads", F.transform("_text", opens_declaration)).withColumn("_named", F.transform("_text", lambda t: t.contains(hint)))
    start = F.col("_start")
    above = F.filter(F.sequence(F.greatest(F.lit(1), start - SCAN_LINES), start), lambda i: (i < start) & F.get("_heads", i - 1))
    named = lambda places: F.filter(places, lambda i: F.get("_heads", i - 1) & F.get("_named", i - 1))
    indent = lambda i: F.length(F.regexp_extract(F.get("_lines", i - 1), r"^[ \t]*", 0))
    least = -F.array_min(F.transform(above, lambda i: F.struct(indent(i).alias("indent"), (-i).alias("at"))))["at"]
    lost = (hint != "") & ~F.get("_lines", start - 1).contains(hint)
    line = F.when(lost, F.coalesce(F.array_max(named(above)), F.array_min(named(F.sequence(F.lit(1), F.size("_lines")))), least, start)).otherwise(start)
    out = out.withColumn("line", F.when(F.col("_lines").isNotNull(), line).otherwise(0))
    body = F.slice(F.filter(F.slice("_text", F.greatest("line", F.lit(1)), F.size("_text")), lambda t: t != ""), 1, SIGNATURE_LINES)
    out = out.withColumn("_body", F.when(F.col("line") > 0, body))
    ends = F.filter(F.transform("_body", lambda t, i: F.when(t.rlike("[{;]$") | ((i > 0) & t.endswith(")")), i + 1)), lambda i: i.isNotNull())
    joined = _stripped(F.regexp_replace(F.array_join(F.slice("_body", 1, F.coalesce(F.array_min(ends), F.lit(SIGNATURE_LINES))), " "), r"(?U)\s+", " "))
    out = out.withColumn("_joined", F.coalesce(joined, F.lit(""))).withColumn("_joined", F.expr("if(instr(_joined, '{') > 0, trim(left(_joined, instr(_joined, '{'))), _joined)"))
    short = F.when(F.length("_joined") > SIGNATURE_CHARS, F.concat(F.left("_joined", F.lit(SIGNATURE_CHARS)), F.lit("…"))).otherwise(F.col("_joined"))
    return out.withColumn("signature", short).drop("_lines", "_text", "_start", "_heads", "_named", "_body", "_joined")


def limitations(frames: DataFrame, steps: DataFrame, edges: DataFrame, specific: DataFrame, requests: DataFrame) -> DataFrame:
    """(flow, frame, code): what limits the reading of a frame.

    frames are (flow, frame, role, ordinal), a row for each step, frame giving
    their order; specific are the steps (flow, ordinal) that a request needs,
    requests the flows with one. invocation_unproven: a step's invocation
    isn't reached from that of the flow's first step by resolved calls across
    files, each to a step that names its caller. request_relevance_unproven:
    all frames of a requested flow without a specific step.
    grouping_evidence_missing: neighbouring frames of one state change each,
    of one place in the source, joined by nothing but one plain control flow;
    frames whose steps are all unproven don't have it as well.
    """
    inv = steps.select("flow", "ordinal", "invocation_id", "caller_ordinal")
    node = lambda c: F.struct("flow", F.col(c).alias("invocation_id"))
    roots = inv.groupBy("flow").agg(F.min_by("invocation_id", "ordinal").alias("_root")).filter("_root is not null")
    calls = edges.filter("kind = 'resolved_cross_file' and resolution_status = 'resolved'").select("flow", F.col("step_ordinal").alias("from"), F.col("target_ordinal").alias("to"))
    calls = calls.join(inv.select("flow", F.col("ordinal").alias("from"), F.col("invocation_id").alias("a")), ["flow", "from"]).join(inv.select("flow", F.col("ordinal").alias("to"), F.col("invocation_id").alias("b"), "caller_ordinal"), ["flow", "to"])
    calls = calls.filter("caller_ordinal = from and a is not null and b is not null")
    start = roots.select(node("_root").alias("node")).select(F.col("node").alias("root"), "node")
    walked = reachable(start, calls.select(node("a").alias("source"), node("b").alias("target"))).select("node.flow", "node.invocation_id", F.lit(True).alias("_ok"))
    members = frames.join(inv.drop("caller_ordinal"), ["flow", "ordinal"], "left").join(walked, ["flow", "invocation_id"], "left").join(roots.select("flow", F.lit(True).alias("_rooted")), "flow", "left")
    unproven = F.col("invocation_id").isNotNull() & F.col("_ok").isNull() & F.col("_rooted")
    dark = members.groupBy("flow", "frame").agg(F.bool_or(unproven).alias("_any"), F.bool_and(F.coalesce(unproven, F.lit(False))).alias("_all")).filter("_any")
    open_ = requests.select("flow").distinct().join(specific.select("flow"), "flow", "left_anti")
    missing = _plain_runs(frames, steps, edges, specific).join(dark.filter("_all").select("flow", "frame"), ["flow", "frame"], "left_anti")
    code = lambda df, name: df.select("flow", "frame", F.lit(name).alias("code")).distinct()
    return code(dark, "invocation_unproven").unionByName(code(frames.join(open_, "flow"), "request_relevance_unproven")).unionByName(code(missing, "grouping_evidence_missing"))


def _plain_runs(frames: DataFrame, steps: DataFrame, edges: DataFrame, specific: DataFrame) -> DataFrame:
    """(flow, frame) of neighbouring frames of one state change each that a single plain control flow joins."""
    place = ["invocation_id", "path", "symbol"]
    each = frames.groupBy("flow", "frame").agg(F.count("*").alias("_n"), F.min("role").alias("_role"), F.min("ordinal").alias("ordinal"))
    rows = each.join(steps.select("flow", "ordinal", "kind", *place), ["flow", "ordinal"], "left").join(specific.select("flow", "ordinal", F.lit(True).alias("_own")).distinct(), ["flow", "ordinal"], "left")
    ways = edges.filter("kind <> 'callback_argument'")
    plain = (F.col("kind") == "control_flow") & (F.col("resolution_status") == "resolved") & F.col("condition").isNull()
    outs = ways.groupBy("flow", F.col("step_ordinal").alias("ordinal")).agg(F.count("*").alias("_outs"), F.max("target_ordinal").alias("_to"), F.bool_and(plain).alias("_plain"))
    ins = ways.filter("target_ordinal is not null").groupBy("flow", F.col("target_ordinal").alias("ordinal")).agg(F.count("*").alias("_ins"))
    rows = rows.join(outs, ["flow", "ordinal"], "left").join(ins, ["flow", "ordinal"], "left")
    single = (F.col("_n") == 1) & (F.col("_role") == "process") & (F.col("kind") == "mutation") & F.col("_own").isNull() & F.col("invocation_id").isNotNull()
    order = Window.partitionBy("flow").orderBy("frame")
    rows = rows.withColumn("_one", F.coalesce(single, F.lit(False)))
    prev = lambda c: F.lag(c).over(order)
    joined = prev("_one") & F.col("_one") & (prev("_outs") == 1) & (F.col("_ins") == 1) & (prev("_to") == F.col("ordinal")) & prev("_plain")
    for c in place:
        joined = joined & prev(c).eqNullSafe(F.col(c))
    rows = rows.withColumn("_joined", F.coalesce(joined, F.lit(False)))
    return rows.withColumn("_next", F.coalesce(F.lead("_joined").over(order), F.lit(False))).filter("_joined or _next").select("flow", "frame")


def curation_review(steps: DataFrame, frames: DataFrame, edges: DataFrame, alignments: DataFrame, limited: DataFrame, requests: DataFrame) -> DataFrame:
    """One row a step (flow, ordinal): rule, relation, criterion_id, reason, members, edges and limited.

    steps have role, kind, invocation_id, rules (texts) and purpose; frames a
    row for each step; alignments a row (flow, criterion_id, ordinal) for each
    step that a confirmed criterion covers. rule is the role, but
    unclassified_process for intermediate steps and local_completion for
    returns and throws inside an invocation. relation is criterion (the least
    that covers this step alone), target (by a rule of the step), scope or,
    without a request, trace. reason is merged, distinct_decisions (a mixed
    purpose, or a neighbouring decision of another), consequence or
    no_evidence. members are the frame's steps, edges those in and out but for
    passed callbacks.
    """
    done = (F.col("role") == "process") & F.col("invocation_id").isNotNull() & F.col("kind").isin("return", "throw")
    rule = F.when(F.col("role") == "intermediate", "unclassified_process").when(done, "local_completion").otherwise(F.col("role"))
    alone = alignments.distinct().groupBy("flow", "criterion_id").agg(F.count("*").alias("_n"), F.min("ordinal").alias("ordinal")).filter("_n = 1").groupBy("flow", "ordinal").agg(F.min("criterion_id").alias("criterion_id"))
    named = frames.select("flow", "frame", "ordinal")
    member = named.join(named.groupBy("flow", "frame").agg(F.array_sort(F.collect_set("ordinal")).alias("members")), ["flow", "frame"])
    ways = edges.filter("kind <> 'callback_argument'")
    ends = ways.select("flow", "edge_idx", "kind", F.col("step_ordinal").alias("ordinal"), F.col("target_ordinal").alias("other")).union(ways.filter("target_ordinal is not null").select("flow", "edge_idx", "kind", "target_ordinal", "step_ordinal"))
    decides = F.col("kind").isin("guard", "branch", "decision")
    near = steps.filter(decides).select("flow", F.col("ordinal").alias("other"), F.col("purpose").alias("_p"))
    ends = ends.join(near, ["flow", "other"], "left").join(steps.select("flow", "ordinal", "purpose"), ["flow", "ordinal"])
    by_step = ends.groupBy("flow", "ordinal").agg(F.array_sort(F.collect_set("edge_idx")).alias("edges"), F.bool_or((F.col("kind") == "control_flow") & (F.col("_p") != F.col("purpose"))).alias("_differs"))
    rows = steps.withColumn("rule", rule).join(alone, ["flow", "ordinal"], "left").join(member, ["flow", "ordinal"], "left").join(by_step, ["flow", "ordinal"], "left")
    rows = rows.join(limited.select("flow", "frame", F.lit(True).alias("_limited")).distinct(), ["flow", "frame"], "left").join(requests.select("flow", F.lit(True).alias("_asked")).distinct(), "flow", "left")
    target = F.exists(F.coalesce("rules", F.array().cast("array<string>")), lambda r: r.isin("request_target", "essential") | r.startswith("essential:"))
    relation = F.when(F.col("criterion_id").isNotNull(), "criterion").when(target, "target").when(F.col("_asked"), "scope").otherwise("trace")
    apart = (F.col("rule") == "decision") & ((F.col("purpose") == "mixed") | F.coalesce("_differs", F.lit(False)))
    reason = F.when(F.size("members") > 1, "merged").when(apart, "distinct_decisions").when(F.col("rule").isin("entry", "boundary", "effect", "result"), "consequence").otherwise("no_evidence")
    return rows.select("flow", "ordinal", "frame", "rule", relation.alias("relation"), "criterion_id", reason.alias("reason"), "members", F.coalesce("edges", F.array().cast("array<long>")).alias("edges"), F.coalesce("_limited", F.lit(False)).alias("limited"))
