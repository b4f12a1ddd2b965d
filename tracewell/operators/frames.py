"""Folding of step sequences into frames, with windows instead of loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import LAYERS, lookup


def flow():
    """The steps of a flow in order."""
    return Window.partitionBy("flow").orderBy("ordinal")


def before():
    return flow().rowsBetween(Window.unboundedPreceding, -1)


def so_far():
    return flow().rowsBetween(Window.unboundedPreceding, 0)


def layer_order(steps: DataFrame, declared: list[str] | None = None) -> DataFrame:
    """(flow, ordinal, layer, below): steps whose layer lies below one that came before; branches are excused."""
    rank = F.coalesce(lookup({x: i for i, x in enumerate(declared or LAYERS)}, F.col("layer")), F.lit(99))
    rows = steps.withColumn("_rank", rank).withColumn("_top", F.max("_rank").over(before()))
    return rows.filter((F.col("_rank") < F.col("_top")) & (F.col("kind") != "branch")).select("flow", "ordinal", "layer", F.col("_top").cast("long").alias("below"))


def step_role(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """``steps`` with role: entry, boundary, effect, decision, process, result or intermediate."""
    out = edges.filter(F.col("kind").isin("external", "async")).select("flow", F.col("step_ordinal").alias("ordinal")).distinct().withColumn("_out", F.lit(True))
    kind = F.col("kind")
    role = (
        F.when((F.col("ordinal") == 1) | (kind == "user_action"), "entry")
        .when(kind == "boundary", "boundary")
        .when(kind.isin("external_effect", "external") | F.col("_out"), "effect")
        .when(kind.isin("guard", "branch", "decision", "failure"), "decision")
        .when((kind == "mutation") | F.col("state_after").isNotNull(), "process")
        .when(kind.isin("return", "throw") & F.col("invocation_id").isNotNull(), "process")
        .when(kind.isin("return", "result"), "result")
        .otherwise("intermediate")
    )
    return steps.join(out, ["flow", "ordinal"], "left").withColumn("role", role).drop("_out")


def step_status(steps: DataFrame, evidence: DataFrame) -> DataFrame:
    """(flow, ordinal, status) from a step's evidence: all verified, all unknown, else partial."""
    by = evidence.groupBy("flow", "ordinal").agg(F.count("*").alias("n"), F.count_if(F.col("validation") == "verified").alias("good"), F.count_if(F.col("validation").isin("unknown", "invalid")).alias("open"))
    status = F.when(F.col("n") == F.col("open"), "unknown").when(F.col("n") == F.col("good"), "verified").otherwise("partial")
    return steps.select("flow", "ordinal").join(by, ["flow", "ordinal"], "left").select("flow", "ordinal", F.coalesce(status, F.lit("partial")).alias("status"))


def can_fold(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """``steps`` with fold: whether a step may join the one before it, by the rule for adjacent pairs.

    Both are of one invocation, symbol and file, neither branches or
    transfers, and one resolved unconditional edge is the only way out of the
    one and into the other. Passing a callback isn't a way.
    """
    ways = edges.filter("kind <> 'callback_argument'")
    outs = ways.groupBy("flow", F.col("step_ordinal").alias("ordinal")).agg(F.count("*").alias("_outs"), F.first("target_ordinal").alias("_to"), F.first(F.col("kind").isin("sequence", "control_flow") & (F.col("resolution_status") == "resolved")).alias("_plain"), F.bool_or((F.col("resolution_status") == "resolved") & F.col("kind").isin("resolved_cross_file", "external", "async")).alias("_enters"))
    ins = ways.filter("target_ordinal is not null").groupBy("flow", F.col("target_ordinal").alias("ordinal")).agg(F.count("*").alias("_ins"))
    rows = steps.join(outs, ["flow", "ordinal"], "left").join(ins, ["flow", "ordinal"], "left")
    prev = lambda c: F.lag(c).over(flow())
    kind, last = F.col("kind"), prev("kind")
    ok = (
        prev("guard_condition").isNull() & F.col("guard_condition").isNull() & ~last.isin("guard", "branch", "decision", "break", "continue", "await", "return", "throw") & ~kind.isin("break", "continue", "await", "return", "throw")
        & prev("invocation_id").eqNullSafe(F.col("invocation_id")) & (prev("symbol") == F.col("symbol")) & (prev("path") == F.col("path"))
        & ~F.coalesce(F.col("_enters"), F.lit(False)) & (prev("_outs") == 1) & (F.col("_ins") == 1) & (prev("_to") == F.col("ordinal")) & prev("_plain")
    )
    return rows.withColumn("fold", F.coalesce(ok, F.lit(False))).drop("_outs", "_to", "_plain", "_enters", "_ins")


def build_frames(steps: DataFrame) -> DataFrame:
    """``steps`` (with role and fold) with frame, numbered from 1 in each flow.

    An intermediate step that may fold joins the frame before it, but not one
    of a boundary, effect or result; the step after such a frame starts one.
    """
    hard = ~((F.col("role") == "intermediate") & F.col("fold"))
    rows = steps.withColumn("_hard", hard.cast("int")).withColumn("_island", F.sum("_hard").over(so_far()))
    island = Window.partitionBy("flow", "_island").orderBy("ordinal")
    rows = rows.withColumn("_place", F.row_number().over(island)).withColumn("_role", F.first("role").over(island))
    starts = (F.col("_place") == 1) | ((F.col("_place") == 2) & F.col("_role").isin("boundary", "effect", "result"))
    return rows.withColumn("frame", F.sum(starts.cast("long")).over(so_far())).drop("_hard", "_island", "_place", "_role")


def cycle_collapse(steps: DataFrame) -> DataFrame:
    """(flow, symbol, first, last): the first symbol of a flow that recurs after another one came between."""
    own = Window.partitionBy("flow", "symbol").orderBy("ordinal")
    rows = steps.withColumn("_before", F.lag("ordinal").over(own))
    again = rows.filter(F.col("_before") < F.col("ordinal") - 1)
    return again.groupBy("flow").agg(F.min_by(F.struct("symbol", F.col("_before").alias("first"), F.col("ordinal").alias("last")), "ordinal").alias("c")).select("flow", "c.symbol", "c.first", "c.last")


def macro_clump(steps: DataFrame) -> DataFrame:
    """``steps`` (role, symbol, category) with clump: guards of one purpose and processes of one symbol in a row; plain steps go with what is before."""
    plain = F.col("role") == "intermediate"
    key = F.when(~plain, F.struct("role", "symbol", F.coalesce("category", F.lit("")).alias("category")))
    prev = F.last(key, ignorenulls=True).over(before())
    same = (prev["role"] == F.col("role")) & (prev["symbol"] == F.col("symbol")) & ((F.col("role") == "process") | ((F.col("role") == "decision") & (prev["category"] == F.coalesce("category", F.lit(""))) & (prev["category"] != "")))
    first = F.row_number().over(flow()) == 1
    starts = F.when(first, True).when(plain, False).otherwise(~F.coalesce(same, F.lit(False)))
    return steps.withColumn("clump", F.sum(starts.cast("long")).over(so_far()))


def significance_top(frames: DataFrame, n: int = 7) -> DataFrame:
    """``frames`` (flow, ordinal, score) with kept and into: first, last and the best others stay; the rest go to the kept one before them."""
    last = Window.partitionBy("flow").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = frames.withColumn("_n", F.count("*").over(last)).withColumn("_edge", (F.col("ordinal") == F.min("ordinal").over(last)) | (F.col("ordinal") == F.max("ordinal").over(last)))
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("flow", "_edge").orderBy(F.col("score").desc(), "ordinal")))
    rows = rows.withColumn("kept", (F.col("_n") <= n) | F.col("_edge") | (F.col("_rank") <= n - 2))
    return rows.withColumn("into", F.last(F.when(F.col("kept"), F.col("ordinal")), ignorenulls=True).over(so_far())).drop("_n", "_edge", "_rank")


def significance_frames(frames: DataFrame, n: int = 7, bonus: int = 1000) -> DataFrame:
    """(flow, place, ordinal, status, absorbed): the ``n`` frames of a flow that stay, in order, with what they took in.

    frames have score, recursion, step_ref, status, role and steps (how many).
    First and last stay, then the best others, by score, recursions raised by
    ``bonus``, then step_ref. A frame that goes is taken in by the one kept
    before it: its steps count as absorbed, and it makes a verified one partial
    if it is unknown, partial or a boundary. Frames without a status are
    unknown if they are boundaries, else verified.
    """
    every = Window.partitionBy("flow").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = frames.withColumn("_n", F.count("*").over(every)).withColumn("_edge", (F.col("ordinal") == F.min("ordinal").over(every)) | (F.col("ordinal") == F.max("ordinal").over(every)))
    value = F.col("score") + F.when(F.coalesce("recursion", F.lit(False)), bonus).otherwise(0)
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("flow", "_edge").orderBy(value.desc(), "step_ref", "ordinal")))
    rows = rows.withColumn("_kept", (F.col("_n") <= n) | F.col("_edge") | (F.col("_rank") <= n - 2)).withColumn("place", F.sum(F.col("_kept").cast("long")).over(so_far()))
    given = F.when(F.coalesce("status", F.lit("")) != "", F.col("status")).when(F.col("role") == "boundary", "unknown").otherwise("verified")
    weak = ~F.col("_kept") & (F.coalesce(F.col("status").isin("unknown", "partial"), F.lit(False)) | (F.col("role") == "boundary"))
    by = rows.groupBy("flow", "place").agg(F.min("ordinal").alias("ordinal"), F.max(F.when(F.col("_kept"), given)).alias("_own"), F.bool_or(weak).alias("_weak"), F.coalesce(F.sum(F.when(~F.col("_kept"), F.col("steps"))), F.lit(0)).cast("long").alias("absorbed"))
    return by.select("flow", "place", "ordinal", F.when((F.col("_own") == "verified") & F.col("_weak"), "partial").otherwise(F.col("_own")).alias("status"), "absorbed")


def display_fold(steps: DataFrame, most: int) -> DataFrame:
    """(flow, first, last, hidden): runs of non-critical steps between critical ones, in flows with more than ``most`` steps."""
    every = Window.partitionBy("flow")
    rows = steps.withColumn("_n", F.count("*").over(every)).withColumn("_run", F.sum(F.col("critical").cast("long")).over(so_far())).filter((F.col("_n") > most) & ~F.col("critical"))
    runs = rows.groupBy("flow", "_run").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("n"))
    return runs.filter("n > 2").select("flow", "first", "last", (F.col("n") - 2).alias("hidden"))
