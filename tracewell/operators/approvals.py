"""Approvals as append-only histories: what an event, a history and its summary must hold, and a replay that takes only legal decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The state and the relation to what came before that each decision makes; states after which nothing follows.
STATES = {"approve": "active", "edit_then_approve": "active", "reject": "rejected", "revoke": "revoked", "supersede": "superseded"}
RELATIONS = {"approve": "initial", "edit_then_approve": "edit", "reject": "reject", "revoke": "revoke", "supersede": "supersede"}
TERMINAL = ("rejected", "revoked", "superseded")
FOLLOWING = ("edit_then_approve", "revoke", "supersede")


def _of(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _broken(rows: DataFrame, checks: dict[str, Column], *columns: str) -> DataFrame:
    """A row for each of ``checks`` that holds."""
    return rows.select(*columns, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("rule"))


def event_rules(events: DataFrame) -> DataFrame:
    """(aggregate_id, seq, rule) of events by themselves: blank ids, an initial one that isn't version 1, a relation of another decision, an approval without text, a predecessor where none or one must be."""
    decision, named = F.col("decision"), F.col("predecessor_id").isNotNull()
    checks = {
        "id_blank": _blank("event_id") | _blank("approval_id"),
        "initial_version": (F.col("relation") == "initial") & (F.col("version") != 1),
        "relation": ~F.col("relation").eqNullSafe(_of(RELATIONS, decision)),
        "approved_text": decision.isin("approve", "edit_then_approve") & _blank("approved_text"),
        "predecessor_blank": named & _blank("predecessor_id"),
        "predecessor_given": (decision == "approve") & named,
        "predecessor_missing": decision.isin(*FOLLOWING) & ~named,
    }
    return _broken(events, checks, "aggregate_id", "seq")


def history_rules(entries: DataFrame) -> DataFrame:
    """(aggregate_id, position, rule) of histories (position from 0, version, state, decision, event_id, approval_id): the first entry is empty, ids are unique, versions follow each other, and each decision makes its state from one that allows it."""
    order = Window.partitionBy("aggregate_id").orderBy("position")
    rows = entries.withColumn("_version", F.lag("version").over(order)).withColumn("_state", F.lag("state").over(order))
    for c in ("event_id", "approval_id"):
        rows = rows.withColumn(f"_{c}", F.row_number().over(Window.partitionBy("aggregate_id", c).orderBy("position")) > 1)
    first, decision, before = F.col("position") == 0, F.col("decision"), F.col("_state")
    later = ~first
    checks = {
        "genesis": first & ~((F.col("version") == 0) & (F.col("state") == "none") & (decision == "none")),
        "genesis_approval": first & F.col("approval_id").isNotNull(),
        "event_id": _blank("event_id") | F.col("_event_id"),
        "approval_id": later & (_blank("approval_id") | F.col("_approval_id")),
        "version_gap": later & (F.col("version") != F.col("_version") + 1),
        "after_terminal": later & before.isin(*TERMINAL),
        "state": later & ~F.col("state").eqNullSafe(_of(STATES, decision)),
        "approve_not_first": later & (decision == "approve") & (before != "none"),
        "needs_active": later & decision.isin(*FOLLOWING) & (before != "active"),
    }
    return _broken(rows, checks, "aggregate_id", "position")


def summary_rules(aggregates: DataFrame, entries: DataFrame) -> DataFrame:
    """(aggregate_id, rule) of summaries (version, state, last_event_id, last_decision, active_id) that differ from their history's last entry; only an active one shows its approval."""
    last = entries.groupBy("aggregate_id").agg(F.max_by(F.struct("version", "state", "event_id", "decision", "approval_id"), "position").alias("_l"))
    rows = aggregates.join(last, "aggregate_id", "left")
    same = lambda c, x: F.col(c).eqNullSafe(F.col(f"_l.{x}"))
    active = F.col("state") == "active"
    checks = {
        "history_missing": F.col("_l").isNull(),
        "version": F.col("_l").isNotNull() & ~same("version", "version"),
        "state": F.col("_l").isNotNull() & ~same("state", "state"),
        "last_event": F.col("_l").isNotNull() & ~same("last_event_id", "event_id"),
        "last_decision": F.col("_l").isNotNull() & ~same("last_decision", "decision"),
        "active_missing": active & F.col("active_id").isNull(),
        "active_id": active & F.col("active_id").isNotNull() & ~same("active_id", "approval_id"),
        "inactive_shown": ~active & ~_blank("active_id"),
    }
    return _broken(rows, checks, "aggregate_id")


def replay_rules(events: DataFrame, entries: DataFrame) -> DataFrame:
    """(aggregate_id, position, rule) of events, in order of seq, against the entries they made: event n made entry n, of its version, ids and decision, and names the entry before as predecessor where it must."""
    numbered = events.withColumn("position", F.row_number().over(Window.partitionBy("aggregate_id").orderBy("seq")))
    made = entries.filter("position > 0").select("aggregate_id", "position", F.struct("version", "event_id", "approval_id", "decision").alias("_made"))
    before = entries.select("aggregate_id", (F.col("position") + 1).alias("position"), F.struct("state", "approval_id").alias("_before"))
    rows = numbered.join(made, ["aggregate_id", "position"], "full_outer").join(before, ["aggregate_id", "position"], "left")
    both = F.col("_made").isNotNull() & F.col("event_id").isNotNull()
    named, other = F.col("predecessor_id").isNotNull(), ~F.col("predecessor_id").eqNullSafe(F.col("_before.approval_id"))
    rejects = F.col("decision") == "reject"
    predecessor = (F.col("decision").isin(*FOLLOWING) & other) | (rejects & named & ((F.col("_before.state") == "none") | ((F.col("_before.state") == "active") & other)))
    checks = {
        "unmatched": ~F.coalesce(both, F.lit(False)),
        "event_version": F.col("event_id").isNotNull() & (F.col("version") != F.col("position")),
        "entry_version": both & (F.col("_made.version") != F.col("position")),
        "event_id": both & (F.col("event_id") != F.col("_made.event_id")),
        "approval_id": both & ~F.col("approval_id").eqNullSafe(F.col("_made.approval_id")),
        "decision": both & (F.col("decision") != F.col("_made.decision")),
        "predecessor": both & predecessor,
    }
    return _broken(rows.withColumn("position", F.col("position").cast("long")), checks, "aggregate_id", "position")


def replay(commands: DataFrame) -> DataFrame:
    """(aggregate_id, seq, reason, version, state, active_id): each command (decision, approval_id, predecessor_id) judged in the state that the accepted ones before it have made.

    A fold in order of seq over an aggregate's own commands. An accepted one
    has no reason and raises the version by one; a refused one changes
    nothing: terminal, approve_not_first, needs_active or predecessor (not the
    active approval).
    """
    history = commands.groupBy("aggregate_id").agg(F.array_sort(F.collect_list(F.struct("seq", "decision", "approval_id", "predecessor_id"))).alias("all"))
    row = "struct<seq:bigint,reason:string,version:bigint,state:string,active_id:string>"
    start = F.struct(F.lit(0).cast("long").alias("version"), F.lit("none").alias("state"), F.lit(None).cast("string").alias("active_id"), F.array().cast(f"array<{row}>").alias("log"))

    def step(acc: Column, c: Column) -> Column:
        decision, state, follows = c["decision"], acc["state"], c["decision"].isin(*FOLLOWING)
        wrong = ~c["predecessor_id"].eqNullSafe(acc["active_id"])
        named = c["predecessor_id"].isNotNull()
        reason = (
            F.when(state.isin(*TERMINAL), "terminal")
            .when((decision == "approve") & (state != "none"), "approve_not_first")
            .when(follows & (state != "active"), "needs_active")
            .when((follows & wrong) | ((decision == "reject") & named & wrong), "predecessor")
        )
        taken = reason.isNull()
        now = F.when(taken, _of(STATES, decision)).otherwise(state)
        version = acc["version"] + taken.cast("long")
        active = F.when(taken, F.when(now == "active", c["approval_id"])).otherwise(acc["active_id"])
        entry = F.struct(c["seq"].alias("seq"), reason.alias("reason"), version.alias("version"), now.alias("state"), active.alias("active_id"))
        return F.struct(version.alias("version"), now.alias("state"), active.alias("active_id"), F.concat(acc["log"], F.array(entry)).alias("log"))

    return history.select("aggregate_id", F.explode(F.aggregate("all", start, step, lambda acc: acc["log"])).alias("r")).select("aggregate_id", "r.*")
