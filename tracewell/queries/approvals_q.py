"""Queries over approval histories: about five events an aggregate, with every fault."""

from __future__ import annotations

from tracewell.operators import approvals as A
from tracewell.queries.registry import query

_EVENTS = """
a_event AS (SELECT *, lag(approval_id) OVER (PARTITION BY aggregate_id ORDER BY seq) AS before_id FROM (SELECT concat(CAST(subject AS string), '-', CAST(seq // 75 AS string)) AS aggregate_id, seq, CASE WHEN seq % 23 = 0 THEN 'e' ELSE concat('e', CAST(seq AS string)) END AS event_id, CASE seq % 19 WHEN 0 THEN 'dup' WHEN 1 THEN ' ' ELSE concat('a', CAST(seq AS string)) END AS approval_id,
  row_number() OVER (PARTITION BY subject, seq // 75 ORDER BY seq) AS n, CASE WHEN row_number() OVER (PARTITION BY subject, seq // 75 ORDER BY seq) = 1 AND seq % 4 > 0 THEN 'approve' WHEN seq % 11 < 6 THEN 'edit_then_approve' WHEN seq % 11 = 6 THEN 'reject' WHEN seq % 11 = 7 THEN 'revoke' WHEN seq % 11 = 8 THEN 'supersede' ELSE 'approve' END AS decision FROM v_ledger) x),
a_log AS (SELECT aggregate_id, seq, event_id, approval_id, n, decision, CASE WHEN seq % 29 = 0 THEN n + 1 ELSE n END AS version, CASE WHEN seq % 7 = 0 THEN 'x' WHEN seq % 31 = 0 THEN ' ' WHEN seq % 5 > 0 AND decision <> 'approve' THEN before_id END AS predecessor_id, CASE WHEN seq % 9 = 0 THEN 'edit' WHEN decision = 'approve' THEN 'initial' WHEN decision = 'edit_then_approve' THEN 'edit' ELSE decision END AS relation, CASE WHEN seq % 6 = 0 THEN ' ' ELSE 't' END AS approved_text FROM a_event),
a_entry AS (SELECT aggregate_id, n AS position, CASE WHEN seq % 17 = 0 THEN n + 1 ELSE n END AS version, CASE WHEN seq % 13 = 0 THEN 'active' WHEN decision = 'reject' THEN 'rejected' WHEN decision = 'revoke' THEN 'revoked' WHEN decision = 'supersede' THEN 'superseded' ELSE 'active' END AS state, CASE WHEN seq % 37 = 0 THEN 'revoke' ELSE decision END AS decision, CASE WHEN seq % 41 = 0 THEN 'other' ELSE event_id END AS event_id, CASE WHEN seq % 43 = 0 THEN 'other' ELSE approval_id END AS approval_id FROM a_event WHERE seq % 47 <> 0
  UNION ALL SELECT aggregate_id, 0, CASE WHEN min(seq) % 8 = 0 THEN 1 ELSE 0 END, 'none', 'none', concat('g', aggregate_id), CASE WHEN min(seq) % 9 = 0 THEN 'a' END FROM a_event GROUP BY aggregate_id),
a_last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY position DESC) AS back, sum(position) OVER (PARTITION BY aggregate_id) AS k FROM a_entry) y WHERE back = 1),
a_sum AS (SELECT aggregate_id, CASE WHEN k % 10 = 1 THEN version + 1 ELSE version END AS version, CASE WHEN k % 9 = 2 THEN 'none' ELSE state END AS state, CASE WHEN k % 8 = 3 THEN 'x' ELSE event_id END AS last_event_id, CASE WHEN k % 7 = 4 THEN 'x' ELSE decision END AS last_decision, CASE WHEN k % 5 = 3 THEN NULL WHEN k % 4 = 2 THEN 'x' WHEN state = 'active' THEN approval_id END AS active_id FROM a_last)"""


def _table(v, name: str):
    return v["v_ledger"].sparkSession.sql(f"WITH {_EVENTS.replace('//', 'div')} SELECT * FROM {name}")


def _rows(table: str, columns: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {columns}, '{rule}' AS rule FROM {table} WHERE {test}" for rule, test in rules.items())


@query("approval_events", "v_ledger", f"WITH {_EVENTS} " + _rows("a_log", "aggregate_id, seq", {
    "id_blank": "trim(approval_id) = ''", "initial_version": "relation = 'initial' AND version <> 1", "relation": "relation <> CASE decision WHEN 'approve' THEN 'initial' WHEN 'edit_then_approve' THEN 'edit' ELSE decision END", "approved_text": "decision IN ('approve', 'edit_then_approve') AND trim(approved_text) = ''",
    "predecessor_blank": "trim(predecessor_id) = ''", "predecessor_given": "decision = 'approve' AND predecessor_id IS NOT NULL", "predecessor_missing": "decision IN ('edit_then_approve', 'revoke', 'supersede') AND predecessor_id IS NULL",
}))
def approval_events(v):
    return A.event_rules(_table(v, "a_log"))


@query("approval_entries", "v_ledger", f"WITH {_EVENTS}, h AS (SELECT a.*, b.version AS pv, b.state AS ps, row_number() OVER (PARTITION BY a.aggregate_id, a.event_id ORDER BY a.position) AS en, row_number() OVER (PARTITION BY a.aggregate_id, a.approval_id ORDER BY a.position) AS an FROM (SELECT *, lag(position) OVER (PARTITION BY aggregate_id ORDER BY position) AS pp FROM a_entry) a LEFT JOIN a_entry b ON b.aggregate_id = a.aggregate_id AND b.position = a.pp) " + _rows("h", "aggregate_id, position", {
    "genesis": "position = 0 AND version <> 0", "genesis_approval": "position = 0 AND approval_id IS NOT NULL", "event_id": "en > 1", "approval_id": "position > 0 AND (trim(approval_id) = '' OR an > 1)", "version_gap": "position > 0 AND version <> pv + 1", "after_terminal": "position > 0 AND ps IN ('rejected', 'revoked', 'superseded')",
    "state": "position > 0 AND state <> CASE decision WHEN 'reject' THEN 'rejected' WHEN 'revoke' THEN 'revoked' WHEN 'supersede' THEN 'superseded' ELSE 'active' END", "approve_not_first": "position > 0 AND decision = 'approve' AND ps <> 'none'", "needs_active": "position > 0 AND decision IN ('edit_then_approve', 'revoke', 'supersede') AND ps <> 'active'",
}))
def approval_entries(v):
    return A.history_rules(_table(v, "a_entry"))


@query("approval_summaries", "v_ledger", f"WITH {_EVENTS}, j AS (SELECT s.*, l.version AS lv, l.state AS ls, l.event_id AS le, l.decision AS ld, l.approval_id AS la FROM a_sum s JOIN a_last l USING (aggregate_id)) " + _rows("j", "aggregate_id", {
    "version": "version <> lv", "state": "state <> ls", "last_event": "last_event_id <> le", "last_decision": "last_decision <> ld", "active_missing": "state = 'active' AND active_id IS NULL", "active_id": "state = 'active' AND active_id IS DISTINCT FROM la AND active_id IS NOT NULL", "inactive_shown": "state <> 'active' AND trim(coalesce(active_id, '')) <> ''",
}))
def approval_summaries(v):
    return A.summary_rules(_table(v, "a_sum"), _table(v, "a_entry"))


@query("approval_matches", "v_ledger", f"WITH {_EVENTS}, j AS (SELECT coalesce(l.aggregate_id, e.aggregate_id) AS aggregate_id, coalesce(n, e.position) AS position, l.*  EXCLUDE (aggregate_id), e.version AS ev, e.event_id AS ee, e.approval_id AS ea, e.decision AS ed, b.state AS bs, b.approval_id AS ba FROM a_log l FULL JOIN (SELECT * FROM a_entry WHERE position > 0) e ON e.aggregate_id = l.aggregate_id AND e.position = n LEFT JOIN a_entry b ON b.aggregate_id = coalesce(l.aggregate_id, e.aggregate_id) AND b.position = coalesce(n, e.position) - 1) " + _rows("j", "aggregate_id, position", {
    "unmatched": "ee IS NULL OR event_id IS NULL", "event_version": "version <> position", "entry_version": "ev <> position", "event_id": "event_id <> ee", "approval_id": "approval_id <> ea", "decision": "decision <> ed",
    "predecessor": "ee IS NOT NULL AND (decision IN ('edit_then_approve', 'revoke', 'supersede') AND predecessor_id IS DISTINCT FROM ba OR decision = 'reject' AND predecessor_id IS NOT NULL AND (bs = 'none' OR bs = 'active' AND predecessor_id IS DISTINCT FROM ba))",
}))
def approval_matches(v):
    return A.replay_rules(_table(v, "a_log"), _table(v, "a_entry"))


@query("approval_replay", "v_ledger", f"""
WITH RECURSIVE {_EVENTS},
z AS (SELECT aggregate_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS reason, 0::BIGINT AS version, 'none' AS state, NULL::VARCHAR AS active_id FROM (SELECT DISTINCT aggregate_id FROM a_log) d
  UNION ALL SELECT aggregate_id, n, seq, reason, CASE WHEN reason IS NULL THEN version + 1 ELSE version END, CASE WHEN reason IS NOT NULL THEN state WHEN decision = 'reject' THEN 'rejected' WHEN decision = 'revoke' THEN 'revoked' WHEN decision = 'supersede' THEN 'superseded' ELSE 'active' END, CASE WHEN reason IS NOT NULL THEN active_id WHEN decision IN ('approve', 'edit_then_approve') THEN approval_id END
  FROM (SELECT z.aggregate_id, l.n, l.seq, z.version, z.state, z.active_id, l.decision, l.approval_id, CASE WHEN z.state IN ('rejected', 'revoked', 'superseded') THEN 'terminal' WHEN l.decision = 'approve' AND z.state <> 'none' THEN 'approve_not_first' WHEN l.decision IN ('edit_then_approve', 'revoke', 'supersede') AND z.state <> 'active' THEN 'needs_active'
    WHEN l.predecessor_id IS DISTINCT FROM z.active_id AND (l.decision IN ('edit_then_approve', 'revoke', 'supersede') OR l.decision = 'reject' AND l.predecessor_id IS NOT NULL) THEN 'predecessor' END AS reason FROM z JOIN a_log l ON l.aggregate_id = z.aggregate_id AND l.n = z.n + 1) q)
SELECT aggregate_id, seq, reason, version, state, active_id FROM z WHERE n > 0""")
def approval_replay(v):
    return A.replay(_table(v, "a_log"))
