"""Queries over atomic batches of changes."""

from __future__ import annotations

from tracewell.queries.registry import query
from tracewell.streaming import batches as B

# Six repositories with batches of three changes each, at three paths; some with each fault.
_CHANGES = """
b_change AS (SELECT concat('r', CAST(seq % 6 AS string)) AS repo, seq // 18 + 1 AS number, seq AS idx, CASE seq // 18 % 9 WHEN 0 THEN 'other' WHEN 1 THEN 'agent' WHEN 2 THEN 'editor' ELSE 'watcher_fallback' END AS source, CASE WHEN seq % 197 = 0 THEN 'touch' WHEN seq % 13 = 0 THEN 'delete' WHEN seq % 13 < 3 THEN 'rename' WHEN seq % 13 < 7 THEN 'create' ELSE 'upsert' END AS kind,
  CASE WHEN seq % 201 = 0 THEN '../x' ELSE concat('p', CAST(seq // 6 % 3 AS string), '-', path) END AS path, CASE WHEN seq % 53 = 0 THEN concat('p', CAST(seq // 6 % 3 AS string), '-', path) ELSE concat('old-', path) END AS old_path, CASE WHEN seq % 5 = 0 THEN 0 WHEN seq % 89 = 0 THEN -1 ELSE seq // 120 + version % 4 END AS version, concat('text ', CAST(seq AS string)) AS content, CASE WHEN seq % 189 = 0 THEN 'x' END AS content_id FROM v_change),
b_size AS (SELECT repo, number, count(*) AS size FROM b_change GROUP BY repo, number)"""


@query("atomic_batches", "v_change", f"""
WITH RECURSIVE {_CHANGES},
f AS (SELECT *, CASE WHEN source = 'other' THEN 'source' WHEN kind = 'touch' THEN 'kind' WHEN path = '../x' THEN 'path' WHEN kind = 'rename' AND path = old_path THEN 'rename' WHEN kind <> 'delete' AND content_id IS NOT NULL THEN 'content' END AS fault FROM b_change),
g AS (SELECT repo, number, list({{'idx': idx, 'path': path, 'kind': kind, 'version': version, 'watch': source = 'watcher_fallback'}} ORDER BY idx) AS all_, arg_min(fault, idx) FILTER (fault IS NOT NULL) AS fault FROM f GROUP BY 1, 2),
z AS (SELECT repo, 0::BIGINT AS number, MAP([]::VARCHAR[], []::BIGINT[]) AS now, NULL::VARCHAR AS reason, []::BIGINT[] AS found, []::BIGINT[] AS idxs FROM (SELECT DISTINCT repo FROM b_change) r
  UNION ALL SELECT repo, number, CASE WHEN reason IS NULL THEN map_concat(now, map_from_entries(list_transform(list_filter(done, lambda c: c.kind <> 'delete'), lambda c: {{'k': c.path, 'v': c.v}}))) ELSE now END, reason, list_transform(done, lambda c: CASE WHEN c.kind <> 'delete' THEN c.v END), list_transform(done, lambda c: c.idx)
  FROM (SELECT *, coalesce(fault, list_filter(list_transform(done, lambda c: CASE WHEN c.kind = 'delete' THEN NULL WHEN c.v < 1 THEN 'version' WHEN c.v <= c.cur THEN 'stale' END), lambda x: x IS NOT NULL)[1]) AS reason
    FROM (SELECT z.repo, g.number, z.now, g.fault, list_transform(g.all_, lambda c: {{'idx': c.idx, 'path': c.path, 'kind': c.kind, 'cur': coalesce(z.now[c.path], 0), 'v': CASE WHEN c.version = 0 AND c.watch THEN coalesce(z.now[c.path], 0) + 1 ELSE c.version END}}) AS done FROM z JOIN g ON g.repo = z.repo AND g.number = z.number + 1) q) w)
SELECT repo, number, unnest(idxs) AS idx, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL THEN unnest(found) END AS version FROM z WHERE number > 0""")
def atomic_batches(v):
    changes = v["v_change"].sparkSession.sql(f"WITH {_CHANGES.replace('//', 'div')} SELECT c.*, size FROM b_change c JOIN b_size USING (repo, number)")
    return B.atomic_batches(changes)
