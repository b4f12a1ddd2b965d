"""Queries over anchors, evidence and moved declarations.

Each document stands for a source file that declares one method, as it was
when it was anchored (o) and as it is in snapshot s now (c); snapshot t has
other contents under the same paths.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import anchors as A
from tracewell.queries.registry import query

_VIEWS = """
d AS (SELECT repo_id, path, doc_id, concat('// é日本 ', cast(doc_id AS string), ';', chr(10)) AS head, concat(chr(10), '// ', replace(coalesce(content, ''), 'load', '')) AS rest, concat('load', cast(doc_id AS string)) AS name,
  concat('Future<int> load', cast(doc_id AS string), '(int a) {', chr(10), '  x {', cast(doc_id % 100 AS string), '}', chr(10), '}') AS decl FROM v_doc),
f AS (SELECT repo_id, CASE WHEN doc_id % 9 = 0 THEN 't' ELSE 's' END AS snapshot_id, path, doc_id, name, decl, head, concat(head, decl, rest) AS o FROM d),
c AS (SELECT repo_id, 's' AS snapshot_id, path, doc_id, CASE doc_id % 8 WHEN 0 THEN concat(head, decl, rest) WHEN 1 THEN concat(head, decl, rest, ' tail') WHEN 2 THEN concat('// more é;', chr(10), head, decl, rest) WHEN 3 THEN concat('// more;', chr(10), head, replace(decl, 'x {', 'y {'), rest)
    WHEN 7 THEN CASE WHEN doc_id % 16 = 15 THEN concat(head, 'Future<int> ', name, '(int a) {', chr(10), '  {') ELSE concat(head, '// calls ', name, rest) END ELSE concat(head, substr(rest, 2)) END AS content FROM d WHERE doc_id % 8 <> 6
  UNION ALL SELECT repo_id, 's', concat('moved/', path), doc_id, concat('// z;', chr(10), decl) FROM d WHERE doc_id % 8 = 5
  UNION ALL SELECT repo_id, 't', path, doc_id, 'other' FROM d)"""
# What the anchors record: bytes of the declaration in the old file.
_ANCHORS = "strlen(head) AS a, strlen(head) + strlen(decl) AS b"
_JOINED = f"""{_VIEWS},
j AS (SELECT f.*, {_ANCHORS}, c.content AS now, encode(c.content) AS body, c.doc_id IS NOT NULL AS there FROM f LEFT JOIN c ON c.repo_id = f.repo_id AND c.snapshot_id = f.snapshot_id AND c.path = f.path),
k AS (SELECT *, coalesce(now = o OR (strlen(now) >= b AND array_slice(body, a + 1, b) = encode(decl)), false) AS same, coalesce(strpos(now, concat(chr(10), 'Future<int> ', name, '(')), 0) AS spot FROM j)"""


def _docs(v):
    spark = v["v_doc"].sparkSession
    return spark.sql(f"WITH {_VIEWS} SELECT repo_id, snapshot_id, path, content, concat('r', cast(doc_id AS string)) AS revision_id, doc_id FROM c")


def _anchors(v):
    rows = v["v_doc"].sparkSession.sql(f"WITH {_VIEWS} SELECT * FROM f")
    start = F.octet_length("head").cast("long")
    return rows.select("repo_id", "snapshot_id", "path", "doc_id", F.concat(F.lit("Svc."), "name").alias("symbol"), start.alias("byte_start"), (start + F.octet_length("decl")).alias("byte_end"), F.sha2("o", 256).alias("file_hash"), F.sha2("decl", 256).alias("span_hash"))


@query("declaration_freshness", "v_doc", f"""
WITH {_JOINED}
SELECT doc_id, CASE WHEN NOT there THEN 'orphaned' WHEN same THEN 'fresh' WHEN spot = 0 THEN 'orphaned' WHEN contains(now, decl) THEN 'fresh' ELSE 'stale' END AS freshness,
  CASE WHEN NOT same AND contains(now, decl) THEN k.path ELSE m.path END AS moved_path, CASE WHEN NOT same AND contains(now, decl) THEN strlen(left(now, spot)) WHEN m.path IS NOT NULL THEN 6 END AS moved_start,
  CASE WHEN NOT same AND contains(now, decl) THEN strlen(left(now, spot)) + strlen(decl) WHEN m.path IS NOT NULL THEN 6 + strlen(decl) END AS moved_end
FROM k LEFT JOIN (SELECT repo_id, snapshot_id, doc_id, path FROM c WHERE path LIKE 'moved/%') m USING (repo_id, snapshot_id, doc_id)""")
def declaration_freshness(v):
    """Unchanged, appended to, shifted, changed, deleted, moved to another file, without a file, and only mentioned or left open."""
    return A.freshness(_anchors(v), _docs(v)).select("doc_id", "freshness", "moved_path", "moved_start", "moved_end")


@query("reanchor_spans", "v_doc", f"""
WITH {_JOINED}
SELECT doc_id, CASE WHEN same THEN 'verified' WHEN spot > 0 THEN 'adjusted' ELSE 'unknown_boundary' END AS status, CASE WHEN NOT same AND spot > 0 THEN strlen(left(now, spot)) ELSE a END AS new_start, CASE WHEN NOT same AND spot > 0 THEN strlen(left(now, spot)) + strlen(concat('Future<int> ', name, '(int a) {{')) ELSE b END AS new_end,
  CASE WHEN NOT same AND spot > 0 THEN sha256(concat('Future<int> ', name, '(int a) {{')) ELSE sha256(decl) END AS new_span_hash, CASE WHEN NOT same AND spot > 0 THEN sha256(now) ELSE sha256(o) END AS new_file_hash FROM k""")
def reanchor_spans(v):
    return A.reanchor(_anchors(v), _docs(v)).select("doc_id", "status", "new_start", "new_end", "new_span_hash", "new_file_hash")


@query("anchor_rules", "v_doc", f"""
WITH {_JOINED}
SELECT doc_id, CASE WHEN doc_id % 17 = 1 THEN 'file_not_found' WHEN doc_id % 17 = 2 THEN 'path_traversal' WHEN NOT there THEN 'file_not_found' WHEN (doc_id % 17 = 3 AND strlen(now) < b + 100000000) OR strlen(now) < b THEN 'byte_range_out_of_bounds' WHEN array_slice(body, a + 1, b) <> encode(decl) THEN 'span_hash_mismatch'
  WHEN doc_id % 17 = 4 OR NOT contains(now, CASE WHEN doc_id % 17 = 5 THEN 'none' || doc_id ELSE name END) THEN 'enclosing_symbol_not_found' END AS reason FROM k""")
def anchor_rules(v):
    """Every fault of a path, range, hash and symbol; a path with ./ in front is the same file."""
    rows = _anchors(v).withColumn("path", F.expr("case doc_id % 17 when 1 then '' when 2 then concat('../', path) when 6 then concat('./', path) else path end")).withColumn("byte_end", F.expr("if(doc_id % 17 = 3, byte_end + 100000000, byte_end)"))
    rows = rows.withColumn("symbol", F.expr("case doc_id % 17 when 4 then ' ' when 5 then concat('Svc.none', doc_id) else symbol end"))
    return A.check(rows, _docs(v)).select("doc_id", "reason")


@query("evidence_records", "v_doc", f"""
WITH {_VIEWS},
j AS (SELECT c.*, c.doc_id % 11 AS m, strlen(content) AS n FROM c WHERE snapshot_id = 's' AND path NOT LIKE 'moved/%'),
k AS (SELECT *, CASE m WHEN 0 THEN 'invalid_anchor' WHEN 1 THEN 'path_rejected' WHEN 2 THEN 'unknown_file' WHEN 3 THEN 'unknown_revision' WHEN 4 THEN 'unknown_revision' WHEN 5 THEN 'invalid_range' WHEN 6 THEN CASE WHEN doc_id % 8 IN (2, 3) THEN 'invalid_anchor' ELSE 'invalid_range' END WHEN 7 THEN 'invalid_anchor' END AS reason FROM j)
SELECT doc_id, reason, CASE WHEN reason IS NULL THEN 1 END AS line_start, CASE WHEN reason IS NULL THEN 1 + length(content) - length(replace(content, chr(10), '')) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS line_end, CASE WHEN reason IS NULL THEN CASE WHEN m = 8 THEN concat('token = [REDACTED]', chr(10), '{{') ELSE '' END END AS secret, CASE WHEN reason IS NULL THEN CASE WHEN m = 8 THEN 'redacted' ELSE 'clean' END END AS redaction FROM k WHERE m <> 9 AND m <> 10
UNION ALL SELECT doc_id, NULL, 1, 1, CASE WHEN doc_id % 8 IN (2, 3) THEN '// more' ELSE '// é日本'  END, 'clean' FROM k WHERE m IN (9, 10)""".replace("{{", "{"))
def evidence_records(v):
    """Anchors of whole files and heads: without an id, with a refused path, a path, revision or hash that isn't the snapshot's, a range beyond the end or through a character, another span; the rest is evidence."""
    docs = _docs(v).filter("snapshot_id = 's' and path not like 'moved/%'")
    secret = F.concat(F.lit("token = 0123456789abcdef0123456789abcdef\n{"))
    docs = docs.withColumn("content", F.when(F.expr("doc_id % 11 = 8"), F.concat(secret, F.regexp_replace("content", r"[^\n]", ""))).otherwise(F.col("content")))
    m = F.expr("doc_id % 11")
    size = F.octet_length("content").cast("long")
    head = F.octet_length(F.when(F.expr("doc_id % 8 in (2, 3)"), "// more").otherwise("// é日本")).cast("long")
    anchors = docs.select(
        "repo_id", "snapshot_id", "doc_id", F.when(m == 0, "").otherwise("e").alias("evidence_id"), F.when(m == 1, "/abs").when(m == 2, F.concat(F.lit("no/"), "path")).otherwise(F.col("path")).alias("path"), F.when(m == 3, "x").otherwise(F.col("revision_id")).alias("revision_id"), F.when(m == 4, "x").otherwise(F.sha2("content", 256)).alias("file_hash"),
        F.lit(0).cast("long").alias("byte_start"), F.when(m == 5, size + 1).when(m == 6, F.lit(4)).when(m > 8, head).otherwise(size).cast("long").alias("byte_end"), F.when(m.isin(6, 7), "x").otherwise("").alias("span_hash"),
    )
    out = A.records(anchors, docs)
    text = F.when(m == 8, F.regexp_extract("snippet", r"^[^\n]*\n\{", 0)).when(m > 8, F.col("snippet")).otherwise("")
    return out.select("doc_id", "reason", "line_start", "line_end", F.when(F.col("reason").isNull(), text).alias("secret"), "redaction")
