"""Source anchors against documents: what they prove, and where their declarations are now.

Documents are (repo_id, snapshot_id, path, content, revision_id), anchors name
repo_id, snapshot_id and path; equal paths of other repositories or snapshots
are other documents. Offsets count bytes, ends are excluded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracewell.functions.text import line_at, path_policy, redact

KEY = ["repo_id", "snapshot_id", "path"]
# Declarations of a method before its name and behind it, as freshness looks for them.
METHOD, OPENS = r"^\s*(?:@\w+\s+)*[A-Za-z_][\w<>,\s?]*\s+", r"\s*\("
# Lines that declare a name, as moved anchors look for them: functions with a receiver first, then any kind of declaration.
FUNCTION = (r"^[ \t]*func[ \t]+(?:\([^)]+\)[ \t]+)?", r"\b")
DECLARED = (
    r"^[ \t]*(?:(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(?:def|func|function\*?|pub[ \t]+func|pub[ \t]+fn|class|type|interface|struct|enum)[ \t]+)?(?:(?:public|private|protected|static|readonly|get|set|override|final|late)[ \t]+)*(?:[A-Za-z0-9_<>, ?*\[\]]+[ \t]+)?",
    r"[ \t]*(?:\(|<|=|\{|:)",
)


def with_document(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """``anchors`` with the document's _body (bytes), _content and _revision; nulls where the snapshot has no such path."""
    body = docs.select(*KEY, F.encode("content", "UTF-8").alias("_body"), F.col("content").alias("_content"), F.col("revision_id").alias("_revision"))
    return anchors.join(body, KEY, "left")


def cut(body: Column, start: Column, end: Column) -> Column:
    """Bytes start:end; null where the range isn't one of ``body``."""
    return F.when((start >= 0) & (end >= start) & (end <= F.octet_length(body)), F.substring(body, start.cast("int") + 1, (end - start).cast("int")))


def last_name(symbol: Column) -> Column:
    return F.trim(F.element_at(F.split(F.coalesce(symbol, F.lit("")), r"\."), -1))


def check(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """``anchors`` (KEY, byte_start, byte_end, span_hash, symbol) with the reason why one is refused, null if it holds: path, range, span hash, and the symbol's last name in the text, in this order."""
    clean = path_policy(F.col("path"))
    rows = with_document(anchors.withColumn("_given", F.col("path")).withColumn("_clean", clean).withColumn("path", F.coalesce("_clean.path", "path")), docs)
    span = cut(F.col("_body"), F.col("byte_start"), F.col("byte_end"))
    name = F.when(last_name(F.col("symbol")) == "", F.col("symbol")).otherwise(last_name(F.col("symbol")))
    reason = (
        F.when(F.coalesce("_given", F.lit("")) == "", "file_not_found")
        .when(F.col("_clean.reason").isNotNull(), "path_traversal")
        .when(F.col("_body").isNull(), "file_not_found")
        .when(span.isNull(), "byte_range_out_of_bounds")
        .when(~F.sha2(span, 256).eqNullSafe(F.col("span_hash")), "span_hash_mismatch")
        .when((F.trim(F.coalesce("symbol", F.lit(""))) == "") | ~F.contains("_content", name), "enclosing_symbol_not_found")
    )
    return rows.withColumn("reason", reason).withColumn("path", F.col("_given")).drop("_given", "_clean", "_body", "_content", "_revision")


def records(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """``anchors`` (evidence_id, KEY, revision_id, file_hash, byte_start, byte_end, span_hash) with their evidence, or the reason why there is none.

    Empty hashes aren't compared. Evidence is line_start, line_end, snippet (its
    secrets redacted) and redaction (clean or redacted).
    """
    rows = with_document(anchors, docs)
    span = cut(F.col("_body"), F.col("byte_start"), F.col("byte_end"))
    given = lambda c: F.coalesce(F.col(c), F.lit(""))
    reason = (
        F.when(given("evidence_id") == "", "invalid_anchor")
        .when(path_policy(F.col("path"))["reason"].isNotNull(), "path_rejected")
        .when(F.col("_body").isNull(), "unknown_file")
        .when((given("revision_id") == "") | (given("revision_id") != F.col("_revision")), "unknown_revision")
        .when((given("file_hash") != "") & (given("file_hash") != F.sha2("_body", 256)), "unknown_revision")
        .when(span.isNull() | ~F.is_valid_utf8(span.cast("string")), "invalid_range")
        .when((given("span_hash") != "") & (given("span_hash") != F.sha2(span, 256)), "invalid_anchor")
    )
    rows = rows.withColumn("reason", reason).withColumn("_found", F.when(F.col("reason").isNull(), redact(span.cast("string"))))
    proved = F.col("reason").isNull()
    last = F.greatest(F.col("byte_start"), F.col("byte_end") - 1)
    rows = rows.withColumn("line_start", F.when(proved, line_at(F.col("_content"), F.col("byte_start")))).withColumn("line_end", F.when(proved, line_at(F.col("_content"), last)))
    return rows.withColumn("snippet", F.col("_found.text")).withColumn("redaction", F.col("_found.status")).drop("_found", "_body", "_content", "_revision")


def first_match(content: Column, name: Column, before: str, after: str) -> Column:
    r"""Characters before the first line that has ``name`` between two patterns; null if none has. ^ is the begin of a line that \n ends."""
    at = F.regexp_instr(content, F.concat(F.lit(f"(?dm){before}\\Q"), name, F.lit(f"\\E{after}")))
    return F.when((name != "") & (at > 0), at - 1)


def bytes_before(content: Column, characters: Column) -> Column:
    return F.octet_length(F.substring(content, F.lit(1), characters)).cast("long")


def reanchor(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """``anchors`` (KEY, byte_start, byte_end, file_hash, span_hash, symbol) with status and where they are now: new_start, new_end, new_span_hash, new_file_hash.

    verified: the file or the span is unchanged. adjusted: the line that
    declares the symbol's last name, to its end. Else, and without a document,
    unknown_boundary, with the anchor as it was.
    """
    rows = with_document(anchors, docs)
    name = last_name(F.element_at(F.split(F.coalesce("symbol", F.lit("")), "#"), -1))
    at = F.coalesce(first_match(F.col("_content"), name, *FUNCTION), first_match(F.col("_content"), name, *DECLARED))
    same = (F.coalesce("file_hash", F.lit("")) == F.sha2("_body", 256)) | F.coalesce(F.sha2(cut(F.col("_body"), F.col("byte_start"), F.col("byte_end")), 256) == F.col("span_hash"), F.lit(False))
    status = F.when(F.col("_body").isNull(), "unknown_boundary").when(same, "verified").when(F.col("_at").isNotNull(), "adjusted").otherwise("unknown_boundary")
    rows = rows.withColumn("_at", at).withColumn("status", status)
    line = F.when(F.col("status") == "adjusted", F.substring_index(F.substring("_content", F.col("_at") + 1, F.length("_content")), "\n", 1))
    start = F.when(F.col("status") == "adjusted", bytes_before(F.col("_content"), F.col("_at")))
    rows = rows.withColumn("_line", line).withColumn("_start", start)
    new = {"new_start": F.coalesce("_start", "byte_start"), "new_end": F.coalesce(F.col("_start") + F.octet_length("_line"), "byte_end"), "new_span_hash": F.coalesce(F.sha2("_line", 256), "span_hash"), "new_file_hash": F.when(F.col("status") == "adjusted", F.sha2("_body", 256)).otherwise(F.col("file_hash"))}
    return rows.withColumns(new).drop("_body", "_content", "_revision", "_at", "_line", "_start")


def balanced_end(data: bytes, start: int = 0) -> int | None:
    """The end of the braces that open first after ``start``; null if they don't close."""
    part = np.frombuffer(data, np.uint8)[start:]
    depth = np.cumsum((part == 123).astype(np.int64) - (part == 125))
    ends = np.flatnonzero((part == 125) & (depth <= 0))
    return start + int(ends[0]) + 1 if len(ends) and depth[ends[0]] == 0 else None


@F.pandas_udf(LongType())
def closing(tails: pd.Series) -> pd.Series:
    """Bytes of each text from its begin to the end of its first braces; null without such."""
    found = []
    for tail in tails:
        data = (tail or "").encode()
        found.append(balanced_end(data, data.find(b"{")) if b"{" in data else None)
    return pd.Series(found, dtype="Int64")


def declared(rows: DataFrame, name: Column) -> DataFrame:
    """``rows`` (_content) with decl_start, decl_end and decl_hash of the method ``name``, through its balanced braces; nulls where it isn't declared so."""
    rows = rows.withColumn("_at", first_match(F.col("_content"), name, METHOD, OPENS))
    rows = rows.withColumn("_tail", F.when(F.col("_at").isNotNull(), F.substring("_content", F.col("_at") + 1, F.length("_content")))).withColumn("_size", closing(F.col("_tail")))
    span = F.substring(F.encode("_tail", "UTF-8"), F.lit(1), F.col("_size").cast("int"))
    start = bytes_before(F.col("_content"), F.col("_at"))
    return rows.withColumn("decl_start", F.when(F.col("_size").isNotNull(), start)).withColumn("decl_end", start + F.col("_size")).withColumn("decl_hash", F.when(F.col("_size").isNotNull(), F.sha2(span, 256))).drop("_tail", "_size")


def freshness(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """``anchors`` (KEY, byte_start, byte_end, file_hash, span_hash, symbol) with freshness and, where their declaration stands elsewhere, its place: moved_path, moved_start, moved_end.

    fresh: the file, the span, or the declaration of the symbol's last name,
    wherever it is in the document now, is unchanged. stale: it is declared,
    but otherwise, or the symbol has no name. orphaned: no document, or no
    declaration. A declaration of that name and hash in another document of
    the snapshot is the place to which a stale or orphaned anchor has moved;
    the least path counts. Documents are found by the names they declare.
    """
    keyed = anchors.withColumn("_id", F.xxhash64(*anchors.columns))
    name = last_name(F.col("symbol"))
    rows = declared(with_document(keyed, docs), name)
    same = (F.sha2("_body", 256) == F.col("file_hash")) | (F.sha2(cut(F.col("_body"), F.col("byte_start"), F.col("byte_end")), 256) == F.col("span_hash"))
    state = (
        F.when(F.col("_body").isNull(), "orphaned")
        .when(F.coalesce(same, F.lit(False)), "fresh")
        .when(name == "", "stale")
        .when(F.col("_at").isNull(), "orphaned")
        .when(F.col("decl_hash") == F.col("span_hash"), "fresh")
        .otherwise("stale")
    )
    relinked = (F.col("freshness") == "fresh") & ~F.coalesce(same, F.lit(False))
    rows = rows.withColumn("freshness", state).withColumn("_here", F.when(relinked, F.struct("path", F.col("decl_start").alias("start"), F.col("decl_end").alias("end"))))
    rows = rows.select(*keyed.columns, "freshness", "_here")

    lost = rows.filter("freshness <> 'fresh'").withColumn("name", name).filter("name <> ''").select("repo_id", "snapshot_id", "name", "span_hash", F.col("path").alias("_from")).distinct()
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(f"(?dm){METHOD}([A-Za-z_$][\\w$]*){OPENS}"), F.lit(1)))
    index = docs.select(*KEY, F.explode(names).alias("name")).join(lost.select("repo_id", "snapshot_id", "name").distinct(), ["repo_id", "snapshot_id", "name"])
    index = declared(index.join(docs.select(*KEY, F.col("content").alias("_content")), KEY), F.col("name")).filter("decl_hash is not null")
    index = index.select("repo_id", "snapshot_id", "name", F.col("decl_hash").alias("span_hash"), F.struct("path", F.col("decl_start").alias("start"), F.col("decl_end").alias("end")).alias("_there"))
    moved = lost.join(index, ["repo_id", "snapshot_id", "name", "span_hash"]).filter("_there.path <> _from").groupBy("repo_id", "snapshot_id", "name", "span_hash", "_from").agg(F.min("_there").alias("_there"))
    moved = moved.withColumnRenamed("_from", "path")
    out = rows.withColumn("name", name).join(moved, ["repo_id", "snapshot_id", "name", "span_hash", "path"], "left")
    place = F.when(F.col("freshness") == "fresh", F.col("_here")).otherwise(F.col("_there"))
    return out.select(*anchors.columns, "freshness", place["path"].alias("moved_path"), place["start"].alias("moved_start"), place["end"].alias("moved_end"))


def snapshot_faults(docs: DataFrame) -> DataFrame:
    """(repo_id, snapshot_id, path, reason) of documents that no evidence may come from: a refused or repeated path, no identity, a version below 1, another length or content than recorded.

    docs have content_id, version and byte_length.
    """
    times = F.count("*").over(Window.partitionBy(*KEY))
    reason = (
        F.when(path_policy(F.col("path"))["reason"].isNotNull(), "path_invalid")
        .when(times > 1, "path_repeated")
        .when((F.coalesce("revision_id", F.lit("")) == "") | (F.coalesce("content_id", F.lit("")) == ""), "identity_incomplete")
        .when(F.coalesce("version", F.lit(0)) < 1, "version_invalid")
        .when(~F.col("byte_length").eqNullSafe(F.octet_length("content").cast("long")), "length_mismatch")
        .when(F.sha2("content", 256) != F.col("content_id"), "content_mismatch")
    )
    return docs.withColumn("reason", reason).filter("reason is not null").select(*KEY, "reason")


def brace_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end): the balanced braces after byte ``start``; null if they don't close."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = [balanced_end((text or "").encode(), start) for text, start in zip(batch["content"], batch["start"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "start": batch["start"], "end": pd.array(ends, dtype="Int64")})

    return docs.select("doc_id", "content", "start").mapInPandas(run, "doc_id long, start long, end long")
