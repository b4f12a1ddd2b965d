"""Document tables: scans, snapshots, content stores and generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import ids
from tracewell.functions.text import is_source, path_policy, redact


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files under a folder, read by Spark as whole texts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(F.regexp_replace("path", r"^[a-z0-9]+:/*", "").alias("path"), F.decode("content", "UTF-8").alias("content"))


def scan(docs: DataFrame, prefix: str) -> DataFrame:
    """Documents under ``prefix`` in each repository; all of a repository that has none there. Unsafe paths are left out."""
    docs = docs.filter(path_policy(F.col("path"))["reason"].isNull())
    under = F.col("path").startswith(prefix)
    some = docs.groupBy("repo_id").agg(F.max(under).alias("some"))
    return docs.join(some, "repo_id").filter(under | ~F.col("some")).drop("some")


def source_files(docs: DataFrame) -> DataFrame:
    return docs.filter(is_source(F.col("path")))


def tracked(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """Documents whose (repo_id, path) is tracked; all of a repository without tracked paths."""
    sets = paths.select("repo_id").distinct()
    return docs.join(paths.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi").unionByName(docs.join(sets, "repo_id", "left_anti").select(docs.columns))


def snapshot(docs: DataFrame, before: DataFrame) -> DataFrame:
    """(repo_id, path, content_id, version, revision_id, reused): an unchanged file keeps its version, a changed one gets the next."""
    now = docs.select("repo_id", "path", F.sha2("content", 256).alias("content_id"))
    old = before.select("repo_id", "path", F.col("content_id").alias("old_id"), F.col("version").alias("old_version"))
    out = now.join(old, ["repo_id", "path"], "left").withColumn("reused", F.col("content_id").eqNullSafe(F.col("old_id")))
    out = out.withColumn("version", F.when(F.col("reused"), F.col("old_version")).otherwise(F.coalesce("old_version", F.lit(0)) + 1).cast("long"))
    return out.select("repo_id", "path", "content_id", "version", ids.short_id("rev", F.col("repo_id"), F.col("path"), F.col("version"), F.col("content_id")).alias("revision_id"), "reused")


def overlay(scanned: DataFrame, prior: DataFrame, removed: DataFrame) -> DataFrame:
    """The scan, and prior entries that it doesn't have and nobody removed."""
    kept = prior.join(scanned, ["repo_id", "path"], "left_anti").join(removed, ["repo_id", "path"], "left_anti")
    return scanned.select(prior.columns).unionByName(kept)


def new_contents(docs: DataFrame, store: DataFrame) -> DataFrame:
    """(content_id, content): each distinct content that the store lacks, once."""
    found = docs.select(F.sha2("content", 256).alias("content_id"), "content")
    return found.dropDuplicates(["content_id"]).join(store.select("content_id"), "content_id", "left_anti")


def orphans(store: DataFrame, *references: DataFrame) -> DataFrame:
    """content_ids of the store to which nothing refers."""
    used = references[0].select("content_id")
    for r in references[1:]:
        used = used.union(r.select("content_id"))
    return store.select("content_id").join(used.distinct(), "content_id", "left_anti")


def append_ledger(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of a JSON-lines ledger in time order; blank lines are skipped."""
    return spark.read.schema(schema).json(path).orderBy("ts", "seq")


def commit_generation(flows: DataFrame, root: str, generation: str) -> None:
    """Writes a generation and then, as the commit marker, the pointer; a failed write stays invisible."""
    spark = flows.sparkSession
    flows.write.mode("overwrite").parquet(f"{root}/generations/{generation}")
    spark.createDataFrame([(generation,)], "generation_id string").coalesce(1).write.mode("overwrite").parquet(f"{root}/pointer")


def active(flows: DataFrame, pointer: DataFrame) -> DataFrame:
    """Flows of the generation to which each repository's pointer points."""
    return flows.join(pointer.select("repo_id", "generation_id"), ["repo_id", "generation_id"])


def carry_forward(old: DataFrame, new: DataFrame, key: str = "flow_id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(old.columns))


def publish_select(candidates: DataFrame, n: int) -> DataFrame:
    """Of each repository (repo_id) the first n to publish: pinned ones, then roots that aren't use-case calls, by score."""
    pinned = F.col("override").eqNullSafe("pinned")
    fit = candidates.filter(pinned | (F.col("deduped_into").isNull() & (F.col("trigger_class") != "use_case_invocation")))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(pinned.desc(), F.col("score").desc(), "entry_symbol_path"))
    return fit.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def _view_id(columns: list[str]) -> Column:
    return F.concat(F.lit("view-"), F.sha2(F.concat_ws(ids.NUL, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(columns)]), 256))


def view_rows(docs: DataFrame, *volatile: str) -> DataFrame:
    """Rows with view_id, the hash of their stable columns in order of name; secrets in text columns are redacted first."""
    clean = [redact(F.col(c)).getField("text").alias(c) if t == "string" else F.col(c) for c, t in docs.dtypes]
    return docs.select(*clean).withColumn("view_id", _view_id([c for c in docs.columns if c not in volatile]))


def view_check(views: DataFrame, *volatile: str) -> DataFrame:
    """``views`` (rows with view_id) with intact: whether the id is still that of the row."""
    return views.withColumn("intact", F.col("view_id").eqNullSafe(_view_id([c for c in views.columns if c not in ("view_id", *volatile)])))


def cache_split(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted`` with its cache key and whether the cache has it."""
    keyed = wanted.withColumn("cache_key", ids.sha256(F.col("file_hash"), F.col("candidate_id"), F.col("version"), F.col("options_hash")))
    have = cache.select("cache_key").distinct().withColumn("hit", F.lit(True))
    return keyed.join(have, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def manifest_lanes(rows: DataFrame) -> DataFrame:
    """(symbol, lane): the first lane of each symbol by row number."""
    w = Window.partitionBy("symbol").orderBy("row_no")
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").select("symbol", "lane")


def upsert(dim: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return dim.join(rows.select(key), key, "left_anti").unionByName(rows.select(dim.columns))


def contract_split(rows: DataFrame, schema: str, required: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """JSON rows (raw) with the first rule they break: malformed, missing:<field> or value:<field>; null if valid."""
    parsed = F.from_json("raw", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = rows.withColumn("json", parsed)
    reason = F.when(F.col("json").isNull() | F.col("json._bad").isNotNull(), "malformed")
    for c in required:
        reason = reason.when(F.col(f"json.{c}").isNull(), f"missing:{c}")
    for c, values in allowed.items():
        reason = reason.when(~F.col(f"json.{c}").cast("string").isin(values), f"value:{c}")
    return out.withColumn("reason", reason).drop("json")
