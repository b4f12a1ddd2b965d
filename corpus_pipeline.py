"""A corpus pipeline: each stage applies one operator to all its predecessor kept.

All stages but the last return the columns of ``documents`` (and any others
that came with them); a stage that changes texts sets n_chars again and drops
what is left without a word, null and empty texts with it. Empty tables give
empty results. Ties, repeated rows and null ids are as the operators state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import line_crf, line_dedup, ngram_join, packing, substring_dedup
from tracewell.llm.queries import table, tokenizer
from tracewell.llm.store import save

#: Up to so many ids (8 bytes each) are broadcast; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000


def _with_text(out: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The rows of ``out`` with new texts, without those that have no word left."""
    fields = {c: F.col(f"row.{c}") for c in docs.columns}
    fields["text"] = text
    if "n_chars" in fields:
        fields["n_chars"] = F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    rows = out.filter(F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return rows.select(*(x.alias(c) for c, x in fields.items()))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; texts without a word are among them, repeated rows are judged alike."""
    crf = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    return line_crf.score(docs, crf).filter("predicted = 1").select("row.*")


def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common lines go from the later document."""
    return _with_text(line_dedup.remove_lines(docs), docs, F.col("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays.

    Rows of one id are one document: they stay or go together. Rows without an
    id and texts without a word stay.
    """
    gone = save(ngram_join.near_duplicates(docs).filter("component_id < doc_id").select("doc_id").distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_ROWS else gone
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def substring_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; a text from which none goes is unchanged."""
    out = substring_dedup.remove_repeats(docs)
    return _with_text(out, docs, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


#: Name and function of each stage, in order.
STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup_),
    ("packing", pack),
]

#: None: the classifier is learned and the packing goes by hashes; the tests have brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
