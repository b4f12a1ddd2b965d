"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.store import remove, save


def components(edges: DataFrame, made: list[str]) -> DataFrame:
    """(node, comp) for each end of an edge (a, b); comp is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then
    jumps to that label's own label; chains halve, stars end at once. Labels
    are written to the shared folder in every round; only a count of changed
    rows comes to the driver. No edges give no rows. The result's path is
    added to ``made``; the tables before it are deleted.
    """
    spark, old, now = edges.sparkSession, [], []
    both = save(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges", old)
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels", now)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        better = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("comp").alias("top"))
        moved = save(better.join(up, "low", "left").select("node", "comp", F.least("low", "top").alias("now")), "labels", now)
        remove(spark, [now.pop(0)])
        labels = moved.select("node", F.col("now").alias("comp"))
        if moved.filter("now < comp").isEmpty():
            remove(spark, old)
            made += now
            return labels
