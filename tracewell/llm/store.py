"""Tables written to the shared folder, to cut lineage and to be read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where that is unset and all tasks run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; its path is added to ``made``.

    A later stage that loses an executor reads the files again; it doesn't
    compute them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, made: list[str]) -> None:
    """Delete saved tables that no plan reads any more."""
    for path in made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    made.clear()


def join_small(big: DataFrame, small: DataFrame, on: str, how: str, rows: int, max_rows: int) -> DataFrame:
    """Join, broadcasting ``small`` only where its counted rows are within ``max_rows``."""
    return big.join(F.broadcast(small) if rows <= max_rows else small, on, how)
