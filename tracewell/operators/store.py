"""Tables written to the shared folder, and passes over slices of a table that delete them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A pass takes about so many rows, or more if there would be more than so many passes.
MAX_ROWS, PASSES = 2_250_000, 16
#: Spark deletes the shuffle files of a command when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_pass: ContextVar[str | None] = ContextVar("_pass", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; on one machine (tests) a temporary one if it names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def save(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet to ``folder`` (else to the pass's, or the shared one) and read back; its shuffle files are deleted."""
    spark = df.sparkSession
    path = f"{folder or _pass.get() or shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Within it, ``save`` writes to a folder that is deleted at the end; gives the folder used outside it."""
    home = _pass.get() or shared_dir(spark)
    path = f"{shared_dir(spark)}/pass-{uuid.uuid4().hex}"
    token = _pass.set(path)
    try:
        yield home
    finally:
        _pass.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def passes(table: DataFrame, key: str, run: Callable[[DataFrame], DataFrame], size: int | None = None) -> DataFrame:
    """``run`` over ``table``, where its result is that of each key's rows by themselves.

    A large table is taken in slices of whole keys, one after another, so that
    the disk holds the shuffles and tables of one slice at a time, besides the
    results. ``size`` is the number of rows that ``run`` goes over, if not those
    of ``table``.
    """
    n = min(PASSES, -(-(table.count() if size is None else size) // MAX_ROWS))
    if n <= 1:
        return run(table)
    out = None
    for i in range(n):
        with scratch(table.sparkSession) as home:
            part = save(run(table.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)), home)
        out = part if out is None else out.union(part)
    return out
