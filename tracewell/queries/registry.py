"""Where queries register themselves with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.operators.store import passes
from tracewell.plans.views import load, with_views

#: Views that such a query uses often, behind a window over the whole table.
KEPT = ("v_step", "v_edge")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
IN_PASSES: set[str] = set()


def query(name: str, uses: str, oracle: str | None = None, by: str | None = None) -> Callable:
    """Registers a function of the tables and views in ``uses`` (given as a dict).

    ``by`` names a table and its column (``table.column``) whose values the
    result is made of one by one: a large table is taken in passes.
    """
    names = uses.split()

    def add(f: Callable[[dict[str, DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if by is None:
                return f(load(spark, sf_dir, names))
            table, column = by.split(".")
            large = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            return passes(large, column, lambda rows: f(load(spark, sf_dir, names, {table: rows}, KEPT)))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if by:
            IN_PASSES.add(name)
        if oracle:
            ORACLES[name] = with_views(names, oracle)
        return f

    return add
