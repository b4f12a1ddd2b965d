"""Queries of the subpackage that SQL can express, against that SQL."""

import duckdb
import pytest

from tracewell.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = QUERIES[name](spark, sf_dir)
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(tuple(r) for r in out.select(names).collect()) == sorted(tuple(r) for r in found.fetchall())
