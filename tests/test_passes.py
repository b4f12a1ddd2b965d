"""Queries over flows in passes, as large tables are taken, against their SQL."""

import duckdb
import pytest
from test_queries import plain

from tracewell.operators import store
from tracewell.plans.views import TABLES
from tracewell.queries import ORACLES, QUERIES
from tracewell.queries.registry import IN_PASSES


@pytest.mark.parametrize("name", sorted(IN_PASSES))
def test_passes(spark, sf_dir, tmp_path, monkeypatch, name):
    monkeypatch.setattr(store, "MAX_ROWS", 100)
    monkeypatch.setattr(store, "PASSES", 2)
    monkeypatch.setattr(store, "shared_dir", lambda _: str(tmp_path))
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = QUERIES[name](spark, sf_dir)
    left = sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    assert left == ["table", "table"], "only the results of the passes stay"
    columns = sorted(out.columns)
    rows = sorted((tuple(map(plain, r)) for r in out.select(columns).collect()), key=repr)
    found = duck.execute(ORACLES[name])
    at = [[c[0] for c in found.description].index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
