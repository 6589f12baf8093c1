"""Every query against its SQL, at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

from duotick.plans import catalog

from .conftest import SF

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "smallint": "SMALLINT", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    df = df.select(*columns)
    want = db.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({catalog.SQL[name]})")
    assert [TYPES[t] for _, t in df.dtypes] == [str(t) for t in want.types]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", ["hold", "change_only", "runs", "superseded", "timer_state", "asof_state", "deferred_start", "continuous_position", "rolling_buffer", "event_order", "tick_number", "gaps", "rule_violations", "active_ticks", "tick_pipeline"])
def test_short_stretches_give_the_same(spark, db, monkeypatch, name):
    monkeypatch.setattr(catalog, "SPAN", 100)
    monkeypatch.setattr(catalog, "DAYS", 30)
    test_equals_sql(spark, db, name)


def test_no_nested_loops_and_no_python(spark):
    for name, query in catalog.QUERIES.items():
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name
        assert "CartesianProduct" not in plan, name
        if name not in ("tune_constants", "scaled_share", "target_fanout"):  # each joins a single row
            assert "NestedLoop" not in plan, name
