"""Every query of the catalog gives the rows of its SQL; the entry point works."""

import duckdb
import pytest

from fathom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted([tuple(None if v != v else v for v in r) for r in frame[columns].astype(object).itertuples(index=False)], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, db, name):
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.ORACLE[name]).df()
    for frame in (a, b):
        for c in frame.columns:
            if str(frame[c].dtype).startswith("datetime"):
                frame[c] = frame[c].astype(str)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_stay_declarative(spark):
    """No Python in layered searches, no product over snapshots; filters and columns reach the scan."""
    show = lambda name: catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in show("cycles_layered_d3") and "Python" not in show("backtest_per_ts")
    assert "Cartesian" not in show("panel_edges")
    events = catalog.M.ticks(spark, SF).where("event_id > 5")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,5)" in events and "props" not in events
