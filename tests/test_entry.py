import os

import pytest

from conftest import SMOKE


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["repo_id", "vuln_type", "severity", "n_findings", "sum_confidence"]
    assert len(rows) > 0


def test_registry_consistent():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from auditlens.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con


def _with_sql():
    from auditlens.plans import catalog
    return sorted(catalog.oracle_sql())


@pytest.mark.skipif(not os.path.exists(SMOKE), reason="test data absent")
@pytest.mark.parametrize("name", _with_sql())
def test_against_duckdb(spark, duck, name):
    """Every registered query of the reference's operators against its SQL."""
    import __spark_entry__ as E
    from oracle_check import rows_of
    df = E.queries()[name](spark, SMOKE)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, cur.fetchall())
