"""(a) Every registered query against its DuckDB oracle on sf0.001 (the driver
repeats this at sf0.01); queries without an oracle must run and keep a stable
schema."""

import pytest

from merchlens.plans import catalog
from scripts.compare import digest
from tests.conftest import SF_SMALL

QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    hs, ls = digest(rows, df.columns)
    hd, ld = digest(drows, dcols)
    assert hs == hd, (sorted(set(ls) - set(ld))[:3], sorted(set(ld) - set(ls))[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_runs_with_stable_schema(spark, name):
    a = QUERIES[name](spark, SF_SMALL)
    assert a.count() > 0
    b = QUERIES[name](spark, SF_SMALL)
    assert a.schema.simpleString() == b.schema.simpleString()


def test_every_query_has_oracle_or_is_declared_rows_only():
    assert set(QUERIES) - set(SQL) <= {"chunk_budget_compare"}
