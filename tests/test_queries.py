"""Every registered query against its SQL."""

import pytest

import ledgerline.queries as engine
from tests.oracle import connect, kinds, kinds_of_sql, rows_of, rows_of_sql

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    got = rows_of(df)
    if name not in engine.SQL:
        assert got[1]
        return
    want = rows_of_sql(duck, engine.SQL[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1]
    assert kinds(df) == kinds_of_sql(duck, engine.SQL[name])
