"""Every query of the library's own operators, against its SQL where it has one."""

import pytest

from loomgrid.plans import registry
from tests.compare import connect, rows_of_spark, rows_of_sql

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = rows_of_spark(QUERIES[name](spark, FOLDER))
    if name in SQL:
        assert got == rows_of_sql(con, SQL[name])
    else:
        assert got[1]


def test_auto_forecaster_backtests_every_candidate(spark, monkeypatch):
    from loomgrid.operators import forecasting as X

    tried, backtest = [], X.backtest_all
    monkeypatch.setattr(X, "backtest_all", lambda df, p, folds, horizon, candidates: tried.append(backtest(df, p, folds, horizon, candidates)) or tried[-1])
    QUERIES["forecast_auto_forecaster"](spark, FOLDER)
    assert {r.model for r in tried[0].select("model").distinct().collect()} == {name for name, _ in X.CANDIDATES} and len(X.CANDIDATES) == 13


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
