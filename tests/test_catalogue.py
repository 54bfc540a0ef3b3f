import pytest

from tests.compare import connect, differences
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Queries that are meant to give no rows on these tables.
EMPTY = {"scan_missing", "absent_all", "portfolio_trades"}
#: Held against plain Python in other tests.
ELSEWHERE = {"portfolio_equity", "portfolio_trades", "portfolio_clipped", "sharpe_grid", "backtest_summary", "file_inventory", "stream_ohlcv_1h", "stream_alert_lifecycle", "portfolio_strict"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_its_sql(spark, con, name):
    assert differences(catalogue.FOUND[name](spark, SF), con, catalogue.SQL[name]) == ""


def test_every_query_has_sql_or_another_test():
    assert set(catalogue.FOUND) - set(catalogue.SQL) == ELSEWHERE


@pytest.mark.parametrize("name", sorted(ELSEWHERE - EMPTY))
def test_gives_rows(spark, name):
    assert not catalogue.FOUND[name](spark, SF).isEmpty()
