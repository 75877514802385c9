import pytest

from hopscope.plans import catalogue

from .checking import DATA, engine, same

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return engine()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match_sql(spark, con, name):
    same(con, QUERIES[name](spark, str(DATA)), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).columns


def test_planted_clock_is_found(spark):
    """Each pair of points is 250 ms apart and drifts 5 ms in the month that the events span."""
    for r in QUERIES["clock_models"](spark, "/root/testdata/sf0.01").collect():
        assert r.reason is None and abs(r.drift - 2e-9) < 5e-10
        assert abs(r.offset_us - 250_000 - (r.epoch_us - 1704067200000000) * 2e-9) < 1500


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not set(catalogue.queries()) - set(entry.queries())
