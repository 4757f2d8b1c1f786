"""Every registered plan against its SQL; those without give rows."""

import pytest

from evigraph.plans import PLANS, SQL, runner
from oracle import assert_same, connect

@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, con, name):
    """Queries without a row at the smallest scale are compared at the next."""
    if not assert_same(runner(PLANS[name])(spark, data), con, SQL[name]):
        larger = data.replace("sf0.001", "sf0.01")
        assert assert_same(runner(PLANS[name])(spark, larger), connect(larger), SQL[name])


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_rows(spark, data, name):
    assert runner(PLANS[name])(spark, data).count() > 0
