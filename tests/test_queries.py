"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest

from tests.conftest import SF
from tests.oracle import assert_equal, connect
from tidemark.plans import audit, ledger, live, market, setups, stores

ALL = {name: (f, plan.ORACLE_SQL[name]) for plan in (market, setups, ledger, audit, live, stores) for name, f in plan.QUERIES.items() if name in plan.ORACLE_SQL}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ALL)
def test_query(spark, con, name):
    assert_equal(spark, con, SF, *ALL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
