"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from sensorframe.queries import ORACLES, QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, duck.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_registers_every_query():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
