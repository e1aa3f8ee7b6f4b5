"""Every registered query against its SQL on the smallest tables; the ones without SQL have to run."""

import pytest
from harness import compare, connect

from buildlore import catalog
from buildlore.catalog.base import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, SF).limit(5).count() >= 0
        return
    problems, *_ = compare(spark, duck, SF, QUERIES[name], ORACLES[name])
    assert not problems
