"""Every registered query of the subpackage against its SQL, where it has one."""

import pytest
from harness import compare, connect

from buildlore import llm

QUERIES, ORACLES = llm.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    problems, *_ = compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name])
    assert not problems


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
