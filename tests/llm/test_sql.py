"""Queries of this package against their SQL on the larger small tables."""

import pytest

from plumbline.llm import oracles, queries
from tests.compare import connect, differences

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), oracles.ORACLES[name]) is None
