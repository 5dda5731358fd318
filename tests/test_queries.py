import pytest

from hazardlens.queries import ORACLES, QUERIES
from tests.oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, SF, QUERIES[name], ORACLES[name]) == ""
