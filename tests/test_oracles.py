import pytest

from tessera.catalog import ORACLES, QUERIES, flagship
from tests.oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    check(spark, SF, QUERIES[name], ORACLES[name])


def test_flagship(spark):
    assert flagship(spark, SF).count() == 1
