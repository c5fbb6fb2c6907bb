import pytest

import __spark_entry__ as entry_points
from workloads.check import compare
from workloads.oracles import ORACLES
from workloads.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_equivalent():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 50


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches(spark, name):
    assert compare(spark, SF, name).startswith("ok")
