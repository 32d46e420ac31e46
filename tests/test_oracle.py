"""Every registered query against its SQL twin on the smallest tables."""

import compare
import pytest

from tidemark.catalog import FLAGSHIP, ORACLE, QUERIES


def test_every_query_has_a_twin():
    assert set(ORACLE) == set(QUERIES)
    assert FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    _, problem = compare.difference(spark, con, sf, QUERIES[name], ORACLE[name])
    assert problem is None, problem
