"""Registered queries of this subpackage next to their SQL."""

import collections

import pytest

from postmill.llm.oracle import ORACLE
from postmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_its_sql(spark, duck_tables, name):
    result = duck_tables.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert collections.Counter(map(tuple, got.select(*names).collect())) == collections.Counter(result.fetchall())
