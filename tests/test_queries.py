"""Every registered query against its reference SQL, and what must never show up in a plan."""

import collections
import re

import pytest

from __spark_entry__ import entry
from conftest import SF
from workload.oracle import ORACLE
from workload.queries import QUERIES


def counted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck_tables, name):
    df = QUERIES[name](spark, SF)
    result = duck_tables.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert counted(df.columns, df.collect()) == counted(names, result.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|InPandas|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).count() == 10
