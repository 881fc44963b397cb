"""Queries of the training-data operators beside their SQL, and what the registration promises."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

import check  # noqa: E402
from textvane.llm import queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_one_query_for_each_operator():
    assert [sum(name.startswith(f"op{n}_") for name in queries.QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(queries.SQL) <= set(queries.QUERIES) and "pipeline" in queries.QUERIES


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    cursor = check.connect(SF_DIR).execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert {c: check.TYPES.get(t, t) for c, t in df.dtypes} == {d[0]: str(d[1]) for d in cursor.description}
    assert check.canonical([tuple(r) for r in df.collect()], df.columns) == check.canonical(cursor.fetchall(), columns)
