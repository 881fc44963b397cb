"""Every registered query against its SQL on the smallest tables, with types and values."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402
from textvane.plans import catalog  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name not in catalog.oracle_sql():
        return
    cursor = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: check.TYPES.get(t, t) for c, t in df.dtypes} == types
    assert check.canonical(got, df.columns) == check.canonical(cursor.fetchall(), columns)
