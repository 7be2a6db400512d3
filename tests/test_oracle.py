"""Every registered query with an oracle must agree with it; the others must give rows."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entrypoint
from oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entrypoint.queries()
ORACLES = entrypoint.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert compare(rows, df.columns, cur.fetchall(), cols) is None


def test_names_are_registered_once_and_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entrypoint.entry(spark).count() > 0
