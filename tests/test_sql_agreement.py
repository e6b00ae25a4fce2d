"""Every registered query against its SQL over whole tables."""

from __future__ import annotations

import os

import pytest

from checks.compare import connect, differences
from checks.oracles import oracle_sql
from checks.queries import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_agrees_with_sql(spark, connection, name):
    assert differences(spark, connection, name, FOLDER) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 7
