"""Every registered query against its SQL twin, on whole tables."""

import pytest

import __spark_entry__ as entry
from featloom.plans.registry import TESTED_BY
from tools.check_oracle import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, sf_dir):
    ok, note, _ = compare(spark, con, QUERIES[name], ORACLES.get(name), sf_dir, TESTED_BY.get(name))
    assert ok, note


def test_entry(spark):
    report = entry.entry(spark)
    assert report.count() == 24
    assert set(ORACLES) <= set(QUERIES)
