"""Every query beside its SQL on the smallest test tables."""

import os
import sys

import pytest

import __spark_entry__ as spark_entry

sys.path.insert(0, os.path.join(os.path.dirname(spark_entry.__file__), "tools"))
from check import compare, tables  # noqa: E402

ORACLES = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    return tables(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, sf_dir, name):
    verdict, _, _, n = compare(spark, db, sf_dir, name, ORACLES[name])
    assert verdict == "ok" and n > 0


def test_entry(spark):
    result = spark_entry.entry(spark)
    assert result.columns == ["comment_id", "voted"]
    assert result.count() > 0
