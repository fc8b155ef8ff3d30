"""Every registered query against its SQL twin on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import compare, connect  # noqa: E402
from plantmon.queries import QUERIES  # noqa: E402

RUNS, SQL = entry.queries(), entry.oracle_sql()
# The corpus operators have their own tests and may be absent.
OWN = sorted(set(RUNS) & set(QUERIES))


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, sf, name):
    text, _, ok = compare(spark, duck, sf, name, RUNS[name], SQL.get(name))
    assert ok, text


def test_flagship_known_answer(spark):
    row = RUNS["flagship_detection"](spark, "/root/testdata/sf0.01").first()
    assert (row.false_alarms, row.missed, row.normal_rows + row.fault_rows) == (366, 3765, 11960)
    assert row.threshold == pytest.approx(4.309449)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_queries_without_sql_are_few():
    assert sorted(set(OWN) - set(SQL)) == ["file_manifest"]
