"""Every registered query runs and agrees with its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from check_twins import compare, connect
from descria.workload import catalogue

SF = "/root/testdata/sf0.001"
TWINS = catalogue.twins()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["feature", "n_rows", "variance"] and df.count() > 0


def test_every_twin_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, con, name):
    verdict, _, _ = compare(spark, con, SF, entry_points.queries()[name], TWINS[name])
    assert verdict == "ok"


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(TWINS)))
def test_rows_only(spark, name):
    assert entry_points.queries()[name](spark, SF).count() > 0
