"""Registered queries against their SQL twins, and the expected sizes of the fleet."""

import pytest

import __spark_entry__ as entry
from aerostrata.plans import catalog, fleet
from tests.compare import compare, connect

SMALL = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, entry.queries()[name], SQL[name], SMALL) is None


def test_every_sql_text_has_a_query():
    assert set(SQL) <= set(entry.queries())


# Observations, metrics, batches, kept batches.
@pytest.mark.parametrize("sf, want", [("0.001", (1000, 964, 103, 80)), ("0.01", (10000, 9640, 1004, 968))])
def test_sizes(spark, sf, want):
    folder = f"/root/testdata/sf{sf}"
    obs = catalog.observations(spark, folder)
    assert (obs.count(), fleet.runtime_metrics(obs).count(), obs.select("batch_id").distinct().count(),
            catalog.kept_features(spark, folder).count()) == want


def test_entry(spark):
    row = entry.entry(spark).selectExpr("count(1)", "sum(health_risk)", "sum(anomaly)").first()
    assert tuple(row) == (80, 3, 76)
