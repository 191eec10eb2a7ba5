"""Registered queries against their DuckDB oracles, and the entry contract."""

import pytest

import __spark_entry__ as E
from compare import compare

from conftest import SF_ORACLE, SF_SMALL

# a bagged forest is beyond SQL: its rows, labels and importance sum have oracles of their
# own, and a forest without chance has one for all it says
SLOW = {"rf_predictions", "rf_importance", "rf_accuracy"}


def _optional(name):
    """Queries of the optional training-data part have tests of their own."""
    return name == "pipeline" or (name.startswith("op") and name[2:3].isdigit())


def test_every_query_but_rows_only_ones_has_an_oracle():
    missing = {n for n in set(E.queries()) - set(E.oracle_sql()) if not _optional(n)}
    assert missing <= SLOW


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if not _optional(n)))
def test_query_matches_oracle(spark, name):
    ok, msg = compare(spark, name, SF_ORACLE, E.queries()[name], E.oracle_sql()[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.schema == E.entry(spark).schema


@pytest.mark.parametrize("name", sorted(SLOW))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF_SMALL).count() > 0


@pytest.mark.parametrize("name", ["enriched", "csv_roundtrip"])
def test_results_do_not_depend_on_session_zone(spark, name):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        ok, msg = compare(spark, name, SF_ORACLE, E.queries()[name], E.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert ok, msg
