"""Every registered query against its SQL on another engine."""

from __future__ import annotations

import pytest
from conftest import SF_DIR, plan

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import differences, duck_connection

SQL = oracle_sql()
# Those of the optional subpackage have their own tests.
QUERIES = {k: q for k, q in queries().items() if q.__module__.split(".")[:2] != ["hirelens", "llm"]}


@pytest.fixture(scope="module")
def duck():
    pytest.importorskip("duckdb")
    return duck_connection(SF_DIR)


def test_all_have_both_sides():
    assert QUERIES.keys() <= SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, duck, name):
    assert differences(spark, duck, SF_DIR, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", ["positioning_labels_dollar", "table_top_competitive"])
def test_postings_of_several_scans_are_derived_once(spark, name):
    found = plan(QUERIES[name](spark, SF_DIR))
    assert "lineitem.parquet" not in found and "postings-" in found


def test_entry(spark):
    assert entry(spark).count() > 0
