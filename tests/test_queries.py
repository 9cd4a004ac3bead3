"""Every registered query with SQL gives the same rows in both engines; the others run."""

import pytest

from textloom.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
SLOW = {"q_ensemble_scores", "q_calibrators", "q_detector_inference"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, same_rows):
    same_rows(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0
