"""Registered queries against their DuckDB oracle on the smallest test data.

The full set is checked at sf0.01 by ``tools/oracle_check.py``; here a
representative subset per family runs on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF0001
from tools.oracle_check import TABLES, rows_of

KEYS = ["q_dim_region_b", "q_dim_beneficiaire_a", "q_fait_operations_compat", "q_fait_activites_b",
        "q_measures_operations", "q_rollup_geography", "q_rule_violations", "q_cin_change_validation",
        "q_churn_features", "q_segment_features", "q_roc_points", "q_item_similarity", "q_recommend_labels",
        "q_balance_years", "q_assign_nearest", "q_catalog_counts", "q_stream_cin_validation", "q_score_check",
        "q_rec_matrix_shape"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    got = rows_of(E.queries()[key](spark, SF0001).toPandas())
    want = rows_of(con.execute(E.oracle_sql()[key]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "Total_Operations" in df.columns
