"""Every query against its SQL in DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as contract
from compare import connect, differences
from moltabula.plans.table_queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ROWS_ONLY = {"knn_lsh", "knn_descent", "knn_descent_recall", "train_incremental", "linear_probe", "train_mlp"}
# compared with plain computations in test_model_outputs.py, test_corrected.py and test_layout.py
OUTPUTS = {"linear_weights", "linear_scores", "coordinates_2d", "mlp_epochs", "corrected_weights", "corrected_scores", "graph_layout"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OUTPUTS))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    if name in ROWS_ONLY:
        rows = df.collect()  # every column is computed, which a count would not do
        assert rows and df.columns
    else:
        assert differences(df, duck.sql(contract.oracle_sql()[name])) is None


def test_every_query_has_sql_or_is_known():
    assert set(QUERIES) - set(contract.oracle_sql()) == ROWS_ONLY | OUTPUTS
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    row = contract.entry(spark).first()
    assert 0 <= row["acc"] <= 1 and row["n_rows"] > 0
