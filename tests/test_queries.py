"""Every registered query against its DuckDB twin on the smallest tables
(the driver runs the same comparison at sf0.01)."""
import duckdb
import pytest

import __spark_entry__ as E
from authornet.plans import catalog
from authornet.sources.tables import TABLES
from tools.check_oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


# Queries without a twin and the test that checks their values instead.
VALUE_TESTS = {
    "c5_neighbour_layout": "test_layout.py::test_layout_keeps_neighbours_better_than_principal_components",
    "c5_project_2d": "test_stats.py::test_projection_keeps_the_largest_variances",
    "d8_fit_multinomial": "test_stats.py::test_multinomial_matches_balanced_objective",
    "d9_predict_cluster": "test_analysis.py::test_predictions_are_the_softmax_of_the_fit",
    "d13_cluster_report": "test_analysis.py::test_report_recounts_the_predictions",
    "n13_trained_authors": "test_fit.py::test_clusters_of_a_fitted_encoder",
    "n15_fit_encoder": "test_fit.py::test_fit_on_the_author_graph_lowers_the_loss",
    "n16_random_search": "test_fit.py::test_search_logs_one_row_per_trial_and_epoch",
    "n17_gradient_statistics": "test_fit.py::test_gradients_equal_finite_differences",
    "d9_predict": "test_stats.py::test_multinomial_matches_balanced_objective",
}
# Queries that the driver contract registers from another folder have their tests there.
OWN = [n for n in catalog.QUERIES]


@pytest.mark.parametrize("name", OWN)
def test_query_matches_oracle(spark, con, name):
    line = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert not line.startswith(("BAD", "ERR")), line
    assert line.startswith("OK") or name in VALUE_TESTS, f"{name} has neither a twin nor a value test"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "author" in df.columns
