"""Registered queries against their SQL oracles.

A representative part runs by default; PANELSCOPE_ALL=1 runs every query.
"""

import os

import pytest

from panelscope.plans.check import compare, oracle_connection
from panelscope.plans.registry import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()
DEFAULT = """panel_complete clean_panel quality_rules risk_category modal_category five_number_by_flag rolling_12
rank_average chi_square_permutation mann_kendall knn_edges random_weight_ranks cluster_bootstrap_ci
residual_bootstrap_intervals curve_areas model_comparison fact_predictions silhouette""".split()
NAMES = sorted(QUERIES) if os.environ.get("PANELSCOPE_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con(folder):
    return oracle_connection(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, folder, name):
    status, _, _, detail = compare(spark, con, folder, name, QUERIES[name], ORACLES.get(name))
    assert status in ("match", "rows"), detail


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and set(entry.oracle_sql()) <= set(entry.queries())
