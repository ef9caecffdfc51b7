import pytest

from panelscope.llm import queries
from panelscope.plans.check import compare, oracle_connection


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, folder, name):
    status, _, _, detail = compare(spark, oracle_connection(folder), folder, name, queries.queries()[name], queries.oracle_sql()[name])
    assert status == "match", detail
