import os
import sys
from contextlib import contextmanager

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from panelscope.session import local_session

    return local_session("tests")


@pytest.fixture(scope="session")
def folder():
    return SF


@pytest.fixture(params=["merged", "many"])
def ranges(request, many_ranges):
    """Runs a test with the ranges that AQE leaves, and with many."""
    if request.param == "merged":
        yield
    else:
        with many_ranges():
            yield


@pytest.fixture
def many_ranges(spark):
    """Many small value ranges, as a large table has."""

    @contextmanager
    def held():
        names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
        before = {k: spark.conf.get(k) for k in names}
        for k, v in names.items():
            spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)

    return held


@pytest.fixture(scope="session")
def featured(spark, folder):
    from panelscope.plans import views
    from panelscope.sources.durable import durable

    return durable(views.featured(spark, folder))
