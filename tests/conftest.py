from __future__ import annotations

import pytest

from spreadrank.operators.graph import graph_from_edges
from tests.session import new_session

# Five nodes; e is a sink, d has no in-edge.
FIVE = [("a", "b", 1.7), ("a", "c", 0.9), ("b", "c", 2.1), ("b", "e", 0.9), ("c", "a", 0.89), ("d", "a", 1.0)]


@pytest.fixture(scope="session")
def spark():
    return new_session()


@pytest.fixture(scope="session")
def five(spark):
    return graph_from_edges(spark.createDataFrame(FIVE, "src string, dst string, weight double"))
