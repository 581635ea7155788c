"""The queries that have SQL against it."""

import oracle
import pytest

from ordinale.llm import queries


@pytest.fixture(scope="module")
def duck(data):
    return oracle.connect(f"{data}/sf0.001")


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, data, duck, name):
    assert oracle.differences(queries.queries()[name](spark, f"{data}/sf0.001"), queries.oracle_sql()[name], duck) is None
