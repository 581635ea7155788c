"""Every query against its SQL."""

import oracle
import pytest

from ordinale.queries import CATALOGUE


@pytest.fixture(scope="module")
def duck(data):
    return oracle.connect(f"{data}/sf0.001")


@pytest.mark.parametrize("name", CATALOGUE)
def test_query(spark, data, duck, name):
    q = CATALOGUE[name]
    assert oracle.differences(q.run(spark, f"{data}/sf0.001"), q.sql, duck) is None
