"""The training-data queries that SQL can express against their SQL."""

import pytest

from quireflow.llm.queries import ORACLES, QUERIES
from tests.compare import connect, rows
from tests.llm.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark):
    got, want = QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
