"""The operator queries against SQL where SQL can say the same."""

import pytest
from conftest import SF_DIR

from compare import compare
from wafermill.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, SF_DIR, name) is None
