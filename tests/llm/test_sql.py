"""The text operators whose whole result SQL can express."""

import pytest
from oracle import differences

from stratum.llm import queries
from stratum.llm.sql import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(queries.queries()[name](spark, sf_dir), sf_dir, ORACLES[name]) == ""
