"""Every query with an oracle gives what DuckDB gives on the same tables."""

import pytest

from stallwright import plans

from .conftest import SMALL
from .oracle import assert_same


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_oracle(spark, name):
    assert_same(plans.queries()[name](spark, SMALL), plans.oracle_sql()[name], SMALL)


def test_every_query_has_an_oracle():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
