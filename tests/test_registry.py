"""Each registered query gives the rows of its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from helpers import DATA, assert_same

from kinloom import registry

R = registry.load()


@pytest.mark.parametrize("name", sorted(R.oracles))
def test_parity(spark, duck, name):
    assert_same(R.queries[name](spark, f"{DATA}/sf0.001"), duck, R.oracles[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["q_id", "s1_id", "country"]
    assert set(R.queries) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
