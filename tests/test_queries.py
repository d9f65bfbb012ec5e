import pytest

import __spark_entry__
from tests.oracle import assert_same
from tidewell.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE[name])


def test_every_query_is_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())


def test_entry_gives_ticks(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["number", "win_idx", "head", "tail", "open_win"]
    assert df.groupBy("win_idx").count().orderBy("win_idx").collect() == [(0, 171), (1, 42), (2, 8), (3, 1)]
