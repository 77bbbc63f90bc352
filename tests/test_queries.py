"""Every query with an SQL equivalent gives the same rows as it; every other one runs."""

import pytest

from lexquarry.plans import registry
from tests.compare import connect, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "quote_id", "start", "end", "evidence_id"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
