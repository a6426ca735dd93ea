"""Every query of the plans against its SQL on the smallest tables."""

import pytest

from lodestar.plans import queries as plans
from tests.compare import database, difference


@pytest.fixture(scope="module")
def db(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, db, sf_dir, name):
    if name in plans.ORACLE_SQL:
        assert difference(spark, db, plans.QUERIES[name], plans.ORACLE_SQL[name], sf_dir) == ""
    else:
        assert plans.QUERIES[name](spark, sf_dir).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "q_hybrid_rrf" in entry.queries()
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank", "ranks"]
