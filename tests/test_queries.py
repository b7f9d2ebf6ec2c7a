import pytest

from parallax.queries.registry import QUERIES, SQL, entry
from tests.compare import DATA, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same(spark, name, QUERIES, SQL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert entry(spark, DATA).count() > 0
