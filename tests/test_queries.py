import pytest

from tests.oracle import connect, rows_of_frame, rows_of_sql
from veilspark.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    names, rows = rows_of_frame(QUERIES[name](spark, sf))
    assert names
    if name in SQL:
        assert (names, rows) == rows_of_sql(connect(sf), SQL[name])


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0
