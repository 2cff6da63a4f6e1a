"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the others give rows."""

import check
import pytest

from bibliospark.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(folder):
    return check.duck(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, folder, name):
    message, ok = check.compare(spark, duck, name, folder, QUERIES, ORACLES)
    assert ok, message


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
