import check
import pytest

from bibliospark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    message, ok = check.compare(spark, check.duck(folder), name, folder, QUERIES, ORACLES)
    assert ok, message


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
