"""Catalogue deltas where double arithmetic is not exact."""

from bibliospark.sources.catalog import catalog_delta

# Sums that round up where they pass a power of two: (x + 1) - x is above 1.
TIMES = [x for x in (k - i / 100 for k in (1024, 4096, 32768, 262144, 1 << 30) for i in range(1, 100)) if (x + 1) - x > 1.0]


def test_one_second_is_unchanged(spark):
    assert TIMES
    known = spark.createDataFrame([(f"a{i}", x, 1) for i, x in enumerate(TIMES)], "path string, last_modified double, index_version int")
    current = [(f"a{i}", x + 1) for i, x in enumerate(TIMES)]
    later = [(f"a{i}", x + 1.001) for i, x in enumerate(TIMES)]
    schema = "path string, mtime double"
    assert {r.change for r in catalog_delta(spark.createDataFrame(current, schema), known).collect()} == {"unchanged"}
    assert {r.change for r in catalog_delta(spark.createDataFrame(later, schema), known).collect()} == {"changed"}
