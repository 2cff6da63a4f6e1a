from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from bibliospark.llm.common import WORD
from bibliospark.llm.mixing import hypergeometric, mixed, mixture, targets


def shares(sizes):
    """Targets by sharing again and again, from {source: size}; None last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped.update(over)


def test_targets_against_sharing_again(spark):
    cases = [{"a": 100, "b": 5, "c": 900, "d": 1, None: 40}, {"x": 7}, {"a": 0, "b": 0}, {"a": 0, "b": 10}, {f"s{i}": (i * 37) % 101 + (i == 3) * 5000 for i in range(30)}]
    for sizes in cases:
        rows = spark.createDataFrame([("" if s is None else "=" + s, n) for s, n in sizes.items()], "_source string, size long")
        got = {r._source[1:] if r._source else None: r.target for r in targets(rows).collect()}
        want = shares(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_against_its_contract(small, small_rows, nothing):
    got = mixture(small).collect()
    sizes, ids = defaultdict(int), []
    for _, text, source in small_rows:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken, largest = shares(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        n = len(WORD.findall(r.text or ""))
        assert r._size == n and r._source_size == sizes[r.source] and abs(r._target - want[r.source]) < 1e-6 * max(1, r._target)
        assert len(r._takes) <= 3 and [t.copy for t in r._takes] == list(range(len(r._takes)))
        taken[r.source] += n * len(r._takes)
        largest[r.source] = max(largest[r.source], n)
    assert len(got) == len(small_rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.05 * want[s], largest[s] / 2 + 1), (s, taken[s], want[s])
    again = mixture(small.repartition(5)).select("doc_id", F.xxhash64("text"), "_takes").collect()
    key = lambda rows: sorted(map(str, rows))
    assert key(again) == key(mixture(small).select("doc_id", F.xxhash64("text"), "_takes").collect())
    assert mixture(nothing).count() == 0


def test_shards_hold_equal_draws_and_rows(spark, small):
    drawn = mixture(small, levels=3, blocks=64)
    takes = drawn.select(F.explode("_takes").alias("t"))
    rows = mixed(small, levels=3, blocks=64)
    assert rows.count() == takes.count() and rows.columns == small.columns
    assert {r.shard for r in takes.select("t.shard").distinct().collect()} == set(range(8))


def test_hypergeometric_has_the_right_distribution(spark):
    n, k, m = 60, 20, 25
    u = [(i + 0.5) / 4000 for i in range(4000)]
    df = spark.createDataFrame([(x,) for x in u], "u double")
    got = [r[0] for r in df.select(hypergeometric(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(m).cast("long"), F.col("u"))).collect()]
    assert abs(np.mean(got) - m * k / n) < 0.02
    assert abs(np.var(got) - m * k / n * (1 - k / n) * (n - m) / (n - 1)) < 0.05
    edge = df.limit(3).select(*[hypergeometric(F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit(c).cast("long"), F.col("u")) for a, b, c in ((0, 0, 0), (5, 5, 3), (5, 0, 3), (5, 2, 5))]).collect()
    assert {tuple(r) for r in edge} == {(0, 3, 0, 2)}
