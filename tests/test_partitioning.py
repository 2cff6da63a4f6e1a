"""Page windows, runs and ranks across bucket edges against brute force, and independence of partitioning."""

import random

from pyspark.sql import functions as F

from bibliospark.operators import pages
from bibliospark.partitioning import first_per_key, rank_in_key, rows_before, runs, top_per_key, with_key_count


def numbers(seed, n, top):
    rng = random.Random(seed)
    return sorted({(rng.choice("ab"), rng.randrange(top)) for _ in range(n)})


def test_runs(spark):
    rows = numbers(1, 300, 200) + [("hot", p) for p in range(0, 400) if p % 37]
    expected = set()
    for key in {k for k, _ in rows}:
        ps = sorted(p for k, p in rows if k == key)
        start = prev = ps[0]
        for p in ps[1:] + [10**9]:
            if p != prev + 1:
                expected.add((key, start, prev))
                start = p
            prev = p
    for width in (1, 4, 16, 4096):
        got = {tuple(r) for r in runs(spark.createDataFrame(rows, "k string, p long"), ["k"], "p", width).collect()}
        assert got == expected, width


def test_rank_in_key(spark):
    rows = numbers(2, 200, 150)
    df = spark.createDataFrame(rows, "k string, p long")
    for width in (3, 64):
        for r in rank_in_key(df, ["k"], "p", "r", width).collect():
            ps = sorted(p for k, p in rows if k == r["k"])
            assert (r["r"], r["r_of"]) == (ps.index(r["p"]), len(ps))


def test_rows_before(spark):
    rng = random.Random(3)
    values = [rng.randrange(60) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = {r["v"]: r["n"] for r in rows_before(df, "v", F.floor(F.col("v") / 7), "n").collect()}
    assert got == {v: sum(x < v for x in values) for v in values}


def test_context_window_across_buckets(spark):
    rows = [("b", p, f"t{p}") for p in range(1, 700) if p % 11]
    df = spark.createDataFrame(rows, "book_id string, page long, content string")
    texts = {p: t for _, p, t in rows}
    for r in pages.context_window(df).collect():
        near = [p for p in range(r["page"] - 2, r["page"] + 5) if p in texts]
        assert r["context"] == "".join(f"\n\n% --- PAGE {p} ---\n\n{texts[p]}" for p in near)


def test_key_helpers_do_not_depend_on_partitions(spark):
    rows = [(k, v, f"{k}{v}") for k, v in numbers(4, 200, 100)] + [(None, 5, "n"), (None, 5, "m")]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "k string, v long, t string").repartition(parts)
        first = {r["k"]: r["v"] for r in first_per_key(df, ["k"], "v").collect()}
        assert first == {k: min(v for x, v, _ in rows if x == k) for k in {r[0] for r in rows}}
        top = {(r["k"], r["v"]) for r in top_per_key(df.filter("k is not null"), ["k"], 3, "v").collect()}
        assert top == {(k, v) for k in "ab" for v in sorted(x for y, x, _ in rows if y == k)[:3]}
        counts = {r["k"]: r["n"] for r in with_key_count(df, ["k"]).collect()}
        assert counts == {k: sum(r[0] == k for r in rows) for k in {r[0] for r in rows}}


def test_full_ranks_of_a_hot_key(spark):
    from bibliospark.partitioning import full_ranks

    rows = spark.range(3000).select((F.col("id") % 10 == 0).cast("int").alias("k"), (F.col("id") * 7919 % 3001).alias("v"), "id")
    got = full_ranks(rows, ["k"], F.col("v").desc(), F.col("id")).collect()
    for k in (0, 1):
        ordered = sorted(((-r.v, r.id) for r in got if r.k == k))
        assert [(r.rank, r.id) for r in sorted((r for r in got if r.k == k), key=lambda r: r.rank)] == [(n + 1, i) for n, (_, i) in enumerate(ordered)]
