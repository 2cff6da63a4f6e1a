"""Inverted lists against exact neighbours: recall, work, skewed lists, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from bibliospark.operators.vectors import Lists, centres, in_lists, knn, knn_in_lists, similar_items

DIM = 64


def table(spark, sf="sf0.1"):
    return spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def measured(rows, lists, k=10):
    """(recall, share of all products) of the rows with ids divisible by 20 against all rows."""
    asked = rows.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in knn(rows, asked, k, DIM).collect()}
    found = {(r.query_id, r.id) for r in knn_in_lists(rows, asked, k, DIM, lists).collect()}
    middle = centres(rows, DIM, lists)
    sizes = {r.list: r["count"] for r in in_lists(rows, DIM, middle).groupBy("list").count().collect()}
    probed = {r.list: r["count"] for r in in_lists(asked.withColumnRenamed("query_id", "id"), DIM, middle, lists.probes).groupBy("list").count().collect()}
    assert sum(sizes.values()) == rows.count()  # every row is listed
    return len(exact & found) / len(exact), sum(n * sizes.get(i, 0) for i, n in probed.items()) / (rows.count() * asked.count())


def test_recall_and_work_on_grouped_vectors(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(50, DIM))
    rows = [(i, [float(x) for x in middle[i % 50] + 0.6 * rng.normal(size=DIM)]) for i in range(3000)]
    recall, work = measured(spark.createDataFrame(rows, "id long, vec array<double>"), Lists(100, 4))
    assert recall >= 0.9 and work <= 0.1


def test_recall_on_vectors_without_groups(spark):
    recall, work = measured(table(spark), Lists(20, 14))
    assert recall >= 0.9 and work < 0.75


def test_all_lists_probed_is_exact(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(300)] + [(300 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(200)]
    data += [(900, [0.0] * 6), (901, [1.0]), (902, None)]
    rows = spark.createDataFrame(data, "id long, vec array<double>")
    asked = rows.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = sorted(map(tuple, knn(rows, asked, 7, 6).collect()))
    assert sorted(map(tuple, knn_in_lists(rows, asked, 7, 6, Lists(9, 9, 100), block=16).collect())) == exact
    assert sorted(map(tuple, similar_items(rows, 3, 6, Lists(9, 9)).collect())) == sorted(map(tuple, similar_items(rows, 3, 6).collect()))


def test_empty(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert knn_in_lists(none, none.withColumnRenamed("id", "query_id"), 3, 6, Lists(4, 2)).count() == 0


def test_two_large_sides_meet_in_a_grid(spark):
    """Blocks, cells and the single-precision bound lose nothing: ties by id, copies, odd vectors, more rows than one block."""
    rng = np.random.default_rng(3)
    vecs = np.concatenate([rng.integers(-2, 3, (2500, 6)), np.tile([1, 0, 2, 0, 0, 1], (900, 1)), rng.normal(size=(300, 6))]).astype(np.float32)
    data = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(vecs)), vecs)] + [(9001, [0.0] * 6), (9002, [1.0]), (9003, None), (9004, [float("nan")] * 6)]
    rows = spark.createDataFrame(data, "id long, vec array<float>").repartition(3)
    ids = np.array([i for i, v in data[: len(vecs)]])
    norms = np.linalg.norm(vecs.astype(np.float64), axis=1)
    ids, units = ids[norms > 0], vecs[norms > 0].astype(np.float64) / norms[norms > 0][:, None]
    scores = np.round(units @ units.T, 6)
    want = {int(q): [int(ids[j]) for j in np.lexsort((ids, -scores[i]))[:4]] for i, q in enumerate(ids)}
    for side in ("corpus", "queries"):
        found = knn(rows, rows.withColumnRenamed("id", "query_id"), 4, 6, in_place=side, cell=1 << 19)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
        exchanged = sum(n for n in [found._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroupsInArrow")])
        assert exchanged == 1  # one meeting per cell, no join that copies a side once per block of the other
