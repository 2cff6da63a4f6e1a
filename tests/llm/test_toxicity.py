import numpy as np
from pyspark.sql import functions as F

from bibliospark.llm.toxicity import Sparse, chain_scores, logistic, toxicity, train_chain


def test_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels.filter(~held), ["low_quality", "toxic"])
    rows = got.select("doc_id", "predicted").join(labels.filter(held), "doc_id").collect()
    caught = [r.predicted for r in rows if r.toxic]
    assert np.mean(caught) > 0.9 and np.mean([r.predicted for r in rows if not r.toxic]) < 0.01


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(0)
    texts, y = [], []
    for _ in range(400):
        a = rng.random() < 0.5
        b = a and rng.random() < 0.9
        texts.append(" ".join([*("alpha" if a else "omega" for _ in range(2)), *rng.choice(["one", "two", "three"], 3)]))
        y.append([a, b])
    model = train_chain(texts, np.array(y, float), features=4)
    assert len(model["weights"][1]) == len(model["weights"][0]) + 1 and model["weights"][1][-2] > 0
    p = chain_scores(model, ["alpha one", "omega two", ""])
    assert p[0].min() > 0.6 > 0.2 > p[1].max()


def test_logistic_part_and_single_label():
    x = Sparse([[0, 2], [], [1]], 3, np.ones((3, 1)))
    assert x.part(np.array([True, False, True])).times(np.arange(4.0)).tolist() == [5.0, 4.0]
    assert abs(1 / (1 + np.exp(-logistic(x, np.ones(3))[-1])) - 3.5 / 4) < 1e-9


def test_odd_rows(spark, folder, small, nothing):
    labels = spark.read.parquet(f"{folder}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 1)], "doc_id long, quality int, toxic int"))
    got = toxicity(small, labels, ["toxic"]).collect()
    assert len(got) == small.count() and all(0 <= r.toxic <= 1 for r in got)
    assert {r.toxic for r in toxicity(small, labels.filter("false"), ["quality", "toxic"]).collect()} == {0.5}
    assert toxicity(nothing, labels, ["toxic"]).count() == 0
