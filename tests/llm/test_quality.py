import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from bibliospark.llm.quality import CODE, encode, forward, kept_by_quality, quality_scores, train


def labels_of(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = labels_of(spark, folder)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), labels.filter(~held)).join(labels.filter(held), "doc_id").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_odd_rows_and_filter(spark, folder, small, nothing):
    labels = labels_of(spark, folder).unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int"))
    got = quality_scores(small, labels).collect()
    assert len(got) == small.count() and all(0 <= r.score <= 1 for r in got)
    kept = kept_by_quality(small, labels)
    assert kept.columns == small.columns and kept.count() == sum(r.predicted for r in got)
    assert quality_scores(nothing, labels).count() == 0
    assert {r.score for r in quality_scores(small, labels.filter("false")).collect()} == {0.5}


def test_encoding_covers_the_whole_text():
    words = [f"w{i}" for i in range(1000)]
    assert encode(" ".join(words)).shape == (8, CODE) and encode("").shape == (1, CODE) == encode(" \n").shape
    assert not np.allclose(encode(" ".join(words))[-1], encode(" ".join(words[:-1] + ["#####"]))[-1])


def test_attention_is_the_formula_and_gradients_fall():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(rng.integers(1, 6), CODE)) for _ in range(80)]
    y = np.array([float(b[:, 0].max() > 0.8) for b in bags])
    w = train(bags, y, epochs=30)
    got = forward(w, np.concatenate(bags), np.repeat(np.arange(80), [len(b) for b in bags]), 80)[-1]
    for bag, logit in zip(bags, got, strict=True):
        h = [np.tanh(((x - w["mean"]) / w["scale"]) @ w["encode"] + w["shift"]) for x in bag]
        e = [math.exp((np.tanh(k @ w["V"]) / (1 + np.exp(-(k @ w["U"])))) @ w["w"]) for k in h]
        z = sum(a * k for a, k in zip(e, h, strict=True)) / sum(e)
        assert abs(z @ w["c"] + w["b"][0] - logit) < 1e-6
    assert np.mean((got > 0) == (y > 0)) > 0.9


def test_crc_fold_is_zlibs(spark):
    rows = spark.range(50).select("id", (F.crc32(F.col("id").cast("string")) % 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
