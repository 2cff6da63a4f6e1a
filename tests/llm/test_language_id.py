import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bibliospark.llm.language_id import ORDERS, SMOOTHING, UNKNOWN, Scorer, fit, grams_of, languages, words_of
from bibliospark.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op11_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang_pred != UNKNOWN]
    assert len(got) == 1000 and len(held) > 150
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == UNKNOWN) == (not any(c.isalpha() for c in r.text or "")) for r in got)


def test_model_is_the_counts_of_the_sample(spark, small):
    docs = small.filter(F.col("lang").isNotNull())
    model = fit(docs, docs=10**6, words=10**6, grams=10**6)
    counts, grams = Counter(), Counter()
    for r in docs.collect():
        for word in words_of(r.text or ""):
            counts[word, r.lang] += 1
            for order in ORDERS:
                grams.update((order, g, r.lang) for g in grams_of(word, order))
    assert model["langs"] == sorted({lang for _, lang in counts})

    def logs(keys, count):
        total = {lang: sum(count(k, lang) + SMOOTHING for k in keys) for lang in model["langs"]}
        return lambda key: [math.log((count(key, lang) + SMOOTHING) / total[lang]) for lang in model["langs"]]

    rows, table = model["words"]
    want = logs(set(rows), lambda k, lang: counts[k, lang])
    assert set(rows) == {w for w, _ in counts}
    for word in list(rows)[:200]:
        assert np.allclose(table[rows[word]], want(word), atol=1e-4)
    for order in ORDERS:
        rows, table = model["grams"][order]
        want = logs(set(rows), lambda k, lang: grams[order, k, lang])
        assert set(rows) == {g for n, g, _ in grams if n == order}
        assert all(np.allclose(table[rows[g]], want(g), atol=1e-4) for g in list(rows)[:50])


def test_back_off_takes_the_longest_known_order():
    grams = {5: ({"<abcd": 0}, np.array([[-1.0, -2.0]], np.float32)), 4: ({"xyz>": 0, "<xyz": 1}, np.array([[-3.0, -1.0], [-5.0, -2.0]], np.float32)),
             3: ({}, np.zeros((0, 2), np.float32)), 2: ({}, np.zeros((0, 2), np.float32)), 1: ({"q": 0}, np.array([[-4.0, -9.0]], np.float32))}
    model = {"langs": ["aa", "bb"], "words": ({"known": 0}, np.array([[-0.5, -7.0]], np.float32)), "grams": grams}
    for remembered in (2, 1000):
        scorer = Scorer(model, remembered)
        assert np.allclose(scorer.sums(["known"]), [-0.5, -7]) and np.allclose(scorer.sums(["abcd"]), [-1, -2])
        assert np.allclose(scorer.sums(["xyz"]), [-4, -1.5]) and np.allclose(scorer.sums(["qq", "known", "qq", "zz"]), [-8.5, -25])
        assert scorer.predict("Known known 12") == ("aa", scorer.predict("known KNOWN")[1])
        assert scorer.predict("12 -- !") == (UNKNOWN, 0.0) == scorer.predict("") and scorer.predict("zz") == ("aa", 0.5)


def test_odd_rows(spark, small, nothing):
    model = fit(small.filter(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)))
    got = languages(small, model).collect()
    assert len(got) == small.count() and sum(r.doc_id is None for r in got) == 2
    assert {r.lang_pred for r in got if r.doc_id in (900_001, 900_002, 900_003)} == {UNKNOWN}
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 900_005}) == 1
    assert languages(nothing, model).count() == 0
    assert {r.lang_pred for r in languages(small, fit(nothing)).collect()} == {UNKNOWN}
    assert languages(small, fit(small.filter("lang = 'fr'"))).filter("lang_pred not in ('fr', 'und')").count() == 0


def test_sample_is_bounded_per_language(spark, small):
    from bibliospark.llm.language_id import sample

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") % 100 == 0, "few").otherwise("many").alias("lang"))
    sizes = {r.lang: r["count"] for r in sample(docs, 500).groupBy("lang").count().collect()}
    assert sizes["few"] == 200 and 350 < sizes["many"] < 650
