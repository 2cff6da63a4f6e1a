"""Best documents by blocks against all scores, ranked."""

import random

import pytest
from pyspark.sql import functions as F

from bibliospark.operators import retrieval as op
from bibliospark.partitioning import top_per_key
from bibliospark.sources import index


@pytest.mark.parametrize("all_words", [False, True])
@pytest.mark.parametrize("combine", ["best", "sum"])
def test_blocks_against_all_scores(spark, combine, all_words):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(30)], k=n))
    copies = [(1000 + i, "w0 w1", "w1 w2 w2") for i in range(40)]
    docs = spark.createDataFrame([(i, text(3), text(rng.randrange(30)) if i % 9 else None) for i in range(300)] + copies, "doc_id long, title string, body string")
    asked = [(i, text(rng.randrange(1, 4))) for i in range(40)] + [(100, "w3 unknown"), (101, ""), (102, None), (103, "w1 w0"), (104, "W0 w1"), (105, "w2 w2 w9")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    fields = ["title", "body"]
    post, stats, boosts = index.postings(docs, fields), index.corpus_stats(docs, fields), {"title": 2.0, "body": 1.0}
    every = op.bm25_scores(post, stats, queries, boosts, combine, all_words=all_words)
    want = top_per_key(every, ["query_id"], 7, F.col("score").desc(), "doc_id").collect()
    for block in (200, 1_000_000):
        got = op.bm25_top(post, stats, queries, boosts, 7, combine, all_words=all_words, block=block).collect()
        assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in got) == sorted((r.query_id, r.rank, r.doc_id, r.score) for r in want)
    assert want


def test_pairs_never_become_rows(spark):
    """300 queries for two words that stand in all of 400 documents: 120,000 pairs, of which no plan node makes rows."""
    docs = spark.createDataFrame([(i, "the of " + "x " * (i % 7)) for i in range(400)], "doc_id long, content string")
    queries = spark.createDataFrame([(i, "the of" if i % 2 else f"the the of {'of ' * i}") for i in range(300)], "query_id long, query string")
    hits = op.fts_search(index.postings(docs, ["content"]), index.corpus_stats(docs, ["content"]), queries, 3)
    assert hits.count() == 900
    before = spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    hits.collect()
    assert spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite() - before < 300_000
