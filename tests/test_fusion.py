"""Result pages of text hits and vectors against a full product, for every sort order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from bibliospark.operators import retrieval as op
from bibliospark.operators.retrieval import hybrid_page
from bibliospark.operators.vectors import knn
from bibliospark.sources import index


def product(hits, vectors, queries, books):
    """query -> doc -> score over all text hits and all vectors."""
    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / norm, 6) if norm else None

    out = {}
    for q in {q for q, _, _ in hits} | set(queries):
        scores = {}
        for doc in books:
            text = next((s for p, d, s in hits if (p, d) == (q, doc)), None)
            near = cosine(vectors[doc], queries[q]) if doc in vectors and q in queries else None
            if text is not None or near is not None:
                scores[doc] = round((text or 0.0) + (0.4 * (1 + near) / 2 if near is not None else 0.0), 6)
        if scores:
            out[q] = scores
    return out


@pytest.mark.parametrize("sort_by", ["relevance", "year", "title", "author"])
def test_pages(spark, sort_by):
    rng = random.Random(21)
    books = {d: (f"T{rng.randrange(25)}", f"a{rng.randrange(6)}", rng.choice((None, *range(1990, 1996)))) for d in range(80)}
    vectors = {d: [float(rng.randrange(-3, 4)) for _ in range(4)] for d in range(10, 90)}
    vectors[11] = [0.0] * 4
    queries = {q: [float(rng.randrange(-3, 4)) or 1.0 for _ in range(4)] for q in range(6)}
    hits = [(q, d, round(rng.random() * 3, 3)) for q in (*range(4), 9) for d in rng.sample(range(80), 15)]
    got = hybrid_page(
        spark.createDataFrame(hits, "query_id long, doc_id long, score double"), spark.createDataFrame([*vectors.items(), (300, [1.0])], "id long, vec array<double>"),
        spark.createDataFrame(list(queries.items()), "query_id long, vec array<double>"),
        spark.createDataFrame([(d, *b) for d, b in books.items()], "doc_id long, title string, author string, year long"), 4, sort_by, limit=7, offset=3).collect()
    first = {"relevance": lambda d: (), "year": lambda d: (-(books[d][2] or 0),), "title": lambda d: (books[d][0].lower(),), "author": lambda d: (books[d][1].lower(),)}[sort_by]
    want = set()
    for q, scores in product(hits, vectors, queries, books).items():
        ranked = sorted(scores, key=lambda d: (*first(d), -scores[d], d))
        want |= {(q, d, i + 1, scores[d], len(scores)) for i, d in enumerate(ranked) if 3 <= i < 10}
    assert {(r.query_id, r.doc_id, r.position, r.score, r.total) for r in got} == want


@pytest.mark.parametrize("sort_by", ["relevance", "year", "title", "author"])
def test_pages_of_blocks(spark, sort_by):
    """Pages from blocks of books are those of all text hits; no text hit leaves its block."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(12)], k=n))
    docs = spark.createDataFrame([(d, text(2), text(rng.randrange(25)) if d % 7 else None) for d in range(500)], "doc_id long, title string, body string")
    books = docs.filter("doc_id < 450").select("doc_id", F.when(F.col("doc_id") % 11 > 0, F.col("title")).alias("title"), (F.col("doc_id") % 5).cast("string").alias("author"),
                                               F.expr("CASE WHEN doc_id % 13 > 0 THEN 1990 + doc_id % 4 END").alias("year"))
    vectors = {d: [float(rng.randrange(-3, 4)) for _ in range(4)] for d in range(40, 520)}
    vectors[41] = [0.0] * 4
    corpus = spark.createDataFrame([*vectors.items(), (5, [1.0])], "id long, vec array<double>")
    asked = spark.createDataFrame([(q, text(3)) for q in range(12)] + [(20, "unknown"), (21, ""), (22, None)], "query_id long, query string")
    queries = spark.createDataFrame([(q, [float(rng.randrange(-3, 4)) or 1.0 for _ in range(4)]) for q in (*range(9), 20, 22, 30)], "query_id long, vec array<double>")
    boosts = {"title": 2.0, "body": 1.0}
    post, stats = index.postings(docs, list(boosts)), index.corpus_stats(docs, list(boosts))
    want = hybrid_page(op.bm25_scores(post, stats, asked, boosts), corpus, queries, books, 4, sort_by, limit=6, offset=2)
    rows = lambda df: sorted((r.query_id, r.position, r.doc_id, r.score, r.total, r.title, r.year) for r in df.collect())
    want = [tuple(map(str, r)) for r in rows(want.fillna("", ["title"]).fillna(0, ["year"]))]
    for block in (300, 1_000_000):
        got = op.hybrid_search_page(post, stats, asked, boosts, corpus, queries, books, 4, sort_by, limit=6, offset=2, block=block)
        assert [tuple(map(str, r)) for r in rows(got.fillna("", ["title"]).fillna(0, ["year"]))] == want
    assert want


def test_filtered_pairs_of_blocks(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(d, f"a b{d % 3}", "c " * (d % 4)) for d in range(200)], "doc_id long, title string, body string")
    kept = docs.filter("doc_id % 5 < 2").select("doc_id")
    corpus = spark.createDataFrame([(d, [rng.random() - 0.5 for _ in range(4)]) for d in range(0, 260, 2)], "id long, vec array<double>")
    asked = spark.createDataFrame([(1, "a"), (2, "b1 c"), (3, "none"), (4, "c c")], "query_id long, query string")
    queries = spark.createDataFrame([(q, [rng.random() - 0.5 for _ in range(4)]) for q in (1, 3, 9)], "query_id long, vec array<double>")
    boosts = {"title": 2.0, "body": 1.0}
    post, stats = index.postings(docs, list(boosts)), index.corpus_stats(docs, list(boosts))
    near = knn(corpus.join(kept, F.col("id") == F.col("doc_id"), "left_semi"), queries, None, 4)
    want = op.hybrid_search(op.bm25_scores(post, stats, asked, boosts).join(kept, "doc_id", "left_semi"), near)
    got = op.hybrid_blocks(post, stats, asked, boosts, corpus, queries, kept, 4, narrow=True).drop("n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 200


def test_hybrid_pairs_never_become_rows(spark):
    docs = spark.createDataFrame([(i, "the of " + "x " * (i % 7)) for i in range(400)], "doc_id long, content string")
    asked = spark.createDataFrame([(i, "the of") for i in range(300)], "query_id long, query string")
    vectors = lambda name, n: spark.createDataFrame([(i, [float(i % 9 + 1), 1.0, float(i % 5)]) for i in range(n)], f"{name} long, vec array<double>")
    books = docs.select("doc_id", F.lit("t").alias("title"), F.lit("a").alias("author"), F.lit(2000).alias("year"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    page = op.hybrid_search_page(index.postings(docs, ["content"]), index.corpus_stats(docs, ["content"]), asked, {"content": 1.0}, vectors("id", 400), vectors("query_id", 300), books, 3, limit=3)
    assert {r.total for r in page.collect()} == {400}
    assert written() - before < 400_000
