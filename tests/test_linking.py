"""Registry link, insert filter, enrichment and file-name conflicts on small cases."""

from pyspark.sql import functions as F

from bibliospark.operators import joins, quality, resolve


def test_registry_link(spark):
    registry = spark.createDataFrame(
        [(1, "Real Analysis", "Folland, Gerald"), (2, "Real Analysis for Graduate Students", "Bass, Richard"), (3, "Topology", "Munkres, James")],
        "zbl_id long, zb_title string, zb_authors string")
    books = spark.createDataFrame(
        [(10, "Real Analysis: Modern Techniques", "Gerald Folland"), (11, "Topology", "Unknown"), (12, "Graduate Texts in Mathematics: Topology", "Munkres"),
         (13, "Unknown", "X"), (14, "Real Analysis", "Nobody"), (15, "Number Theory", "Hardy"), (16, "Real Analysis for Students", "R. Bass")],
        "id long, title string, author string")
    got = {r["id"]: (r["zbl_id"], r["stage"]) for r in joins.registry_link(books, registry).collect()}
    assert got == {10: (1, 1), 11: (3, 4), 12: (3, 1), 14: (1, 4), 16: (2, 2)}


def test_term_insert_filter(spark):
    body = "Let X be a compact metric space and let f be a continuous map on it."
    old = spark.createDataFrame([(1, 1, 3, "Old", body)], "id long, book_id long, page long, name string, latex string")
    rows = [
        (10, 1, 3, "OLD", "theorem", "Something short."), (11, 1, 4, "Near", "lemma", body.replace("compact", "compct")), (12, 1, 5, "Far", "lemma", body.replace("compact", "compct")),
        (13, 1, 9, "P", "Proof", "text"), (14, 1, 9, "Proof of P", "theorem", "text"), (15, 1, 9, "Twice", "theorem", "text a"), (16, 1, 9, "twice", "theorem", "text b"),
        (17, 2, 3, "Other book", "theorem", body), (18, 1, 3, "Chatter", "theorem", "(Note: I fixed it)"), (19, 1, 3, "Dots", "theorem", "Chapter 1 ..... 7")]
    new = spark.createDataFrame(rows, "id long, book_id long, page long, name string, kind string, latex string")
    assert {r["id"] for r in resolve.term_insert_filter(new, old).collect()} == {12, 15, 17}


def test_enrich_from_registry(spark):
    books = spark.createDataFrame(
        [(1, 7, "Vorlesungen und mehr", "Unknown", None), (2, 7, "Unknown", "A", None), (3, 8, "Real Analysis", None, None)],
        "id long, zbl_id long, title string, author string, language string")
    registry = spark.createDataFrame([(7, "Lectures and more", "B, C"), (8, "Real Analysis: Modern Techniques", "Folland")], "zbl_id long, zb_title string, zb_authors string")
    got = {r["id"]: (r["title"], r["author"], r["metadata_status"]) for r in joins.enrich_from_registry(books, registry).collect()}
    assert got == {1: ("Vorlesungen und mehr", "B, C", "conflict"), 2: ("Lectures and more", "A", "verified"), 3: ("Real Analysis: Modern Techniques", "Folland", "verified")}


def test_title_filename_conflict(spark):
    books = spark.createDataFrame([(1, "Real Analysis", "folland real_analysis.pdf"), (2, "Topology", "zzz.djv")], "id long, title string, filename string")
    assert {r["id"] for r in quality.title_filename_conflict(books).collect()} == {2}


def test_knn_emits_k_per_query_and_block_for_equal_vectors(spark):
    from bibliospark.operators import vectors

    corpus = spark.range(5000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "query_id long, vec array<double>")
    got = [(r.query_id, r.id) for r in vectors.knn(corpus, queries, 3, 2, block=500).orderBy("query_id", "rank").collect()]
    assert got == [(q, i) for q in (1, 2) for i in range(3)]
    import pandas as pd

    block = pd.DataFrame({"ids": [list(range(1000))], "vecs": [[[1.0, 2.0]] * 1000], "qids": [[1, 2]], "qvecs": [[[1.0, 2.0], [2.0, 1.0]]]})
    assert [len(f) for f in vectors._best(3)(iter([block]))] == [6]
