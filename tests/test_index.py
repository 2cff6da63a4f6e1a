"""The kept index: built once, read without an exchange of postings, and right after a rebuild."""

from pyspark.sql import functions as F

from bibliospark.operators.retrieval import bm25_scores
from bibliospark.partitioning import input_parts
from bibliospark.sources import index


def scans_below_exchanges(plan, moved=False, found=None):
    """For every scan of a bucketed table in a physical plan: whether an exchange of rows stands over it."""
    found = [] if found is None else found
    name = plan.nodeName()
    if name.startswith("Scan parquet") and "Bucketed: true" in plan.verboseStringWithOperatorId() + plan.simpleString(1000):
        found.append(moved)
    children = plan.children()
    for i in range(children.size()):
        scans_below_exchanges(children.apply(i), moved or name == "Exchange", found)
    return found


def test_postings_are_joined_and_counted_without_an_exchange(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    queries = docs.limit(20).select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 40).alias("query"))
    post, stats = index.kept_index(docs, ["text"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        words = queries.select(F.explode(F.split(F.lower("query"), r"[^\p{L}\p{N}]+")).alias("token")).distinct()
        counted = index.token_stats(post.join(words, "token", "left_semi"))
        assert scans_below_exchanges(counted._jdf.queryExecution().executedPlan()) == [False]
        kept = {(r.query_id, r.doc_id): r.score for r in bm25_scores(post, stats, queries, {"text": 1.0}).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    fresh = index.postings(docs, ["text"])
    plain = bm25_scores(fresh, index.corpus_stats(docs, ["text"]), queries, {"text": 1.0}).collect()
    assert kept == {(r.query_id, r.doc_id): r.score for r in plain} and len(kept) > 20


def test_postings_meet_their_counts_without_an_exchange(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    post, _ = index.kept_index(docs, ["text", "lang"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counted = index.with_token_counts(post)
        assert scans_below_exchanges(counted._jdf.queryExecution().executedPlan()) == [False, False]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    plain = post.drop("lead").join(index.token_stats(post), ["field", "token"])
    assert counted.columns == plain.columns and counted.count() == plain.count() > 1000 and counted.exceptAll(plain).isEmpty()


def test_more_documents_more_buckets(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert input_parts(docs) == 4 and input_parts(docs, 10_000) > 10 and input_parts(docs.join(docs.limit(9), "doc_id"), 10_000) < 10 * input_parts(docs, 10_000)
    assert input_parts(spark.createDataFrame([(1,)], "doc_id long").checkpoint(), 10_000) == 4


def test_second_call_reads_what_the_first_built(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    name = index.index_name(docs, ["text"])
    index.drop_index(spark, name)
    post, _ = index.kept_index(docs, ["text"])
    files = sorted(post.inputFiles())
    again, _ = index.kept_index(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), ["text"])
    assert sorted(again.inputFiles()) == files
    other, _ = index.kept_index(docs.filter("doc_id % 2 = 0"), ["text"])
    assert set(other.inputFiles()).isdisjoint(files)
    index.drop_index(spark, name)
    assert set(index.kept_index(docs, ["text"])[0].inputFiles()).isdisjoint(files)
    made = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(2, "c")], "doc_id long, text string")
    assert [index.kept_index(d, ["text"])[0].count() for d in made] == [2, 1]
