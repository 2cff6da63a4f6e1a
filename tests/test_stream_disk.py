"""A batch of the index keeps its texts and words once: in its own files, not in checkpoints beside them."""

from pyspark.sql import functions as F

from bibliospark.session import work_folder
from bibliospark.sources.index import postings, word_rows
from bibliospark.streaming import flows

SCHEMA = "doc_id long, version long, deleted boolean, text string"


def test_checkpoints_hold_versions_only(spark, monkeypatch):
    work, kept, cut = work_folder(spark, "index"), [], flows.cut_lineage
    monkeypatch.setattr(flows, "cut_lineage", lambda df: kept.append(df.schema) or cut(df))
    batches = [[(1, 2, False, "old words"), (2, 2, None, "two"), (3, 2, False, "gone")],
               [(1, 4, False, "new words new"), (1, 3, False, "passing"), (3, 4, True, "x"), (2, 1, False, "late"), (5, 1, False, ""), (6, 1, False, "b"), (6, 1, False, "a")]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{work}/in")
        flows.update_index(flows.file_stream(spark, f"{work}/in", spark.createDataFrame([], SCHEMA).schema), ["text"], work, f"{work}/checkpoint")
    assert kept and not [s for s in kept if "string" in s.simpleString()]
    assert {tuple(r) for r in flows.live_postings(spark, work).collect()} == {
        (1, "text", "new", 2, 3), (1, "text", "words", 1, 3), (2, "text", "two", 1, 1), (6, "text", "b", 1, 1)}
    assert {tuple(r) for r in flows.document_frequencies(spark, work).collect()} == {("text", w, 1) for w in ("new", "words", "two", "b")}
    assert [tuple(r) for r in flows.index_sizes(spark, work).collect()] == [("text", 3, 5)]


def test_words_of_a_row_are_its_postings(spark):
    docs = spark.createDataFrame([(1, "A a b", "c"), (2, None, "ä Ä x-y"), (3, "", None), (4, "a " * 3000, "_ 7")], "doc_id long, title string, text string")
    fields = ["title", "text"]
    words = word_rows(docs, fields)
    got = [tuple(r) for r in words.select("doc_id", F.explode("words").alias("_w")).select("doc_id", "_w.*").collect()]
    want = [tuple(r) for r in postings(docs, fields).drop("lead").collect()]
    assert sorted(got) == sorted(want) and len(got) == 8 and words.filter("words IS NULL").count() == 1
