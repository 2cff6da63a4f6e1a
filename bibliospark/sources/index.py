"""Search documents, the inverted index and its maintenance."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliospark.functions import text as tx
from bibliospark.partitioning import input_parts
from bibliospark.session import work_folder

# Display-math forms in harvest order.
DISPLAY_MATH = [r"(?s)\\\[(.*?)\\\]", r"(?s)\$\$(.*?)\$\$"] + [
    rf"(?s)\\begin\{{{env}\}}(.*?)\\end\{{{env}\}}" for env in ("equation", "align", "gather", "eqnarray", "multline")]


def assemble_book_doc(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """One search document per book: text fields coalesced, chapter titles joined in page order.

    chapters(book_id, page, id, title). The table of contents is one string by definition; only short titles meet.
    """
    toc = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page", "id", "title"))).alias("_c")).select(
        F.col("book_id").alias("id"), F.array_join(F.col("_c.title"), "\n").alias("toc"))
    texts = [f.name for f in books.schema.fields if f.dataType.simpleString() == "string"]
    return books.join(toc, "id", "left").fillna("", texts + ["toc"])


def page_doc_upsert(versions: DataFrame) -> DataFrame:
    """(id, content): the highest-priority text of every page under ``book_<id>_p<page>``."""
    key = F.concat(F.lit("book_"), F.col("book_id").cast("string"), F.lit("_p"), F.col("page").cast("string"))
    return versions.groupBy(key.alias("id")).agg(F.max_by("content", "priority").alias("content"))


def index_patch(index: DataFrame, store: DataFrame, columns: list[str]) -> DataFrame:
    """Index documents with the patch columns of the store; ids the index lacks are skipped."""
    patch = store.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = index.join(patch, "id", "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in index.columns])


def index_backfill(index: DataFrame, store: DataFrame) -> DataFrame:
    """Store rows whose id the index lacks."""
    return store.join(index.select("id"), "id", "left_anti")


def token_runs(words: Column) -> Column:
    """'the the the' strings, one per distinct word: sorted words, joined and cut into runs of equal ones."""
    return F.regexp_extract_all(F.array_join(F.sort_array(words), " "), F.lit(r"(?<!\S)(\S+)(?: \1(?!\S))*"), F.lit(0))


def word_rows(docs: DataFrame, fields: list[str], *kept: str) -> DataFrame:
    """(doc_id, kept, words): the postings of a document as one array of its row, null for a document without words."""
    def counted(field: str) -> Column:
        return tx.let(tx.tokens(F.coalesce(field, F.lit(""))), lambda words: F.transform(token_runs(words), lambda run: tx.let(
            F.substring_index(run, " ", 1), lambda token: F.struct(F.lit(field).alias("field"), token.alias("token"), (
                (F.length(run) + 1) / (F.length(token) + 1)).cast("long").alias("tf"), F.size(words).cast("long").alias("dl")))))

    words = F.concat(*[counted(field) for field in fields])
    return docs.select("doc_id", *kept, tx.let(words, lambda w: F.when(F.size(w) > 0, w)).alias("words"))


def postings(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, field, token, tf, dl, lead) from docs(doc_id, <fields>), one row per document.

    All words of a document are in its row, so they are counted there and nothing is shuffled. ``lead`` marks one
    posting per document and field, for statistics over documents.
    """
    stacked = docs.select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), tx.tokens(F.coalesce(f, F.lit(""))).alias("words")) for f in fields])).alias("_f"))
    found = stacked.select("doc_id", "_f.field", F.size("_f.words").cast("long").alias("dl"), F.posexplode(token_runs(F.col("_f.words"))).alias("_at", "_run"))
    token = F.substring_index("_run", " ", 1)
    tf = ((F.length("_run") + 1) / (F.length(token) + 1)).cast("long")
    return found.select("doc_id", "field", token.alias("token"), tf.alias("tf"), "dl", (F.col("_at") == 0).alias("lead"))


def token_stats(post: DataFrame) -> DataFrame:
    """(field, token, df): kept as its own small table so that updates only add deltas to it."""
    return post.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"))


def with_token_counts(post: DataFrame) -> DataFrame:
    """Postings with the df of their word in their field. The counts of a word's fields are one row, so a kept index is
    joined by its own buckets."""
    counts = token_stats(post).groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("field", "df"))).alias("_df"))
    return post.join(counts, "token").select("field", "token", "doc_id", "tf", "dl", F.col("_df")[F.col("field")].alias("df"))


def corpus_stats(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_docs, avgdl) over the documents that have the field."""
    sizes = docs.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.size(tx.tokens(F.coalesce(f, F.lit("")))).alias("dl")) for f in fields])).alias("_f")).select("_f.*")
    return sizes.filter("dl > 0").groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def write_index(post: DataFrame, table: str, buckets: int, folder: str | None = None) -> None:
    """Postings as a table bucketed by token, one sorted file a bucket: joins and counts by token read it without an
    exchange. ``folder`` places the files, the warehouse otherwise."""
    writer = post.repartition(buckets, "token").write.mode("overwrite").bucketBy(buckets, "token").sortBy("token").format("parquet")
    (writer.option("path", folder) if folder else writer).saveAsTable(table)


def open_index(spark: SparkSession, table: str) -> tuple[DataFrame, DataFrame]:
    """Postings and corpus statistics of a written index."""
    post = spark.table(table)
    return post, post.filter("lead").groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def kept_index(docs: DataFrame, fields: list[str], table: str | None = None, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings and corpus statistics of docs(doc_id, <fields>), built at the first call and read at later ones.

    The table is named after the files and the plan of ``docs`` unless ``table`` names it. It holds the documents as they were at the
    first call; ``drop_index`` lets the next call build it anew. Unless ``buckets`` says otherwise there are more of them for
    more documents, as a bucket is sorted by one task.
    """
    spark = docs.sparkSession
    table = table or index_name(docs, fields)
    if not spark.catalog.tableExists(table):
        write_index(postings(docs, fields), table, buckets or input_parts(docs), work_folder(spark, "index"))
    return open_index(spark, table)


def index_name(docs: DataFrame, fields: list[str]) -> str:
    """A name that follows from the files that ``docs`` reads and what it makes of them; a new one for rows without files."""
    files = docs.inputFiles()
    read = "|".join([*fields, *docs.schema.fieldNames(), docs._jdf.queryExecution().analyzed().canonicalized().toString(), *(sorted(files) or [uuid.uuid4().hex])])
    return "postings_" + hashlib.md5(read.encode()).hexdigest()


def drop_index(spark: SparkSession, table: str) -> None:
    """Forgets the table; its files stay in the shared folder for searches that still read them."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def formula_harvest(terms: DataFrame) -> DataFrame:
    """(id, idx, formula) of the display-math blocks of terms(id, latex); blank blocks keep their index but no row."""
    found = F.concat(*[F.regexp_extract_all("latex", F.lit(p), F.lit(1)) for p in DISPLAY_MATH])
    return terms.select("id", F.posexplode(found).alias("idx", "_f")).select("id", "idx", tx.strip("_f").alias("formula")).filter("formula <> ''")
