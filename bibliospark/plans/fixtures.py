"""How the driver tables stand in for the library tables; each view exists as a DataFrame and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Expressions that read the same in both engines.
KIND = (
    "CASE p_type WHEN 'STANDARD' THEN 'definition' WHEN 'PROMO' THEN 'theorem' WHEN 'LARGE' THEN 'lemma' "
    "WHEN 'SMALL' THEN 'example' WHEN 'ECONOMY' THEN 'exercise' ELSE 'remark' END"
)
EXTENSION = "CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.DJVU' WHEN 'de' THEN '.epub' ELSE '.txt' END"
FOLDER = (
    "CASE source WHEN 'src3' THEN 'exports' WHEN 'src5' THEN '.git' WHEN 'src7' THEN '99_General_and_Diverse/Unsorted' "
    "ELSE source END"
)

TITLE_SQL = r"regexp_extract(text, '^[^.\n]*')"


def title():
    """First sentence of a text."""
    return F.regexp_extract("text", r"^[^.\n]*", 0)


def books(t) -> DataFrame:
    """Catalogue rows from documents."""
    return t.documents.select(
        F.col("doc_id").alias("id"),
        title().alias("title"),
        F.col("source").alias("author"),
        F.col("lang").alias("language"),
        (F.lit(1990) + F.col("n_chars") % 30).cast("long").alias("year"),
        F.concat(F.expr(FOLDER), F.lit("/"), F.col("source"), F.lit(" - "), F.col("doc_id").cast("string"),
                 F.expr(EXTENSION)).alias("path"),
        F.col("text").alias("content"),
    )


BOOKS_SQL = rf"""(SELECT doc_id AS id, {TITLE_SQL} AS title, source AS author, lang AS language,
  CAST(1990 + n_chars % 30 AS BIGINT) AS year,
  concat({FOLDER}, '/', source, ' - ', CAST(doc_id AS VARCHAR), {EXTENSION}) AS path,
  text AS content FROM documents)"""


def pages(t) -> DataFrame:
    """Book pages from conversations, numbered from 1."""
    return t.conversations.select(
        F.col("conv_id").alias("book_id"), (F.col("turn") + 1).alias("page"), "role", F.col("text").alias("content")
    )


PAGES_SQL = "(SELECT conv_id AS book_id, turn + 1 AS page, role, text AS content FROM conversations)"


def terms(t) -> DataFrame:
    """Knowledge terms from part."""
    return t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.expr(KIND).alias("kind"),
        F.expr("CASE WHEN p_retailprice < 1000 THEN 'approved' ELSE 'draft' END").alias("status"),
        F.col("p_size").cast("long").alias("book_id"), F.col("p_size").cast("long").alias("concept_id"),
        F.col("p_retailprice").alias("created_at"),
    )


TERMS_SQL = f"""(SELECT p_partkey AS id, p_name AS name, {KIND} AS kind,
  CASE WHEN p_retailprice < 1000 THEN 'approved' ELSE 'draft' END AS status, CAST(p_size AS BIGINT) AS book_id,
  CAST(p_size AS BIGINT) AS concept_id, p_retailprice AS created_at FROM part)"""
