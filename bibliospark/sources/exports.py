"""Exports: network JSON and bulk BibTeX."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.partitioning import with_key_count


def export_network(nodes: DataFrame, links: DataFrame, coordinates: bool = True) -> DataFrame:
    """(kind, id, json) rows of the co-author canvas: authors with more than one book and the links between them.

    Coordinates are a hash of the name within +-1500, the same on every run and executor.
    """
    active = nodes.filter("count > 1")
    fields = [
        F.col("id"), F.lit("text").alias("type"),
        F.concat(F.lit("### "), "name", F.lit("\n"), F.col("count").cast("string"), F.lit(" books in library")).alias("text")]
    if coordinates:
        fields += [(F.pmod(F.xxhash64("name"), F.lit(3001)) - 1500).alias("x"), (F.pmod(F.xxhash64("name", F.lit("y")), F.lit(3001)) - 1500).alias("y")]
    fields += [F.lit(250).alias("width"), F.lit(100).alias("height")]
    node_rows = active.select(F.lit("node").alias("kind"), "id", F.to_json(F.struct(*fields)).alias("json"))
    ids = active.select("id")
    kept = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    edge = F.struct(F.col("source").alias("fromNode"), F.col("target").alias("toNode"),
                    F.concat(F.col("value").cast("string"), F.lit(" collaborations")).alias("label"))
    return node_rows.unionByName(kept.select(F.lit("edge").alias("kind"), F.concat_ws("|", "source", "target").alias("id"), F.to_json(edge).alias("json")))


def active_occurrences(occurrences: DataFrame) -> DataFrame:
    """Occurrences (id, canon, n) of authors with more than one book. No other author has a link on the canvas, so the
    pairs of the others need not be made."""
    active = occurrences.groupBy("canon").agg(F.sum("n").alias("_books")).filter("_books > 1").select("canon")
    return occurrences.join(active, "canon", "left_semi")


def bibtex_key(author, title):
    """First word of the author plus first title word of more than three characters, else ``Book``."""
    def words(c):
        return F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("Unknown")), r"[^\p{L}\p{N} ]", ""), " "), lambda w: w != "")

    long_words = F.filter(words(title), lambda w: F.length(w) > 3)
    return F.concat(F.coalesce(F.get(words(author), F.lit(0)), F.lit("")), F.coalesce(F.get(long_words, F.lit(0)), F.lit("Book")))


def export_bibliography(books: DataFrame) -> DataFrame:
    """(id, key, entry, same_key) for books(id, title, author, year, publisher, filename)."""
    def blank(c, default):
        return F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", default).otherwise(F.col(c).cast("string"))

    author, title = blank("author", "Unknown"), blank("title", "Unknown")
    entry = F.format_string(
        "@book{%s,\n  author    = {%s},\n  title     = {%s},\n  year      = {%s},\n  publisher = {%s},\n  note      = {File: %s}\n}",
        F.col("key"), author, title, blank("year", "20XX"), blank("publisher", "Unknown"), F.col("filename"))
    keyed = books.withColumn("key", bibtex_key(author, title))
    return with_key_count(keyed.select("id", "key", entry.alias("entry")), ["key"], "same_key")


def write_bibliography(exported: DataFrame, path: str) -> None:
    exported.select("entry").write.mode("overwrite").text(path)
