"""Quality rules with cross-document line frequency. DataFrame functions only.

A line is normalised (lower case, digits to 0, white space squeezed) and hashed. Per host (source) the distinct documents
that hold a line are counted; equal texts are one document, so copies of a text do not turn its lines into boilerplate.
A line goes when more than ``most_docs`` documents and more than the share ``most_share`` of the documents of its host
hold it, or, so that a hot host does not lift the limit out of reach, when it has ``LONG`` words and more than ``ENOUGH``
documents of its host hold it, whatever their share. A document is rejected when a base rule fails or when fewer than ``least_kept`` of its words are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliospark.functions.text import let
from bibliospark.llm.mixing import source_key

SPACES = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"
MOST_DOCS, MOST_SHARE, LEAST_KEPT = 20, 0.02, 0.3
ENOUGH, LONG = 500, 4


def words(text: Column) -> Column:
    return let(F.btrim(text, F.lit(WHITE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES)))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")


def repeated_words(found: Column) -> Column:
    """Words inside windows of three words that occur twice or more, the first occurrence included."""

    def of(hashes: Column) -> Column:  # (hash, place) in order of hash: equal neighbours repeat
        def places(pairs: Column) -> Column:
            at = lambda i: F.get(pairs, i)["h"]
            again = F.filter(pairs, lambda x, i: F.coalesce(at(i - 1) == x["h"], F.lit(False)) | F.coalesce(at(i + 1) == x["h"], F.lit(False)))
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(p, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")))["n"]

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # the first pass only tells whether any window repeats: most texts of few words have none
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, lambda s: let(places(s), covered)))

    windows = F.when(F.size(found) >= 3, F.transform(F.sequence(F.lit(0), F.size(found) - 3), lambda i: F.xxhash64(
        F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)))).otherwise(F.array().cast("array<long>"))
    return let(windows, of)


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""

    def of(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            F.aggregate(found, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(found).alias("n_repeat_words"))

    return let(words(text), of)


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(line, F.lit(WHITE))), r"\d", "0"), SPACES, " ")


def line_rows(documents: DataFrame) -> DataFrame:
    """(_row, _source, _line, _n, _first): a row per line with a word; _n its words, _first marks one line of a row."""
    row = F.xxhash64("doc_id", "text", "source")
    lines = documents.select(row.alias("_row"), source_key("source").alias("_source"), F.xxhash64("text").alias("_text"),
                             F.posexplode(lines_with_words(F.coalesce("text", F.lit("")))).alias("_at", "_raw"))
    return lines.select("_row", "_source", "_text", F.xxhash64(normal_line(F.col("_raw"))).alias("_line"),
                        F.size(words(F.col("_raw"))).cast("long").alias("_n"), (F.col("_at") == 0).cast("long").alias("_first"))


def frequent_lines(documents: DataFrame, most_docs: int, most_share: float) -> DataFrame:
    """(_source, _line) above both limits, or long and in ``ENOUGH`` documents. Counts are of distinct texts per host, pre-aggregated before the exchange."""
    texts = documents.filter("text is not null").select(source_key("source").alias("_source"), F.xxhash64("text").alias("_text"))
    hosts = texts.groupBy("_source").agg(F.countDistinct("_text").alias("_docs"))
    lines = line_rows(documents).select("_source", "_line", "_text", "_n").distinct()
    counts = lines.groupBy("_source", "_line").agg(F.count(F.lit(1)).alias("_held"), F.max("_n").alias("_n")).filter(F.col("_held") > most_docs)
    enough = (F.col("_held") > ENOUGH) & (F.col("_n") >= LONG)
    return counts.join(hosts, "_source").filter(enough | (F.col("_held") > F.col("_docs") * most_share)).select("_source", "_line")


def judged(documents: DataFrame, most_docs: int = MOST_DOCS, most_share: float = MOST_SHARE, least_kept: float = LEAST_KEPT) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left, kept.

    n_left counts the words outside of removed lines. Null texts have no words, so they fail the base rule; a null source
    is a host of its own. Repeated rows are judged alike and are one document of their host; other columns are ignored.
    """
    base = documents.select("doc_id", F.xxhash64("doc_id", "text", "source").alias("_row"), base_counts(F.coalesce("text", F.lit(""))).alias("b")).select("doc_id", "_row", "b.*")
    gone = line_rows(documents).join(frequent_lines(documents, most_docs, most_share).withColumn("_gone", F.lit(1)), ["_source", "_line"], "left")
    lost = gone.groupBy("_row").agg(F.sum(F.when(F.col("_gone") == 1, F.col("_n"))).alias("_lost"), F.sum("_first").alias("_rows"))
    lost = lost.filter("_lost > 0").select("_row", F.expr("_lost div _rows").alias("_lost"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("_lost", F.lit(0))
    return base.join(lost, "_row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), left.alias("n_left"),
        (~failed & (left >= F.col("n_words") * least_kept)).alias("kept"))


def cleaned(documents: DataFrame, most_docs: int = MOST_DOCS, most_share: float = MOST_SHARE, least_kept: float = LEAST_KEPT) -> DataFrame:
    """The kept documents' (doc_id, text), texts without the removed lines; lines without a word stay where they are."""
    row = F.xxhash64("doc_id", "text", "source")
    gone = line_rows(documents).join(frequent_lines(documents, most_docs, most_share), ["_source", "_line"], "left_semi").groupBy("_row").agg(F.collect_set("_line").alias("_gone"))
    counts = documents.select("doc_id", "text", row.alias("_row"), base_counts(F.coalesce("text", F.lit(""))).alias("b")).join(gone, "_row", "left")
    stays = lambda line: (F.btrim(line, F.lit(WHITE)) == "") | ~F.array_contains("_gone", F.xxhash64(normal_line(line)))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", F.filter(F.split("text", "\n"), stays)))
    left = counts.withColumn("text", text).withColumn("_left", F.size(words(F.coalesce("text", F.lit("")))))
    failed = (F.col("b.n_words") < 50) | (100 * F.col("b.n_repeat_words") > 50 * F.col("b.n_words"))
    return left.filter(~failed & (F.col("_left") >= F.col("b.n_words") * least_kept)).select("doc_id", "text")
