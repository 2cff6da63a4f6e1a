"""Deduplication and merging of catalogue rows, terms and concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliospark.functions import text as tx
from bibliospark.operators.blocking import rare_key_pairs, substring_keys, text_keys
from bibliospark.operators.blockpairs import matching_pairs
from bibliospark.operators.quality import ai_chatter, toc_artifact
from bibliospark.partitioning import first_per_key
from bibliospark.session import cut_lineage

# The folder whose copies lose against any other, and its penalty.
UNSORTED = "99_General_and_Diverse/Unsorted"
UNSORTED_PENALTY = 1000

# Name beginnings that mark a concept as a numbered statement.
DIRTY_PREFIXES = ["Theorem", "Lemma", "Proposition", "Corollary", "Definition", "Example", "Remark"]


def content_hash(books: DataFrame) -> DataFrame:
    """SHA-256 of the content where the hash is missing: books(id, content, file_hash)."""
    return books.select("id", F.coalesce("file_hash", F.sha2("content", 256)).alias("file_hash"))


def survivor_rank(path: str | Column = "path") -> Column:
    path = tx.column(path)
    return F.when(F.contains(path, F.lit(UNSORTED)), UNSORTED_PENALTY).otherwise(0) + F.length(path)


def duplicate_key(name: str) -> Column:
    """Comparable value of an identifier column; null where it identifies nothing."""
    empty = F.col(name).isNull() | (F.col(name) == "")
    if name == "doi":
        empty = empty | (F.col(name) == "Unknown")
    return F.when(~empty, F.col(name))


def duplicate_groups(books: DataFrame, key: str) -> DataFrame:
    """(key, id, survivor, n) for every row of a group of more than one: books(id, path, <key>).

    Size and survivor of a group come from one aggregate that is combined before the shuffle.
    """
    rows = books.select("id", duplicate_key(key).alias("key"), F.struct(survivor_rank().alias("rank"), F.col("id")).alias("_order")).filter("key IS NOT NULL")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("_order").alias("_best")).filter("n > 1").select("key", "n", F.col("_best.id").alias("survivor"))
    return rows.select("id", "key").join(groups, "key")


def duplicate_report(books: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of all identifier columns: (kind, key, id, survivor, n), from one scan, one aggregate and one join."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), duplicate_key(k).cast("string").alias("key")) for k in keys])).alias("_k")
    rows = books.select("id", F.struct(survivor_rank().alias("rank"), F.col("id")).alias("_order"), each).select("id", "_order", "_k.*").filter("key IS NOT NULL")
    groups = rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("_order").alias("_best")).filter("n > 1")
    return rows.select("id", "kind", "key").join(groups.select("kind", "key", "n", F.col("_best.id").alias("survivor")), ["kind", "key"])


def duplicate_resolve(books: DataFrame, listing: DataFrame, keys: list[str]) -> DataFrame:
    """(id, removed_by): missing files go first, then each key removes redundant rows of what is left.

    The removed ids of a key are checkpointed before the next key looks at the rest.
    """
    rows = books.select("id", "path", *keys)
    removed = rows.join(listing.select("path"), "path", "left_anti").select("id", F.lit("missing").alias("removed_by"))
    left = rows.join(listing.select("path"), "path", "left_semi")
    for key in keys:
        gone = cut_lineage(duplicate_groups(left, key).filter("id <> survivor").select("id", F.lit(key).alias("removed_by")))
        removed = removed.unionByName(gone)
        left = left.join(gone, "id", "left_anti")
    return removed


def tagged(keys: Column, tag: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(tag), k))


def title_author_pairs(needles: DataFrame, texts: DataFrame, title_keys=text_keys) -> DataFrame:
    """(needle_id, text_id) where the title holds the needle title and the author holds the needle author, if any.

    needles(needle_id, title, author), texts(text_id, title, author), all lower case. Blocked on the rarest gram of
    title and author together; ``title_keys`` may leave out the short grams when no needle title is short.
    """
    def both(title: Column, author: Column) -> Column:
        return F.concat(tagged(F.coalesce(title, F.array().cast("array<string>")), "t"), tagged(F.coalesce(author, F.array().cast("array<string>")), "a"))

    pairs = rare_key_pairs(needles, texts, both(substring_keys("title"), substring_keys("author")), both(title_keys("title"), text_keys("author")))
    n = needles.select("needle_id", F.col("title").alias("_nt"), F.col("author").alias("_na"))
    return pairs.join(n, "needle_id").join(texts, "text_id").filter(
        F.contains("title", F.col("_nt")) & (F.coalesce("_na", F.lit("")).eqNullSafe("") | F.contains("author", F.col("_na")))).select("needle_id", "text_id")


def incoming_duplicate(incoming: DataFrame, catalogue: DataFrame, ignore_unsorted: bool = False) -> DataFrame:
    """(id, kind, match_id): HASH for known content, else SEMANTIC for first title word (over 4 letters) plus author.

    incoming(id, hash, title, author), catalogue(id, path, hash, title, author). The lowest catalogue id is reported.
    """
    stored = catalogue.filter(~F.contains("path", F.lit(UNSORTED))) if ignore_unsorted else catalogue
    by_hash = stored.filter("hash IS NOT NULL").groupBy("hash").agg(F.min("id").alias("match_id"))
    rows = incoming.join(by_hash, "hash", "left")
    hashed = rows.filter("match_id IS NOT NULL").select("id", F.lit("HASH").alias("kind"), "match_id")
    word = F.get(F.filter(F.split(F.replace(F.lower("title"), F.lit(":"), F.lit("")), r"\s+"), lambda w: w != ""), F.lit(0))
    # Read by the blocking, the verification and the answer: kept once instead of repeating the hash join.
    open_rows = cut_lineage(
        rows.filter("match_id IS NULL").select("id", word.alias("_w"), F.lower(F.coalesce("author", F.lit(""))).alias("_a")).filter(F.length("_w") > 4))
    needles = open_rows.select(F.struct("_w", "_a").alias("needle_id"), F.col("_w").alias("title"), F.col("_a").alias("author")).distinct()
    texts = catalogue.groupBy(F.lower("title").alias("title"), F.lower(F.coalesce("author", F.lit(""))).alias("author")).agg(F.min("id").alias("text_id"))
    first = title_author_pairs(needles, texts, lambda title: tx.grams(title, 3)).groupBy("needle_id").agg(F.min("text_id").alias("match_id")).select("needle_id.*", "match_id")
    semantic = open_rows.join(first, ["_w", "_a"]).select("id", F.lit("SEMANTIC").alias("kind"), "match_id")
    return hashed.unionByName(semantic)


def near_dup_pairs(terms: DataFrame, pages_apart: int = 5, length_gap: float = 0.3, least: float = 85.0) -> DataFrame:
    """(id_a, id_b, similarity, copies_a, copies_b, is_copy): similar bodies at most 5 pages apart in one book, a before b in (page, id).

    terms(id, book_id, page, latex). Equal bodies on the same page are one text with its number of copies, and every
    copy has a pair with the first of them, so n copies make n - 1 rows and not n squared.
    """
    rows = terms.filter("latex <> ''").select("id", "book_id", F.col("page").cast("long").alias("page"), F.col("latex").alias("text"), F.md5("latex").alias("_h"))
    firsts = rows.groupBy("book_id", "page", "_h").agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("copies"))
    # One row per distinct body, read four times below.
    reps = cut_lineage(
        rows.groupBy("book_id", "page", "_h").agg(F.min("id").alias("id"), F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies")))
    width = pages_apart + 1
    bucket = F.floor(F.col("page") / width).cast("long")
    band = F.floor(F.log(F.length("text")) / -F.log(F.lit(1 - length_gap))).cast("int")
    left = reps.select("id", F.col("page").alias("place"), "text", "book_id", bucket.alias("_bucket"), band.alias("_band"))
    right = reps.select(
        "id", F.col("page").alias("place"), "text", "book_id", F.explode(F.array(bucket, bucket - 1)).alias("_bucket"), F.array(band - 1, band, band + 1).alias("_bands")
    ).select("id", "place", "text", "book_id", "_bucket", F.explode("_bands").alias("_band"))
    scored = matching_pairs(left, right, ["book_id", "_bucket", "_band"], "sequence", least, length_gap, apart=pages_apart)
    place = reps.select("id", "page", "copies")
    a, b = [place.select(F.col("id").alias(f"id_{x}"), F.col("page").alias(f"page_{x}"), F.col("copies").alias(f"copies_{x}")) for x in "ab"]
    pairs = scored.withColumnsRenamed({"left_id": "id_a", "right_id": "id_b", "score": "similarity"}).join(a, "id_a").join(b, "id_b")
    later = (F.col("page_b") > F.col("page_a")) | ((F.col("page_b") == F.col("page_a")) & (F.col("id_b") > F.col("id_a")))
    pairs = pairs.filter(later & (F.col("page_b") - F.col("page_a") <= pages_apart)).select("id_a", "id_b", "similarity", "copies_a", "copies_b", F.lit(0).alias("is_copy"))
    copies = rows.join(firsts.filter("copies > 1"), ["book_id", "page", "_h"]).filter("id <> _first").select(
        F.col("_first").alias("id_a"), F.col("id").alias("id_b"), F.lit(100.0).alias("similarity"), F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"), F.lit(1).alias("is_copy"))
    return pairs.unionByName(copies)


def near_dup_delete(pairs: DataFrame) -> DataFrame:
    """(id) removed by the greedy rule: in (page, id) order, a kept row removes its later similar rows, a removed one does nothing.

    Works in rounds over the edges of all books at once: rows without an earlier open neighbour are kept and remove
    theirs; edges of decided rows fall away. Every round is checkpointed, so its cost is that of the open edges. Copies
    always go: what removes the first of them is as similar to the others, and a kept first removes them itself.
    """
    pairs = cut_lineage(pairs.select("id_a", "id_b", "is_copy").distinct())
    removed = pairs.filter("is_copy = 1").select(F.col("id_b").alias("id"))
    edges = pairs.filter("is_copy = 0").select("id_a", "id_b")
    while not edges.isEmpty():
        kept = edges.select("id_a").distinct().join(edges.select(F.col("id_b").alias("id_a")), "id_a", "left_anti")
        gone = cut_lineage(edges.join(kept, "id_a", "left_semi").select(F.col("id_b").alias("id")).distinct())
        removed = removed.unionByName(gone)
        edges = cut_lineage(
            edges.join(gone.withColumnRenamed("id", "id_a"), "id_a", "left_anti").join(gone.withColumnRenamed("id", "id_b"), "id_b", "left_anti"))
    return removed


def acceptable_terms(terms: DataFrame) -> DataFrame:
    """Extracted terms that are no loose proofs, contents entries or assistant talk: terms(name, kind, latex, ...)."""
    name, kind = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("kind", F.lit("")))
    return terms.filter((name != "") & (kind != "proof") & ~name.startswith("proof of") & ~toc_artifact("latex") & ~ai_chatter("latex"))


def term_insert_filter(terms: DataFrame, existing: DataFrame) -> DataFrame:
    """New terms (id, book_id, page, name, kind, latex) worth inserting beside existing(id, book_id, page, name, latex).

    Out go unacceptable terms, names already on the page, repeated names in the batch, and bodies of more than 50
    characters more than 85 alike to a body within one page; bodies are compared whole.
    """
    fresh = acceptable_terms(terms).withColumn("_name", F.lower("name"))
    named = existing.select("book_id", "page", F.lower("name").alias("_name"))
    fresh = fresh.join(named, ["book_id", "page", "_name"], "left_anti")
    firsts = fresh.groupBy("book_id", "page", "_name").agg(F.min("id").alias("id")).select("id")
    fresh = fresh.join(firsts, "id", "left_semi")
    left = fresh.filter(F.length("latex") > 50).select("id", F.col("latex").alias("text"), "book_id", F.col("page").cast("long").alias("page"))
    right = existing.filter("latex <> ''").select("id", F.col("latex").alias("text"), "book_id", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page"))
    alike = matching_pairs(left, right, ["book_id", "page"], "indel", 85.0).select(F.col("left_id").alias("id"))
    return fresh.join(alike, "id", "left_anti").drop("_name")


def term_insert_by_name(terms: DataFrame, existing: DataFrame) -> DataFrame:
    """Second-pass rule: one term per (book, name ignoring case), first id wins, known names out."""
    fresh = terms.withColumn("_name", F.lower("name")).join(existing.select("book_id", F.lower("name").alias("_name")), ["book_id", "_name"], "left_anti")
    return first_per_key(fresh, ["book_id", "_name"], "id").drop("_name")


def clean_concept_name(name: str | Column) -> Column:
    """Statement label and number in front of a concept name removed."""
    out = F.regexp_replace(name, r"^(" + "|".join(DIRTY_PREFIXES) + r")\s+[0-9.]*\s*[:.]?\s*", "")
    return tx.strip(F.regexp_replace(out, r"^[0-9][0-9.]*\s*[:.]?\s*", ""))


def concept_merge(concepts: DataFrame) -> DataFrame:
    """(id, survivor, new_name): clusters of cleaned (name, subject) that hold a dirty name; concepts(id, name, subject_area).

    The survivor is the lowest id already named exactly like the key, else the lowest id. ``new_name`` is set on
    survivors to be renamed.
    """
    lower = F.lower("name")
    dirty = F.contains("name", F.lit(":")) | lower.rlike(r"^(" + "|".join(p.lower() for p in DIRTY_PREFIXES) + ") ") | F.col("name").rlike(r"^[1-9]\.")
    clean = F.when(dirty, clean_concept_name("name")).otherwise(F.col("name"))
    rows = concepts.select("id", "name", "subject_area", dirty.alias("_dirty"), clean.alias("_clean")).withColumn("_key", F.lower(tx.strip("_clean")))
    clusters = rows.groupBy("_key", "subject_area").agg(
        F.bool_or("_dirty").alias("_any"), F.coalesce(F.min(F.when(F.col("name") == F.col("_key"), F.col("id"))), F.min("id")).alias("survivor")).filter("_any")
    joined = rows.join(clusters, ["_key", "subject_area"])
    rename = (F.col("id") == F.col("survivor")) & F.col("_dirty") & (F.col("_clean") != F.col("name"))
    return joined.select("id", "survivor", F.when(rename, F.col("_clean")).alias("new_name"))


def repoint(terms: DataFrame, merged: DataFrame) -> DataFrame:
    """Terms whose concept was merged away point to the survivor."""
    moved = merged.filter("id <> survivor").select(F.col("id").alias("concept_id"), "survivor")
    joined = terms.join(moved, "concept_id", "left")
    return joined.withColumn("concept_id", F.coalesce("survivor", "concept_id")).drop("survivor")


def ingest_concepts(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Glossary rows (id, name, subject_area, summary): citation marks out, too short ones out, first of each (name, subject) wins."""
    clean = rows.select("id", tx.strip("name").alias("name"), "subject_area", F.regexp_replace(tx.strip("summary"), r"\[\d+\]", "").alias("summary"))
    kept = clean.filter((F.length("name") > 1) & (F.length("summary") > 5)).join(existing.select("name", "subject_area"), ["name", "subject_area"], "left_anti")
    return first_per_key(kept, ["name", "subject_area"], "id")
