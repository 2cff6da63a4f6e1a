"""Catalogue filters, work lists and row rewrites (single-pass projections and filters wherever possible)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliospark.functions.text import strip

# The kinds of a knowledge term.
VALID_KINDS = ["definition", "theorem", "lemma", "proposition", "corollary", "example", "exercise", "axiom", "notation"]

# Name fragments of index entries stored as terms.
INDEX_ARTIFACTS = ["(Subject Index)", "(Name Index)", "(Symbol Index)", "(Index)", ", Page ", "(Page "]

# Catalogue fields a metadata patch may set.
PATCHABLE = ["title", "author", "publisher", "year", "isbn", "msc_class", "summary", "tags", "description", "level",
             "audience"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_ci(column: str | Column, needle: str) -> Column:
    """Case-insensitive substring test."""
    column = F.col(column) if isinstance(column, str) else column
    return F.contains(F.lower(column), F.lit(needle.lower()))


def browse_catalog(books: DataFrame, author=None, msc=None, year=None, keyword=None, limit: int = 100) -> DataFrame:
    """Metadata filters over (title, author, year, msc_class, summary, tags, id), newest first."""
    if author:
        books = books.filter(F.col("author").ilike("%" + "%".join(author.split()) + "%"))
    if msc:
        codes = [m.strip() for m in msc.split(",")]
        books = books.filter(any_of([F.col("msc_class").ilike(p) for m in codes for p in (f"{m}%", f"%, {m}%")]))
    if year:
        text = F.col("year").cast("string")
        books = books.filter(text.startswith(year) if len(year) == 3 else text == year)
    if keyword:
        books = books.filter(any_of([contains_ci(c, keyword) for c in ("title", "summary", "tags")]))
    return books.orderBy(F.col("year").desc(), "id").limit(limit)


def select_terms(terms: DataFrame, letter=None, kind=None, status="approved") -> DataFrame:
    if status:
        terms = terms.filter(F.col("status") == status)
    if letter and len(letter) == 1 and letter.isalpha():
        terms = terms.filter(F.upper(F.substring("name", 1, 1)) == letter.upper())
    if kind in VALID_KINDS:
        terms = terms.filter(F.col("kind") == kind)
    return terms


def browse_terms_page(terms, books, concepts, letter=None, kind=None, status="approved", sort="alpha", limit=500,
                      offset=0) -> DataFrame:
    """One page of terms with book title and concept name; books(book_id, title), concepts(concept_id, concept_name)."""
    chosen = select_terms(terms, letter, kind, status)
    order = [F.col("created_at").desc()] if sort == "newest" else [F.col("name")]
    return (
        chosen.join(books, "book_id").join(concepts, "concept_id", "left")
        .orderBy(*order, "id").offset(offset).limit(limit)
    )


def browse_terms_total(terms, letter=None, kind=None, status="approved") -> DataFrame:
    return select_terms(terms, letter, kind, status).agg(F.count(F.lit(1)).alias("total"))


def browse_terms_letters(terms, letter=None, kind=None, status="approved") -> DataFrame:
    return (
        select_terms(terms, letter, kind, status)
        .groupBy(F.upper(F.substring("name", 1, 1)).alias("letter")).agg(F.count(F.lit(1)).alias("cnt"))
    )


def list_notes(notes: DataFrame, source_type=None, book_id=None, sort="newest", limit=50) -> DataFrame:
    """Notes (id, title, source_type, book_id, created_at) filtered, sorted and limited."""
    if source_type:
        notes = notes.filter(F.col("source_type") == source_type)
    if book_id is not None:
        notes = notes.filter(F.col("book_id") == book_id)
    order = {"newest": F.col("created_at").desc(), "oldest": F.col("created_at").asc(),
             "alphabetical": F.lower("title").asc()}[sort]
    return notes.orderBy(order, "id").limit(limit)


def bookmarks_with_book(bookmarks: DataFrame, books: DataFrame, book_id=None, tag=None) -> DataFrame:
    if book_id is not None:
        bookmarks = bookmarks.filter(F.col("book_id") == book_id)
    if tag:
        bookmarks = bookmarks.filter(contains_ci("tags", tag))
    return bookmarks.join(books, "book_id")


def pages_of_range(page_range: str | Column, total: str | Column) -> Column:
    """'1-5, 10' to the sorted distinct pages within 1..total; unreadable parts are skipped."""
    page_range = F.col(page_range) if isinstance(page_range, str) else page_range
    total = F.col(total) if isinstance(total, str) else total

    def expand(part: Column) -> Column:
        low = F.regexp_extract(part, r"^\s*(\d{1,9})\s*(-\s*\d{1,9}\s*)?$", 1).try_cast("int")
        high = F.regexp_extract(part, r"^\s*\d{1,9}\s*-\s*(\d{1,9})\s*$", 1).try_cast("int")
        first = F.greatest(F.lit(1), low)
        last = F.least(F.coalesce(high, low), total.cast("int"))
        return F.when(low.isNotNull() & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(page_range, ","), expand)))).cast("array<bigint>")


def bookmark_pages(bookmarks: DataFrame, pages: DataFrame) -> DataFrame:
    """bookmarks(id, book_id, page_range, total) exploded and joined to pages(book_id, page, content)."""
    wanted = bookmarks.select("id", "book_id", F.explode(pages_of_range("page_range", "total")).alias("page"))
    return wanted.join(pages, ["book_id", "page"])


def page_work_list(ranges: DataFrame, done: DataFrame, mode: str) -> DataFrame:
    """Pages to process per book: ranges(book_id, start, end), done(book_id, page, status, harvested)."""
    wanted = ranges.filter("start <= end").select("book_id", F.explode(F.sequence("start", "end")).alias("page"))
    if mode == "missing":
        return wanted.join(done.filter("status = 'ok'"), ["book_id", "page"], "left_anti")
    if mode == "failed":
        return wanted.join(done.filter("status = 'failed'"), ["book_id", "page"], "left_semi")
    if mode == "unharvested":
        return wanted.join(done.filter("status = 'ok' AND NOT harvested"), ["book_id", "page"], "left_semi")
    raise ValueError(f"unknown mode {mode}")


def enrich_candidates(books: DataFrame, limit: int | None = None, after_id: int | None = None) -> DataFrame:
    """Raw or unset metadata with a usable title, in id order; ``after_id`` continues a sweep."""
    usable = F.col("title").isNotNull() & ~F.lower("title").isin("unknown", "untitled", "")
    rows = books.filter((F.col("metadata_status").isNull() | (F.col("metadata_status") == "raw")) & usable)
    if after_id is not None:
        rows = rows.filter(F.col("id") > after_id)
    return rows if limit is None else rows.orderBy("id").limit(limit)


def prose_repair_candidates(terms: DataFrame) -> DataFrame:
    """Bodies (latex) that hold prose words outside a text macro and were not tried before (attempted)."""
    prose = any_of([contains_ci("latex", w) for w in (" is ", " the ", " of ")])
    return terms.filter(prose & ~F.contains("latex", F.lit(r"\text{")) & (F.coalesce("attempted", F.lit(0)) == 0))


def index_artifact_terms(terms: DataFrame) -> DataFrame:
    """Terms whose name is an index entry; an id once, whatever number of fragments it holds."""
    return terms.filter(any_of([contains_ci("name", f) for f in INDEX_ARTIFACTS])).dropDuplicates(["id"])


def corrupted_pages(terms: DataFrame) -> DataFrame:
    """(book_id, page) with a body that still holds a raw ``### `` header, and how many bodies."""
    return terms.filter(F.contains("latex", F.lit("### "))).groupBy("book_id", "page").agg(F.count(F.lit(1)).alias("bad_terms"))


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def metadata_cleanup(books: DataFrame) -> DataFrame:
    """Repair of (title, author, description, path) in the order: split, cut, series, empty."""
    parts = F.split("title", " - ")
    missing_author = F.col("author").isNull() | F.col("author").isin("", "Unknown")
    can_split = missing_author & (F.size(parts) >= 2)
    split_title = strip(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " - "))
    step = books.withColumn("_t", F.when(can_split, split_title).otherwise(F.col("title"))).withColumn(
        "author", F.when(can_split, strip(F.element_at(parts, -1))).otherwise(F.col("author")))
    short = strip(F.substring_index(F.substring_index("_t", ". ", 1), ": ", 1))
    short = F.when(F.length(short) > 150, F.concat(F.substring(short, 1, 147), F.lit("..."))).otherwise(short)
    step = step.withColumn("_cut", F.when(F.length("_t") > 150, short).otherwise(F.col("_t")))
    step = step.withColumn(
        "description",
        F.when(F.col("_cut") != F.col("_t"),
               F.concat(F.coalesce("description", F.lit("")), F.lit("\nOriginal Title: "), F.col("_t")))
        .otherwise(F.col("description")))
    series = contains_ci("_cut", "Mathematics Series") & (F.length("_cut") < 50)
    empty = F.col("_cut").isNull() | (F.col("_cut") == "")
    return step.withColumn("title", F.when(series | empty, file_stem(F.col("path"))).otherwise(F.col("_cut"))).drop("_t", "_cut")


def metadata_patch(books: DataFrame, patch: DataFrame) -> DataFrame:
    """Sparse update: patch(id, field, value) long format; a listed field is set even when its value is null."""
    fields = [f for f in PATCHABLE if f in books.columns]
    wide = patch.filter(F.col("field").isin(fields)).groupBy("id").agg(
        *[F.max(F.when(F.col("field") == f, F.struct(F.lit(True).alias("set"), F.col("value")))).alias(f"_{f}") for f in fields])
    joined = books.join(wide, "id", "left")
    kept = [
        F.when(F.col(f"_{c}.set"), F.col(f"_{c}.value").cast(books.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in fields else F.col(c) for c in books.columns]
    return joined.select(*kept)


def clear_index(books: DataFrame, ids: DataFrame) -> DataFrame:
    """Empty index text and version of the listed books so that the next scan redoes them."""
    hit = books.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return hit.select(*[F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)).alias(c)
                        if c in ("index_text", "index_version") else F.col(c) for c in books.columns])


def conflict_resolution(books: DataFrame, decisions: DataFrame, registry: DataFrame) -> DataFrame:
    """decisions(id, action): accept takes the registry title, reject drops the link; others pass through."""
    rows = books.join(decisions, "id", "left").join(registry, "zbl_id", "left")
    accept = (F.col("action") == "accept") & F.col("zb_title").isNotNull()
    reject = F.col("action") == "reject"
    return rows.select(
        "id",
        F.when(accept, F.col("zb_title")).otherwise(F.col("title")).alias("title"),
        F.when(accept, "verified").when(reject, "raw").otherwise(F.col("metadata_status")).alias("metadata_status"),
        F.when(reject, F.lit(None)).otherwise(F.col("zbl_id")).alias("zbl_id"),
        F.when(reject, 0.0).otherwise(F.col("trust_score")).alias("trust_score"),
    )
