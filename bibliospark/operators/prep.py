"""Text preparation: embedding strings, chunking, and tables parsed from extraction output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliospark.functions import text as tx
from bibliospark.functions.latex import environment_dropper
from bibliospark.functions.markup import text_of_html
from bibliospark.partitioning import top_per_key, with_key_count

# Display environments masked before embedding.
DISPLAY_ENVS = ["equation", "equation*", "align", "align*", "aligned", "gather", "gather*"]
EQUATION = " [EQUATION] "

# Section names that are no terms.
SECTION_NAMES = ["contents", "index", "bibliography", "preface", "notation", "dedication", "acknowledgements", "table of contents"]

CHUNK = 8000


def mask_display_math(latex: Column) -> Column:
    """The flat part of the masking: closed proofs of the plain style, $$ $$ and \\[ \\].

    Nothing after the last closing mark is searched: there each opening mark would be followed to the end of the text.
    """
    def closed(text: Column, close: str, pattern: str, by: str) -> Column:
        def replaced(parts: Column) -> Column:
            rest = F.substring_index(parts, close, -1)
            head = F.substring(parts, F.lit(1), F.length(parts) - F.length(rest))
            return F.concat(F.regexp_replace(head, pattern, by), rest)

        return tx.let(text, replaced)

    out = closed(latex, r"\blacksquare", r"(?s)Proof\..*?\\blacksquare", "")
    out = F.regexp_replace(out, r"(?s)\$\$.*?\$\$", EQUATION)
    return closed(out, r"\]", r"(?s)\\\[.*?\\\]", EQUATION)


def used_terms_text(used_terms: str | Column) -> Column:
    """JSON list as a comma list; other values as they are."""
    used_terms = F.coalesce(tx.column(used_terms), F.lit(""))
    return F.coalesce(F.array_join(F.from_json(used_terms, "array<string>"), ", "), used_terms)


def embedding_text_terms(terms: DataFrame) -> DataFrame:
    """(id, text) for terms(id, name, kind, latex, used_terms), read once; only bodies with environments to remove pass through Python."""
    latex = F.coalesce("latex", F.lit(""))
    rows = terms.select("id", "name", "kind", "used_terms", latex.alias("latex"))
    nested = F.contains("latex", F.lit(r"\begin{proof}"))
    for env in DISPLAY_ENVS:
        nested = nested | F.contains("latex", F.lit(f"\\begin{{{env}}}"))
    deep = rows.withColumn("_nested", nested)
    latex, if_nested = F.col("latex"), F.when(F.col("_nested"), F.col("latex"))
    deep = deep.withColumn("latex", F.coalesce(environment_dropper(["proof"], "")(if_nested), latex)).withColumn("latex", mask_display_math(latex))
    deep = deep.withColumn("latex", F.coalesce(environment_dropper(DISPLAY_ENVS, EQUATION)(if_nested), latex))
    statement = tx.squeeze("latex")
    return deep.select("id", F.concat(
        "name", F.lit(" (Type: "), "kind", F.lit("). Concepts: "), used_terms_text("used_terms"), F.lit(". Statement: "), statement).alias("text"))


def embedding_text_concepts(concepts: DataFrame, style: str = "sentence") -> DataFrame:
    """(id, text) in one of the two formats in use: "sentence" or "tagged"."""
    summary = F.coalesce("summary", F.lit(""))
    if style == "sentence":
        text = F.concat("name", F.lit(" (Subject: "), "subject_area", F.lit("). Summary: "), summary)
    else:
        text = F.concat(F.lit("[Name] "), "name", F.lit(" [Subject] "), "subject_area", F.lit(" [Summary] "), summary)
    return concepts.select("id", text.alias("text"))


def embedding_text_books(books: DataFrame, chapters: DataFrame, max_chapters: int | None = None, index_chars: int | None = None,
                         max_chars: int | None = None) -> DataFrame:
    """(id, text): labelled fields that are set, the chapters in page order, the index; each part cut only on request.

    The text of a book is one value, so it holds its contents list.
    """
    first = chapters.filter("title <> ''").select("book_id", "page", "id", "title")
    if max_chapters is not None:
        first = top_per_key(first, ["book_id"], max_chapters, "page", "id")
    listed = first.groupBy(F.col("book_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("page", "id", "title"))).alias("_c"))

    def labelled(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    titles = F.transform("_c", lambda c: F.concat(F.lit("- "), c["title"]))
    parts = F.concat_ws(
        "\n", labelled("Title: ", F.col("title")), labelled("Author: ", F.col("author")), labelled("MSC Classification: ", F.col("msc_class")),
        labelled("Summary: ", F.col("summary")), F.when(F.col("_c").isNotNull(), F.concat(F.lit("Chapters:\n"), F.array_join(titles, "\n"))),
        labelled("Index Keywords: ", F.col("index_text") if index_chars is None else F.substring("index_text", 1, index_chars)))
    return books.join(listed, "id", "left").select("id", (parts if max_chars is None else F.substring(parts, 1, max_chars)).alias("text"))


def missing_embeddings(rows: DataFrame, embedded: DataFrame) -> DataFrame:
    return rows.join(embedded.select("id"), "id", "left_anti")


def chunk_text(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(id, chunk_no, chunk): whole texts in pieces of ``size`` characters."""
    count = F.ceil(F.length("text") / size).cast("int")
    numbered = rows.filter("text <> ''").select("id", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    return numbered.select("id", "chunk_no", F.substring("text", F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"))


def html_to_chunks(pages: DataFrame, element_id: str | None = "bodyContent", size: int = CHUNK) -> DataFrame:
    """(id, chunk_no, chunk) of the readable text of pages(id, html)."""
    text = pages.select("id", text_of_html(element_id)("html").alias("text"))
    return chunk_text(text.withColumn("text", F.regexp_replace("text", r"\n{3,}", "\n\n")), size)


def unfenced(raw: Column) -> Column:
    """Output without its code fence."""
    body = F.when(raw.startswith("```"), F.regexp_replace(F.regexp_replace(raw, r"^```[^\n]*(\n|$)", ""), r"(^|\n)```[^\n]*$", "")).otherwise(raw)
    return tx.strip(body)


def term_rows_from_output(outputs: DataFrame) -> DataFrame:
    """Extraction outputs (book_id, page, raw) to (book_id, page, block_no, name, kind, used_terms, latex)."""
    header, keyword = r"(?m)^###\s+(.+?)\s*\(([^)]+)\)\s*$", r"(?m)^Keywords:\s*(.+)$"
    text = outputs.select("book_id", "page", unfenced(tx.strip("raw")).alias("_t")).filter(~F.contains("_t", F.lit("NO_TERMS_FOUND")))
    blocks = text.select("book_id", "page", F.posexplode(F.filter(F.transform(F.split("_t", r"(?m)(?=^###\s+)"), tx.strip), lambda b: b != "")).alias("block_no", "_b"))

    def after(pattern: str) -> Column:
        return F.substring(F.col("_b"), F.regexp_instr("_b", F.lit(pattern)) + F.length(F.regexp_extract("_b", pattern, 0)), F.length("_b"))

    has_keywords = F.col("_b").rlike(keyword)
    body = F.when(has_keywords, after(keyword)).otherwise(after(header))
    for noise in (r"(?i)Page \d+", r"(?i)Introduction to Modern Analysis", r"=== PAGE \d+ ==="):
        body = F.regexp_replace(body, noise, "")
    name = tx.strip(F.regexp_extract("_b", header, 1))
    terms = F.when(has_keywords, F.array_join(F.transform(F.split(F.regexp_extract("_b", keyword, 1), ","), tx.strip), ", ")).otherwise("")
    rows = blocks.filter(F.col("_b").rlike(header)).select(
        "book_id", "page", "block_no", name.alias("name"), F.lower(tx.strip(F.regexp_extract("_b", header, 2))).alias("kind"), terms.alias("used_terms"), tx.strip(body).alias("latex"))
    return rows.filter(~F.lower("name").isin(SECTION_NAMES) & (F.length("name") >= 3))


def batch_output_reconcile(outputs: DataFrame, requested: DataFrame) -> DataFrame:
    """(batch_id, page, latex, status): one row per requested page, filled from the batch output or listed as missing.

    outputs(batch_id, raw), requested(batch_id, page, position from 0). A block names its page or takes the one
    requested at its position; the first block for a page counts.
    """
    block = F.posexplode(F.regexp_extract_all("raw", F.lit(r"(?s)<page>(.*?)</page>"), F.lit(1)))
    blocks = outputs.select("batch_id", block.alias("position", "_b")).filter(F.col("_b").rlike(r"(?s)<latex>.*?</latex>"))
    named = F.regexp_replace(F.regexp_extract("_b", r"(?s)<pdf_page_idx>(.*?)</pdf_page_idx>", 1), r"\D", "").try_cast("long")
    latex = tx.strip(F.regexp_extract("_b", r"(?s)<latex>(.*?)</latex>", 1))
    latex = tx.strip(F.regexp_replace(F.regexp_replace(latex, r"^```latex", ""), r"```$", ""))
    rows = blocks.select("batch_id", "position", named.alias("_named"), latex.alias("latex"))
    by_name = requested.select("batch_id", F.col("page").alias("_named"), F.lit(True).alias("_asked"))
    by_place = requested.select("batch_id", "position", F.col("page").alias("_placed"))
    placed = rows.join(by_name, ["batch_id", "_named"], "left").join(by_place, ["batch_id", "position"], "left")
    page = F.when(F.col("_asked"), F.col("_named")).otherwise(F.col("_placed"))
    first = placed.withColumn("page", page).filter("page IS NOT NULL").groupBy("batch_id", "page").agg(F.min_by("latex", "position").alias("latex"))
    return requested.select("batch_id", "page").join(first, ["batch_id", "page"], "left").withColumn("status", F.when(F.col("latex").isNull(), "missing").otherwise("ok"))


def safe_name(text: str | Column, limit: int) -> Column:
    """Letters, digits, blanks, hyphens and underscores, cut to ``limit``."""
    return F.substring(tx.strip(F.regexp_replace(text, r"[^\p{L}\p{N} \-_]", "")), 1, limit)


def target_path_plan(books: DataFrame, default_folder: str = "99_General_and_Diverse/Unsorted") -> DataFrame:
    """(id, target, same_target): destination of every book and how many share it. books(id, title, author, folder, suffix)."""
    author = F.coalesce("author", F.lit("Unknown"))
    folder = F.when(F.coalesce("folder", F.lit("")) == "", default_folder).otherwise(F.col("folder"))
    target = F.concat(folder, F.lit("/"), safe_name(author, 50), F.lit(" - "), safe_name("title", 100), F.lower("suffix"))
    return with_key_count(books.select("id", target.alias("target")), ["target"], "same_target")


def note_file_name(text: str | Column, limit: int = 80) -> Column:
    """File name of a note: word characters, runs of blanks and hyphens as one underscore."""
    text = F.coalesce(tx.column(text), F.lit(""))
    kept = tx.strip(F.regexp_replace(text, r"[^\p{L}\p{N}_\s-]", ""))
    return F.when(text == "", "unnamed_note").otherwise(F.substring(F.regexp_replace(kept, r"[-\s]+", "_"), 1, limit))
