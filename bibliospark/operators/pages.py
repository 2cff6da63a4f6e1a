"""Page-sequence operators: windows, runs, alignment, patterns over neighbours, passage location, contents lists.

Pages are rows (book_id, page, content). A book may hold a third of all pages, so windows run over page buckets with
a halo and "the first/last n pages of a book" is a comparison with an aggregated bound, never a sort of a book.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliospark.functions import text as tx
from bibliospark.functions.passages import first_found, marker_position
from bibliospark.operators.blocking import containment_join
from bibliospark.partitioning import halo_buckets, rank_in_key, runs, spread, top_per_key

# Words that mark contents pages and bibliographies.
TOC_MARKERS = ["contents", "inhaltsverzeichnis", "inhalt", "table des matières"]
BIB_MARKERS = ["bibliography", "references", "literaturverzeichnis", "bibliographie"]


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def context_window(pages: DataFrame, before: int = 2, after: int = 4) -> DataFrame:
    """(book_id, page, context): pages p-before..p+after joined under page headers, for every page."""
    text = F.coalesce(F.replace("content", F.lit("\\n"), F.lit("\n")), F.concat(F.lit("% [Page "), F.col("page").cast("string"), F.lit(" LaTeX missing/failed]")))
    block = F.concat(F.lit("\n\n% --- PAGE "), F.col("page").cast("string"), F.lit(" ---\n\n"), text)
    frame = Window.partitionBy("book_id", "_bucket").orderBy("page").rangeBetween(-before, after)
    rows = halo_buckets(pages.select("book_id", "page", block.alias("_t")), "page", before, after)
    near = rows.withColumn("_near", F.array_sort(F.collect_list(F.struct("page", "_t")).over(frame))).filter("_own")
    return near.select("book_id", "page", F.array_join(F.col("_near._t"), "").alias("context"))


def contiguous_blocks(pages: DataFrame, bounds: DataFrame | None = None, shortest: int = 5, longest: int | None = None) -> DataFrame:
    """Next block of pending pages per book: pages(book_id, page, quality_score, harvested) -> block_start, block_end, n_pages.

    The first run of at least ``shortest`` consecutive pending pages, else the whole pending span; cut after ``longest`` more pages if set.
    """
    pending = pages.filter((F.col("quality_score").isNull() | (F.col("quality_score") >= 0.7)) & ~F.col("harvested"))
    if bounds is not None:
        pending = pending.join(bounds, "book_id", "left").filter(
            (F.col("page") >= F.coalesce("content_start", F.col("page"))) & (F.col("page") <= F.coalesce("content_end", F.col("page"))))
    pending = pending.select("book_id", "page").distinct()
    long_run = F.col("run_end") - F.col("run_start") + 1 >= shortest
    block = runs(pending, ["book_id"], "page").groupBy("book_id").agg(
        F.min(F.when(long_run, F.struct("run_start", "run_end"))).alias("_first"), F.min("run_start").alias("_lo"), F.max("run_end").alias("_hi")
    ).select("book_id", F.coalesce(F.col("_first.run_start"), "_lo").alias("block_start"), F.coalesce(F.col("_first.run_end"), "_hi").alias("_end"))
    end = F.col("_end") if longest is None else F.least("_end", F.col("block_start") + longest)
    block = block.select("book_id", "block_start", end.alias("block_end"))
    return pending.join(block, "book_id").filter("page BETWEEN block_start AND block_end").groupBy("book_id", "block_start", "block_end").agg(
        F.count(F.lit(1)).alias("n_pages"))


def printed_numbers(content: Column) -> Column:
    """Distinct 1-4 digit numbers standing alone in the first or last 100 characters."""
    pattern = F.lit(r"(?:^|[\s\.])(\d{1,4})(?:$|[\s\.])")
    ends = [F.regexp_extract_all(part, pattern, F.lit(1)) for part in (F.substring(content, 1, 100), F.right(content, F.lit(100)))]
    return F.array_distinct(F.concat(*ends))


def page_offset_align(pages: DataFrame, sample: int | None = None, votes: int = 4) -> DataFrame:
    """(book_id, page_offset, votes): most frequent page - printed number over all or the ``sample`` middle pages, if enough agree."""
    middle = pages.select("book_id", "page", printed_numbers(F.col("content")).alias("_p"))
    if sample is not None:
        ranked = rank_in_key(middle, ["book_id"], "page", "_rank")
        size = F.least(F.col("_rank_of"), F.lit(sample))
        start = F.greatest(F.lit(0), F.floor(F.col("_rank_of") / 2) - F.floor(size / 2))
        middle = ranked.filter((F.col("_rank") >= start) & (F.col("_rank") < start + size))
    offsets = middle.select("book_id", "page", F.explode("_p").alias("_s")).withColumn("_n", F.col("_s").cast("long")).filter("_n > 0 AND _n < 2000")
    counted = offsets.groupBy("book_id", (F.col("page") - F.col("_n")).alias("page_offset")).agg(F.count(F.lit(1)).alias("votes"))
    best = counted.groupBy("book_id").agg(F.max_by(F.struct("page_offset", "votes"), F.struct("votes", -F.abs("page_offset"), "page_offset")).alias("_b"))
    return best.select("book_id", "_b.*").filter(F.col("votes") >= votes)


def shift_chapters(chapters: DataFrame, offsets: DataFrame) -> DataFrame:
    """Chapter pages below 1000 moved by the offset of their book."""
    joined = chapters.join(offsets.select("book_id", "page_offset"), "book_id", "left")
    shifted = F.when((F.col("page") < 1000) & F.col("page_offset").isNotNull(), F.col("page") + F.col("page_offset")).otherwise(F.col("page"))
    return joined.withColumn("page", shifted).drop("page_offset")


def toc_entries(toc_json: str | Column) -> Column:
    """Contents list JSON to array<struct<level, page, pdf_page>>; entries are lists or objects; null for invalid JSON."""
    def entry(e: Column) -> Column:
        def number(path: str) -> Column:
            return F.get_json_object(e, path).try_cast("int")

        listed = e.startswith("[")
        return F.struct(
            F.coalesce(F.when(listed, number("$[0]")).otherwise(number("$.level")), F.lit(0)).alias("level"),
            F.when(listed, number("$[2]")).otherwise(F.coalesce(number("$.page"), number("$.page_number"))).alias("page"),
            F.when(~listed, number("$.pdf_page")).alias("pdf_page"))

    return F.transform(F.from_json(toc_json, "array<string>"), entry)


def content_bounds(books: DataFrame) -> DataFrame:
    """(id, content_start, content_end) from the first positive contents page, else by share of the page count."""
    n, offset = F.coalesce("page_count", F.lit(0)), F.coalesce("page_offset", F.lit(0))
    first = F.get(F.filter(toc_entries("toc_json"), lambda e: e["page"] > 0), F.lit(0))["page"]
    start = F.coalesce(first, F.when(n >= 50, F.greatest(F.lit(1), F.floor(n * 0.05)) + offset).otherwise(F.lit(1)))
    rows = books.select("id", n.alias("_n"), start.alias("content_start"))
    end = F.when(F.col("_n") >= 50, F.greatest("content_start", F.floor(F.col("_n") * 0.97))).otherwise(F.col("_n"))
    return rows.select("id", "content_start", end.alias("content_end"))


def region_detection(pages: DataFrame, front: int = 20, head: int | None = None, tail: int | None = None) -> DataFrame:
    """(book_id, n_pages, metadata_end, bibliography_start), zero-based and end-exclusive. Two aggregates, no window.

    Contents markers are looked for on the first ``head`` pages and bibliography markers on the last ``tail``, by default
    on all; without a bibliography marker its region starts ``tail`` pages before the end, by default at the end.
    """
    lower = F.lower("content")
    i = F.col("page") - 1
    sizes = pages.groupBy("book_id").agg(F.max("page").alias("n_pages"), F.min(F.when((F.lit(True) if head is None else i < head) & contains_any(lower, TOC_MARKERS), i)).alias("_toc"))
    marked = pages.filter(contains_any(lower, BIB_MARKERS)).select("book_id", i.alias("_i")).join(sizes.select("book_id", "n_pages"), "book_id")
    bib = (marked if tail is None else marked.filter(F.col("_i") >= F.greatest(F.col("n_pages") - tail, F.lit(0)))).groupBy("book_id").agg(F.min("_i").alias("_bib"))
    return sizes.join(bib, "book_id", "left").select(
        "book_id", "n_pages", F.least(F.coalesce(F.col("_toc"), F.lit(0)) + front, "n_pages").alias("metadata_end"),
        F.coalesce("_bib", F.greatest(F.col("n_pages") - (tail or 0), F.lit(0))).alias("bibliography_start"))


def index_page_score(content: Column) -> Column:
    """Points for looking like a page of the back-of-book index."""
    def score(lines: Column) -> Column:
        header = F.lower(F.array_join(F.slice(lines, 1, 3), " "))
        density = F.try_divide(F.size(F.filter(lines, lambda x: x.rlike(r"\d+$"))), F.size(lines))
        points = (
            F.when(F.contains(header, F.lit("index")), 50).otherwise(0)
            + F.when(contains_any(header, ["subject index", "author index"]), 70).otherwise(0)
            + F.when(density > 0.15, 20).otherwise(0) + F.when(density > 0.30, 20).otherwise(0)
            - F.when(contains_any(header, ["bibliography", "references"]), 100).otherwise(0))
        return F.when(F.size(lines) == 0, 0).otherwise(F.greatest(F.lit(0), points))

    return tx.let(tx.lines(content), score)


def index_page_candidates(pages: DataFrame, tail: int | None = None, least: int = 40) -> DataFrame:
    """(book_id, n_pages, index_text): likely index pages of every book (among its last ``tail`` if set), joined in order."""
    if tail is not None:
        last = pages.groupBy("book_id").agg(F.max("page").alias("_last"))
        pages = pages.join(last, "book_id").filter(F.col("page") > F.col("_last") - tail)
    kept = pages.filter(index_page_score(F.col("content")) >= least)
    listed = kept.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page", "content"))).alias("_l"))
    return listed.select("book_id", F.size("_l").cast("long").alias("n_pages"), F.array_join(F.col("_l.content"), "\n").alias("index_text"))


def cross_page_patterns(pages: DataFrame, per_case: int | None = None, samples: int = 15, seed: str = "42") -> DataFrame:
    """(case, book_id, page): extraction edge cases over neighbouring pages (the first ``per_case`` of each kind if set), and a seeded sample."""
    following = pages.select("book_id", (F.col("page") - 1).alias("page"), F.col("content").alias("_next"))
    rows = pages.join(following, ["book_id", "page"], "left").withColumn("_next", F.coalesce("_next", F.lit("")))
    text = F.col("content")

    def has(*needles: str) -> Column:
        return contains_any(text, list(needles))

    kinds = sum((F.contains(text, F.lit(f"\\begin{{{k}}}")).cast("int") for k in ("theorem", "lemma", "corollary")), F.lit(0))
    cases = {
        "case1_spanning_proof": has(r"\begin{theorem}", r"\begin{lemma}", r"\begin{proposition}") & ~has(r"\begin{proof}") & F.contains("_next", F.lit(r"\begin{proof}")),
        "case2_embedded_def": ~has(r"\begin{definition}") & has(r"\textbf{") & F.contains(F.lower(text), F.lit("we define")),
        "case3_dense_page": (kinds >= 2) & (tx.count_of(text, r"\begin{proof}") >= 2),
        "case4_postponed_proof": text.rlike(r"(?i)\\begin\{proof\}\[Proof of Theorem"),
        "case5_long_proof": has(r"\begin{proof}") & ~has(r"\end{proof}") & ~F.contains("_next", F.lit(r"\end{proof}")),
    }
    # One pass flags every page with its cases; a top-k per case follows.
    flagged = rows.select("book_id", "page", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cases.items()]))).alias("case"))
    first = (flagged if per_case is None else top_per_key(flagged, ["case"], per_case, "book_id", "page")).select("case", "book_id", "page")
    start = F.col("page") - F.when(F.col("case") == "case4_postponed_proof", 1).otherwise(0)
    used = first.select("book_id", F.explode(F.sequence(start, start + 2)).alias("page"))
    rest = pages.filter(F.length(tx.strip("content")) > 100).select("book_id", "page").join(used, ["book_id", "page"], "left_anti")
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.col("book_id").cast("string"), F.col("page").cast("string")))
    return first.unionByName(rest.orderBy(mixed, "book_id", "page").limit(samples).select(F.lit("case6_random").alias("case"), "book_id", "page"))


def locate_passage(pairs: DataFrame) -> DataFrame:
    """pairs(id, content, marker) -> (id, position, stage): verbatim and case-folded hits are native, only the rest is searched in Python."""
    same, folded = F.instr(F.col("content"), F.col("marker")), F.instr(F.lower("content"), F.lower("marker"))
    staged = pairs.filter("marker <> ''").withColumn("_at", F.when(same > 0, same).when(folded > 0, folded)).withColumn("stage", F.when(same > 0, "exact").when(folded > 0, "lower"))
    found = staged.filter("stage IS NOT NULL").select("id", (F.col("_at") - 1).alias("position"), "stage")
    rest = spread(staged.filter("stage IS NULL").select("id", "content", "marker"), "id").select("id", marker_position("content", "marker").alias("position"), F.lit("fuzzy").alias("stage"))
    return found.unionByName(rest.filter("position >= 0"))


def passage_text(located: DataFrame, pairs: DataFrame, pages: DataFrame, ahead: int = 2) -> DataFrame:
    """(id, body): from the start marker to the end marker on p..p+ahead, to the end of the last page reached without one.

    pairs(id, book_id, page, content, marker, end_marker); the end marker is looked up verbatim.
    """
    rows = located.join(pairs, "id").withColumn("_tail", F.expr("substring(content, position + 1)"))
    cut_at = F.instr(F.expr("substring(_tail, length(marker) + 1)"), F.col("end_marker"))
    here = rows.withColumn("_cut", F.when(F.col("end_marker").isNull(), F.length("_tail")).when(cut_at > 0, F.length("marker") + cut_at - 1))
    done = here.filter("_cut IS NOT NULL").select("id", F.expr("substring(_tail, 1, _cut)").alias("body"))
    opened = here.filter("_cut IS NULL").select("id", "book_id", "page", "_tail", "end_marker")
    following = opened.select("id", "book_id", "end_marker", F.posexplode(F.sequence(F.col("page") + 1, F.col("page") + ahead)).alias("_step", "page")).join(
        pages.select("book_id", "page", F.col("content").alias("_c")), ["book_id", "page"])
    parts = following.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_step", "page", "_c", F.instr(F.col("_c"), F.col("end_marker")).alias("_end")))).alias("_p"))

    def extend(state: Column, part: Column) -> Column:
        piece = F.concat(F.lit("\n\n% --- PAGE "), part["page"].cast("string"), F.lit(" ---\n\n"))
        text = F.when(part["_end"] > 0, F.left(part["_c"], part["_end"] - 1)).otherwise(part["_c"])
        go_on = ~state["closed"] & (part["_step"] == state["next"])
        return F.struct(
            F.when(go_on, F.concat(state["body"], piece, text)).otherwise(state["body"]).alias("body"),
            (state["closed"] | ~go_on | (part["_end"] > 0)).alias("closed"), (state["next"] + 1).alias("next"))

    joined = opened.join(parts, "id", "left")
    start = F.struct(F.col("_tail").alias("body"), F.lit(False).alias("closed"), F.lit(0).alias("next"))
    grown = F.aggregate(F.coalesce("_p", F.expr("cast(array() as array<struct<_step:int,page:bigint,_c:string,_end:int>>)")), start, extend)
    return done.unionByName(joined.select("id", grown["body"].alias("body")))


def locate_in_corpus(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle_id, text_id, position): every text that holds a passage verbatim; equal passages are searched once."""
    hits = containment_join(passages.select("needle").distinct().select(F.col("needle").alias("needle_id"), "needle"), texts, passages=True)
    return hits.withColumnRenamed("needle_id", "needle").join(passages, "needle").select("needle_id", "text_id", (F.col("position") - 1).alias("position"))


def recover_placeholders(terms: DataFrame, pages: DataFrame, fuzzy: bool = True, before: int = 1, after: int = 2) -> DataFrame:
    """(id, page, body) for placeholder bodies '(marker: x)': first page of p-1..p+2 where the marker is found."""
    marker = F.regexp_extract("latex", r"\(marker: (.*?)\)", 1)
    wanted = terms.filter(F.contains("latex", F.lit("(marker: "))).withColumn("marker", marker).filter("marker <> ''")
    near = wanted.select("id", "book_id", "marker", F.explode(F.sequence(F.col("page") - before, F.col("page") + after)).alias("page")).join(pages, ["book_id", "page"])
    at = F.instr(F.col("content"), F.col("marker")) - 1
    if fuzzy:
        rows = near.select("id", "page", "marker", "content", F.coalesce(at, F.lit(-1)).alias("at"))
        kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "page")]
        return spread(rows, "id").sortWithinPartitions("id", "page").mapInPandas(first_found, f"id {kinds[0]}, page {kinds[1]}, body string")
    hits = near.withColumn("_at", at).filter("_at >= 0")
    body = F.expr("substring(content, _at + 1)")
    return hits.groupBy("id").agg(F.min_by(F.struct("page", body.alias("body")), "page").alias("_h")).select("id", "_h.*")


def toc_metrics(books: DataFrame) -> DataFrame:
    """(id, entries, depth, max_page, flags) per contents list, computed inside the row; invalid JSON is skipped."""
    parsed = books.withColumn("_e", F.when(F.coalesce("toc_json", F.lit("")) == "", F.expr("cast(array() as array<struct<level:int,page:int,pdf_page:int>>)")).otherwise(toc_entries("toc_json"))).filter("_e IS NOT NULL")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("top"), F.lit(-1).alias("last"), F.lit(0).alias("wrong"))

    def step(s: Column, e: Column) -> Column:
        page = F.coalesce(F.nullif(e["pdf_page"], F.lit(0)), e["page"], F.lit(0))
        return F.struct(
            F.greatest(s["depth"], e["level"]).alias("depth"), F.greatest(s["top"], page).alias("top"),
            F.when(page > 0, page).otherwise(s["last"]).alias("last"),
            (s["wrong"] + F.when((page < s["last"]) & (page > 0), 1).otherwise(0)).alias("wrong"))

    rows = parsed.select("id", "page_count", F.size("_e").alias("entries"), F.aggregate("_e", zero, step).alias("_s"))
    some = F.col("entries") > 0
    flags = F.array_compact(F.array(
        F.when(some & (F.col("entries") < 5), "SHORT"), F.when(some & (F.col("_s.depth") == 0) & (F.col("entries") > 10), "FLAT"),
        F.when(some & (F.coalesce("page_count", F.lit(0)) > 0) & (F.col("_s.top") < F.col("page_count") * 0.7), "INCOMPLETE"),
        F.when(some & (F.col("_s.wrong") > 0), "DISORDERED"), F.when(~some, "MISSING")))
    return rows.select("id", "entries", F.col("_s.depth").alias("depth"), F.col("_s.top").alias("max_page"), F.array_join(flags, ",").alias("flags"))


def toc_from_text(pages: DataFrame, head: int | None = None, enough: int | None = None) -> DataFrame:
    """(book_id, page, line_no, title, target) from contents-like lines; of the first ``head`` pages, and only until more
    than ``enough`` lines are found, if these are set."""
    pattern = r"^((?:Chapter|Section|Part|Appendix)?\s*[\d\.]+\s+.*?)\s+[\.\s]*(\d+)$"
    lines = (pages if head is None else pages.filter(F.col("page") <= head)).select("book_id", "page", F.posexplode(F.transform(F.split("content", r"\r\n|[\n\r]"), tx.strip)).alias("line_no", "_l"))
    hits = lines.filter(F.length("_l").between(5, 120) & F.col("_l").rlike(pattern)).select(
        "book_id", "page", "line_no", tx.strip(F.regexp_extract("_l", pattern, 1)).alias("title"), F.regexp_extract("_l", pattern, 2).try_cast("long").alias("target"))
    if enough is None:
        return hits
    per_page = hits.groupBy("book_id", "page").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("book_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    open_pages = per_page.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).filter(F.col("_before") <= enough).select("book_id", "page")
    return hits.join(open_pages, ["book_id", "page"], "left_semi")
