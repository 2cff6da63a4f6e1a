"""Batch matching of (title, author) requests against the catalogue in four stages.

requests(query_id, title, author), books(id, title, author). Every stage works on distinct (title, author) values of
both sides, so a title held by a third of the rows is compared once, and returns (title, author, id, score, strategy)
for the requests it can answer. There is no limit on candidates; blocking keys lose no match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.functions import text as tx
from bibliospark.functions.similarity import indel_ratio, ratio_possible, token_set_ratio
from bibliospark.operators.blocking import containment_join, rare_key_pairs, substring_keys, text_keys
from bibliospark.operators.joins import expand_author_initials
from bibliospark.operators.resolve import tagged
from bibliospark.partitioning import first_per_key, spread
from bibliospark.session import cut_lineage


def distinct_requests(requests: DataFrame) -> DataFrame:
    return requests.select("title", F.coalesce("author", F.lit("")).alias("author")).filter("title IS NOT NULL").distinct()


def distinct_books(books: DataFrame) -> DataFrame:
    """One row per catalogue (title, author) with its lowest id."""
    return books.filter("title IS NOT NULL").groupBy(F.col("title").alias("b_title"), F.coalesce("author", F.lit("")).alias("b_author")).agg(F.min("id").alias("id"))


def match_exact(wanted: DataFrame, books: DataFrame) -> DataFrame:
    """Same title and author ignoring case; without an author any book of the title."""
    keyed = books.select(F.lower("b_title").alias("_t"), F.lower("b_author").alias("_a"), "id")
    both = keyed.groupBy("_t", "_a").agg(F.min("id").alias("id"))
    title_only = keyed.groupBy("_t").agg(F.min("id").alias("id"))
    rows = wanted.withColumn("_t", F.lower("title")).withColumn("_a", F.lower("author"))
    hits = rows.filter("author <> ''").join(both, ["_t", "_a"]).unionByName(rows.filter("author = ''").join(title_only, "_t"), allowMissingColumns=True)
    return hits.select("title", "author", "id", F.lit(1.0).alias("score"), F.lit("exact").alias("strategy"))


WORD_LETTER = r"[\p{L}\p{N}_]"
SHORT_WORDS = 10_000


def word_windows(text: str | Column, size: int) -> Column:
    """Every ``size`` neighbouring words with one blank between them; words are runs of letters, digits and underscores."""
    return F.regexp_extract_all(tx.column(text), F.lit(rf"(?<!{WORD_LETTER})(?=({WORD_LETTER}++(?: {WORD_LETTER}++){{{size - 1}}}))"), F.lit(1))


def first_inner_last(window: Column) -> tuple[Column, Column, Column]:
    first, last = F.substring_index(window, " ", 1), F.substring_index(window, " ", -1)
    return first, F.substring(window, F.length(first) + 1, F.length(window) - F.length(first) - F.length(last)), last


def titles_inside(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle_id, id): the lowest text whose title holds the needle's title, of the same author.

    needles(needle_id, title, author) with normalised titles, texts(id, title, author) with loosened ones; equal titles of
    an author share a row. A needle lies in neighbouring words of the text: its inner words are whole there, the
    first and the last may be longer. One word is looked up in the distinct words; two to four words in the distinct
    windows of as many words, which carry their lowest text, by the inner words and three letters of either edge;
    longer ones by their rarest three inner words. So no needle meets the many texts that share a common word with it.
    """
    size = F.size(F.split("title", " "))

    def held(windows: Column) -> DataFrame:
        return texts.select("id", "author", F.explode(F.array_distinct(windows)).alias("_w")).groupBy("author", "_w").agg(F.min("id").alias("id"))

    words, single = held(word_windows("title", 1)), needles.filter(size == 1)
    inside = containment_join(single.select(F.col("title").alias("needle_id"), F.col("title").alias("needle")).distinct(),
                              words.select(F.col("_w").alias("text_id"), F.col("_w").alias("text")).distinct())
    by_word = inside.select(F.col("needle_id").alias("title"), F.col("text_id").alias("_w")).join(words, "_w").join(single, ["title", "author"]).select("needle_id", "id")

    first, inner, last = first_inner_last(F.col("title"))
    short = needles.filter((size >= 2) & (size <= 4)).withColumn("_key", F.xxhash64("author", F.right(first, F.lit(3)), inner, F.left(last, F.lit(3))))

    def edges(word: Column, side, of_needle: Column) -> Column:
        """The last or first three letters of a text's word, and fewer if they are a whole edge word of a needle."""
        few = [r.w for r in short.select(of_needle.alias("w")).filter(F.length("w") < 3).distinct().limit(SHORT_WORDS + 1).collect()]
        wanted = (lambda e: F.lit(True)) if len(few) > SHORT_WORDS else (lambda e: e.isin(few))
        return F.filter(F.array_distinct(F.array(*[side(word, F.lit(n)) for n in (1, 2, 3)])), lambda e: (F.length(e) == 3) | wanted(e))

    windows = held(F.concat(*[word_windows("title", n) for n in (2, 3, 4)])).withColumnRenamed("author", "_author")
    w_first, w_inner, w_last = first_inner_last(F.col("_w"))
    placed = windows.withColumn("_end", F.explode(edges(w_first, F.right, first))).withColumn("_start", F.explode(edges(w_last, F.left, last)))
    placed = placed.select("_w", "_author", "id", F.xxhash64("_author", "_end", w_inner, "_start").alias("_key"))
    by_window = placed.join(short, "_key").filter((F.col("author") == F.col("_author")) & F.contains("_w", F.col("title"))).select("needle_id", "id")

    def keys(text: Column) -> Column:
        return F.transform(F.array_distinct(word_windows(text, 3)), lambda w: F.xxhash64("author", w))

    long = needles.filter(size > 4)
    pairs = rare_key_pairs(long, texts.withColumnRenamed("id", "text_id"), keys(F.trim(inner)), keys(F.col("title")))
    whole = texts.select(F.col("id").alias("text_id"), F.col("title").alias("_text"), F.col("author").alias("_author"))
    by_inner = pairs.join(long, "needle_id").join(whole, "text_id").filter(
        (F.col("author") == F.col("_author")) & F.contains("_text", F.col("title"))).select("needle_id", F.col("text_id").alias("id"))
    return by_word.unionByName(by_window).unionByName(by_inner).groupBy("needle_id").agg(F.min("id").alias("id"))


def match_normalized(wanted: DataFrame, books: DataFrame) -> DataFrame:
    """Normalised title and any expansion of the author inside the loosened catalogue values. Never matches without an author.

    Authors are looked up among the distinct authors first, then each title among the titles of those authors.
    """
    authored = wanted.filter("author <> ''")
    variants = expand_author_initials(authored, books.select(F.col("b_author").alias("author")).filter("author <> ''"))
    asked = authored.join(variants, "author").select("title", "author", tx.normalize_title("title").alias("_t"), tx.normalize_title("variant").alias("_a")).filter("_t <> ''")
    texts = books.groupBy(tx.loose_title("b_title").alias("title"), tx.loose_title("b_author").alias("author")).agg(F.min("id").alias("id"))
    texts = cut_lineage(spread(texts, "id"))
    wanted_authors, authors = asked.select("_a").distinct(), texts.select("author").distinct()
    within = containment_join(wanted_authors.select(F.col("_a").alias("needle_id"), F.col("_a").alias("needle")), authors.select(F.col("author").alias("text_id"), F.col("author").alias("text")))
    # Every author holds one without letters.
    any_author = authors.select(F.lit("").alias("_a"), F.col("author").alias("_has")).join(wanted_authors, "_a", "left_semi")
    within = within.select(F.col("needle_id").alias("_a"), F.col("text_id").alias("_has")).unionByName(any_author)
    meant = asked.select("_t", "_a").distinct().join(within, "_a")
    needles = cut_lineage(meant.select(F.col("_t").alias("title"), F.col("_has").alias("author")).distinct().withColumn("needle_id", F.monotonically_increasing_id()))
    found = needles.join(titles_inside(needles, texts), "needle_id").select(F.col("title").alias("_t"), F.col("author").alias("_has"), "id")
    found = meant.join(found, ["_t", "_has"]).groupBy("_t", "_a").agg(F.min("id").alias("id"))
    return asked.join(found, ["_t", "_a"]).groupBy("title", "author").agg(F.min("id").alias("id")).select(
        "title", "author", "id", F.lit(0.95).alias("score"), F.lit("normalized").alias("strategy"))


def match_fuzzy(wanted: DataFrame, books: DataFrame) -> DataFrame:
    """Title alike by 85 and author by 80 among books whose title holds one of the first three title words; 0.7 title + 0.3 author."""
    titles = wanted.select(F.col("title")).distinct()
    words = titles.select("title", F.explode(F.array_distinct(F.slice(tx.title_tokens("title"), 1, 3))).alias("word"))
    book_titles = books.select("b_title").distinct()
    held = containment_join(
        words.select(F.col("word").alias("needle_id"), F.col("word").alias("needle")).distinct(),
        book_titles.select(F.col("b_title").alias("text_id"), F.lower("b_title").alias("text")),
    ).withColumnsRenamed({"needle_id": "word", "text_id": "b_title"})
    # Lengths decide in the join condition, before a pair exists.
    pairs = words.join(held, [words["word"] == held["word"], ratio_possible(words["title"], held["b_title"], 85.0)]).select("title", "b_title").distinct()
    alike = spread(pairs, "title", "b_title").withColumn("_ts", indel_ratio(F.lower("title"), F.lower("b_title"))).filter("_ts >= 85")
    rows = alike.join(wanted, "title").join(books, "b_title")
    judged = (F.col("author") != "") & (F.col("b_author") != "")
    rows = rows.filter(~judged | ratio_possible(F.col("author"), F.col("b_author"), 80.0)).withColumn(
        "_as", F.when(judged, indel_ratio(F.lower("author"), F.lower("b_author"))).otherwise(100.0)).filter("_as >= 80")
    scored = rows.select("title", "author", "id", F.round((F.col("_ts") * 0.7 + F.col("_as") * 0.3) / 100, 6).alias("score"))
    return first_per_key(scored, ["title", "author"], -F.col("score"), "id").withColumn("strategy", F.lit("fuzzy"))


def match_token(wanted: DataFrame, books: DataFrame) -> DataFrame:
    """All words of the main title (the last may miss when there are more than three) and the author's last word inside the catalogue values."""
    words = tx.title_tokens(F.trim(F.substring_index("title", ":", 1)))
    asked = wanted.withColumn("_all", words).filter(F.size("_all") > 0)
    needed = F.when(F.size("_all") > 3, F.slice("_all", 1, F.size("_all") - 1)).otherwise(F.col("_all"))
    surname = F.when(F.col("author") != "", F.element_at(tx.title_tokens("author"), -1)).otherwise("")
    asked = asked.withColumn("_need", needed).withColumn("_surname", F.coalesce(surname, F.lit("")))
    needles = asked.select(F.struct("_need", "_surname").alias("needle_id"), "_need", "_surname").distinct()
    texts = books.select(F.col("id").alias("text_id"), F.lower("b_title").alias("_t"), F.lower("b_author").alias("_a"), "b_author")
    none = F.array().cast("array<string>")
    needle_keys = F.array_distinct(F.concat(
        tagged(F.flatten(F.transform("_need", substring_keys)), "t"), tagged(F.coalesce(substring_keys("_surname"), none), "a")))
    pairs = rare_key_pairs(needles, texts, needle_keys, F.concat(tagged(text_keys("_t"), "t"), tagged(text_keys("_a"), "a")))
    held = pairs.join(needles, "needle_id").join(texts, "text_id").filter(
        F.forall("_need", lambda w: F.contains("_t", w)) & F.contains("_a", F.col("_surname")))
    rows = asked.join(held.select("_need", "_surname", F.col("text_id").alias("id"), "b_author"), ["_need", "_surname"])
    closeness = F.when((F.col("author") != "") & (F.col("b_author") != ""), indel_ratio(F.lower("author"), F.lower("b_author"))).otherwise(0.0)
    score = F.round(0.6 + 0.2 * (F.size("_need") / F.size("_all")), 6)
    ranked = rows.select("title", "author", "id", score.alias("score"), closeness.alias("_close"))
    return first_per_key(ranked, ["title", "author"], -F.col("_close"), "id").drop("_close").withColumn("strategy", F.lit("token"))


STAGES = [match_exact, match_normalized, match_fuzzy, match_token]


def match_cascade(requests: DataFrame, books: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(query_id, found, id, score, strategy): the first stage that reaches the threshold answers; later stages see only the rest.

    The answers of a stage are checkpointed before the next one starts: the plans would otherwise nest.
    """
    left, catalogue = cut_lineage(distinct_requests(requests)), cut_lineage(distinct_books(books))
    answers = None
    for stage in STAGES:
        hits = cut_lineage(stage(left, catalogue).filter(F.col("score") >= threshold))
        answers = hits if answers is None else answers.unionByName(hits)
        left = left.join(hits.select("title", "author"), ["title", "author"], "left_anti")
    asked = requests.select("query_id", "title", F.coalesce("author", F.lit("")).alias("author"))
    return asked.join(answers, ["title", "author"], "left").select("query_id", F.col("id").isNotNull().cast("int").alias("found"), "id", "score", "strategy")


def wishlist_acquired(wishlist: DataFrame, books: DataFrame, least: float = 85.0) -> DataFrame:
    """Wishlist rows (id, title) with a book title whose token set is more than 85 alike.

    Distinct titles are compared when they share a word or a gram of their sorted words: two strings alike by 85 share
    three letters in a row once they have more than eight letters on average, and two in a row below that.
    """
    def keys(title: str):
        words = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(title, r"\s+"), lambda w: w != ""))), " ")
        short = F.when(F.length(words) <= 12, tx.grams(words, 2)).otherwise(F.array().cast("array<string>"))
        return F.concat(tagged(F.array_distinct(F.split(title, r"\s+")), "w"), tagged(F.concat(tx.grams(words, 3), short), "g"))

    left = wishlist.select("title").distinct().withColumn("_keys", keys("title"))
    right = books.select(F.col("title").alias("b_title")).distinct().withColumn("_b_keys", keys("b_title"))
    meet = left.withColumn("_k", F.explode("_keys")).join(right.withColumn("_k", F.explode("_b_keys")), "_k")
    # A pair meets under every common key; it is kept under the smallest one only.
    once = meet.filter(F.col("_k") == F.array_min(F.array_intersect("_keys", "_b_keys"))).select("title", "b_title")
    hits = spread(once, "title", "b_title").filter(token_set_ratio("title", "b_title") > least).select("title").distinct()
    return wishlist.join(hits, "title", "left_semi")
