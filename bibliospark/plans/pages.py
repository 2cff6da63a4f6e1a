"""Page-sequence operators over the driver tables."""

from pyspark.sql import functions as F

from bibliospark.operators import pages as op
from bibliospark.plans import fixtures as fx
from bibliospark.plans.registry import query

DOC_PAGES = "(SELECT source AS book_id, doc_id // 20 + 1 AS page, lang, text AS content FROM documents)"


def doc_pages(t):
    """Longer books: the documents of a source in id order."""
    return t.documents.select(F.col("source").alias("book_id"), (F.floor(F.col("doc_id") / 20) + 1).alias("page"), "lang", F.col("text").alias("content"))


@query("context_window", f"""
WITH p AS {fx.PAGES_SQL} SELECT a.book_id, a.page, string_agg(concat(chr(10), chr(10), '% --- PAGE ', b.page, ' ---', chr(10), chr(10), b.content), '' ORDER BY b.page) AS context
FROM p a JOIN p b ON b.book_id = a.book_id AND b.page BETWEEN a.page - 2 AND a.page + 4 GROUP BY 1, 2""")
def context_window(t):
    return op.context_window(fx.pages(t))


@query("extraction_window", f"""
WITH p AS {DOC_PAGES} SELECT a.book_id, a.page, md5(string_agg(concat(chr(10), chr(10), '% --- PAGE ', b.page, ' ---', chr(10), chr(10), replace(b.content, '\\n', chr(10))), '' ORDER BY b.page)) AS context
FROM p a JOIN p b ON b.book_id = a.book_id AND b.page BETWEEN a.page AND a.page + 2 GROUP BY 1, 2""")
def extraction_window(t):
    return op.context_window(doc_pages(t), before=0, after=2).withColumn("context", F.md5("context"))


@query("contiguous_blocks", """
WITH p AS (SELECT DISTINCT user_id AS book_id, datediff('day', TIMESTAMP '2024-01-01', ts) + 1 AS page FROM events WHERE event_type IN ('view', 'click', 'signup') AND (value IS NULL OR value >= 0.7)),
q AS (SELECT * FROM p JOIN (SELECT user_id AS book_id, min(datediff('day', TIMESTAMP '2024-01-01', ts)) + 2 AS lo FROM events GROUP BY 1) USING (book_id) WHERE page >= lo),
r AS (SELECT book_id, min(page) AS s, max(page) AS e FROM (SELECT book_id, page, page - row_number() OVER (PARTITION BY book_id ORDER BY page) AS g FROM q) GROUP BY book_id, g),
f AS (SELECT book_id, min(s) AS lo, max(e) AS hi, min(s) FILTER (e - s >= 4) AS fs, arg_min(e, s) FILTER (e - s >= 4) AS fe FROM r GROUP BY 1),
b AS (SELECT book_id, coalesce(fs, lo) AS block_start, coalesce(fe, hi) AS block_end FROM f)
SELECT b.book_id, block_start, block_end, count(*) AS n_pages FROM b JOIN q ON q.book_id = b.book_id AND page BETWEEN block_start AND block_end GROUP BY 1, 2, 3""")
def contiguous_blocks(t):
    day = F.expr("datediff(cast(ts as date), date'2024-01-01')") + 1
    pages = t.events.select(F.col("user_id").alias("book_id"), day.cast("long").alias("page"), F.col("value").alias("quality_score"),
                            (~F.col("event_type").isin("view", "click", "signup")).alias("harvested"))
    bounds = pages.groupBy("book_id").agg((F.min("page") + 1).alias("content_start"), F.lit(None).cast("long").alias("content_end"))
    return op.contiguous_blocks(pages, bounds)


NUMBERED = f"""(SELECT book_id, page, CASE WHEN lang = 'en' THEN concat(page + 12, ' ', content, ' ', page + 12, ' x.', length(content) % 50, '.') WHEN lang = 'fr' THEN concat(content, ' ', page + 12) ELSE content END AS content FROM {DOC_PAGES})"""
NUMBERS = r"list_distinct(list_concat(regexp_extract_all(substr(content, 1, 100), '(?:^|[\s\.])(\d{1,4})(?:$|[\s\.])', 1), regexp_extract_all(right(content, 100), '(?:^|[\s\.])(\d{1,4})(?:$|[\s\.])', 1)))"


def numbered(t):
    number = (F.col("page") + 12).cast("string")
    text = (F.when(F.col("lang") == "en", F.concat(number, F.lit(" "), "content", F.lit(" "), number, F.lit(" x."), (F.length("content") % 50).cast("string"), F.lit(".")))
            .when(F.col("lang") == "fr", F.concat("content", F.lit(" "), number)).otherwise(F.col("content")))
    return doc_pages(t).select("book_id", "page", text.alias("content"))


OFFSETS = f"""off AS (SELECT book_id, page_offset, votes FROM (SELECT book_id, page - CAST(n AS BIGINT) AS page_offset, count(*) AS votes FROM (
  SELECT book_id, page, unnest({NUMBERS}) AS n FROM {NUMBERED})
  WHERE CAST(n AS BIGINT) > 0 AND CAST(n AS BIGINT) < 2000 GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY votes DESC, abs(page_offset), page_offset DESC) = 1)"""


@query("page_offset_align", f"WITH {OFFSETS} SELECT * FROM off WHERE votes >= 4")
def page_offset_align(t):
    return op.page_offset_align(numbered(t))


@query("shift_chapters", f"""WITH {OFFSETS} SELECT d.book_id, doc_id AS id, CASE WHEN n_chars < 1000 AND page_offset IS NOT NULL THEN n_chars + page_offset ELSE n_chars END AS page
FROM (SELECT source AS book_id, doc_id, n_chars FROM documents) d LEFT JOIN (SELECT * FROM off WHERE votes >= 4) o ON o.book_id = d.book_id""")
def shift_chapters(t):
    chapters = t.documents.select(F.col("source").alias("book_id"), F.col("doc_id").alias("id"), F.col("n_chars").alias("page"))
    return op.shift_chapters(chapters, op.page_offset_align(numbered(t)))


@query("content_bounds", """
WITH b AS (SELECT o_orderkey AS id, o_custkey % 400 AS n, o_custkey % 5 AS off, CASE o_orderpriority WHEN '1-URGENT' THEN o_custkey % 90 + 1 WHEN '2-HIGH' THEN o_custkey % 70 + 2 END AS toc FROM orders),
s AS (SELECT *, coalesce(toc, CASE WHEN n >= 50 THEN greatest(1, CAST(floor(n * 0.05) AS BIGINT)) + off ELSE 1 END) AS content_start FROM b)
SELECT id, content_start, CASE WHEN n >= 50 THEN greatest(content_start, CAST(floor(n * 0.97) AS BIGINT)) ELSE n END AS content_end FROM s""")
def content_bounds(t):
    c = F.col("o_custkey")
    toc = (F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit('[[1, "A", 0], [1, "B", '), (c % 90 + 1).cast("string"), F.lit('], [2, "C", 500]]')))
           .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit('[{"title": "x"}, {"title": "y", "page_number": '), (c % 70 + 2).cast("string"), F.lit("}]")))
           .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("{broken")))
    books = t.orders.select(F.col("o_orderkey").alias("id"), (c % 400).alias("page_count"), (c % 5).alias("page_offset"), toc.alias("toc_json"))
    return op.content_bounds(books)


MARKED = f"""(SELECT book_id, page, CASE WHEN length(content) % 7 = 0 THEN concat('Inhalt ', content) WHEN length(content) % 11 = 0 THEN concat(content, ' References') ELSE content END AS content FROM {DOC_PAGES})"""


@query("region_detection", f"""
WITH p AS {MARKED}, n AS (SELECT book_id, max(page) AS n_pages FROM p GROUP BY 1)
SELECT p.book_id, n_pages, least(n_pages, coalesce(min(page - 1) FILTER (contains(lower(content), 'contents') OR contains(lower(content), 'inhalt') OR contains(lower(content), 'table des matières')), 0) + 20) AS metadata_end,
  coalesce(min(page - 1) FILTER (contains(lower(content), 'bibliograph') AND regexp_matches(lower(content), 'bibliography|bibliographie') OR contains(lower(content), 'references') OR contains(lower(content), 'literaturverzeichnis')), n_pages) AS bibliography_start
FROM p JOIN n ON n.book_id = p.book_id GROUP BY 1, 2""")
def region_detection(t):
    size = F.length("content")
    text = F.when(size % 7 == 0, F.concat(F.lit("Inhalt "), "content")).when(size % 11 == 0, F.concat("content", F.lit(" References"))).otherwise(F.col("content"))
    return op.region_detection(doc_pages(t).withColumn("content", text))


INDEXED = f"""(SELECT book_id, page, CASE lang WHEN 'de' THEN concat('Subject Index', chr(10), content) WHEN 'fr' THEN concat('  ', replace(content, chr(10), ' 7' || chr(10)), ' 12 ')
  WHEN 'es' THEN concat('Index', chr(10), 'References', chr(10), content) ELSE content END AS content FROM {DOC_PAGES})"""


@query("index_page_candidates", rf"""
WITH p AS (SELECT *, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM {INDEXED}),
s AS (SELECT book_id, page, content, max(page) OVER (PARTITION BY book_id) AS n, lower(array_to_string(l[1:3], ' ')) AS h, len(list_filter(l, lambda x: regexp_matches(x, '\d+$'))) / len(l) AS d FROM p WHERE len(l) > 0),
c AS (SELECT *, greatest(0, CASE WHEN contains(h, 'index') THEN 50 ELSE 0 END + CASE WHEN contains(h, 'subject index') OR contains(h, 'author index') THEN 70 ELSE 0 END
  + CASE WHEN d > 0.15 THEN 20 ELSE 0 END + CASE WHEN d > 0.30 THEN 20 ELSE 0 END - CASE WHEN contains(h, 'bibliography') OR contains(h, 'references') THEN 100 ELSE 0 END) AS score FROM s)
SELECT book_id, count(*) AS n_pages, md5(string_agg(content, chr(10) ORDER BY page)) AS index_text FROM c WHERE score >= 40 GROUP BY 1""")
def index_page_candidates(t):
    c, lang = F.col("content"), F.col("lang")
    text = (F.when(lang == "de", F.concat(F.lit("Subject Index\n"), c)).when(lang == "fr", F.concat(F.lit("  "), F.replace(c, F.lit("\n"), F.lit(" 7\n")), F.lit(" 12 ")))
            .when(lang == "es", F.concat(F.lit("Index\nReferences\n"), c)).otherwise(c))
    return op.index_page_candidates(doc_pages(t).withColumn("content", text)).withColumn("index_text", F.md5("index_text"))


# Marker words put into the prose, the same way in both engines.
SWAPS = [(" of ", r" \begin{theorem} "), (" was ", r" \begin{proof} "), (" by ", r" \end{proof} "), (" are ", r" \textbf{x} we Define "), (" for ", r" \begin{lemma} "),
         (" from ", r" \begin{proof}[proof of theorem 2] "), (" this ", r" \begin{definition} ")]


def swapped_sql(column: str) -> str:
    for a, b in SWAPS:
        column = f"replace({column}, '{a}', '{b}')"
    return column


def swapped(column):
    for a, b in SWAPS:
        column = F.replace(column, F.lit(a), F.lit(b))
    return column


@query("cross_page_patterns", rf"""
WITH p AS (SELECT source AS book_id, doc_id // 20 + 1 AS page, {swapped_sql('text')} AS c FROM documents),
j AS (SELECT p.*, coalesce(n.c, '') AS nx FROM p LEFT JOIN p n ON n.book_id = p.book_id AND n.page = p.page + 1),
f AS (SELECT 'case1_spanning_proof' AS "case", book_id, page FROM j WHERE regexp_matches(c, '\\begin\{{(theorem|lemma|proposition)\}}') AND NOT contains(c, '\begin{{proof}}') AND contains(nx, '\begin{{proof}}')
  UNION ALL SELECT 'case2_embedded_def', book_id, page FROM j WHERE NOT contains(c, '\begin{{definition}}') AND contains(c, '\textbf{{') AND contains(lower(c), 'we define')
  UNION ALL SELECT 'case3_dense_page', book_id, page FROM j WHERE contains(c, '\begin{{theorem}}') AND contains(c, '\begin{{lemma}}') AND len(string_split(c, '\begin{{proof}}')) > 2
  UNION ALL SELECT 'case4_postponed_proof', book_id, page FROM j WHERE contains(lower(c), '\begin{{proof}}[proof of theorem')
  UNION ALL SELECT 'case5_long_proof', book_id, page FROM j WHERE contains(c, '\begin{{proof}}') AND NOT contains(c, '\end{{proof}}') AND NOT contains(nx, '\end{{proof}}')),
t AS (SELECT * FROM f),
u AS (SELECT book_id, page + unnest([0, 1, 2]) - CASE WHEN "case" = 'case4_postponed_proof' THEN 1 ELSE 0 END AS page FROM t),
r AS (SELECT book_id, page FROM p WHERE length(trim(c, ' ' || chr(10))) > 100 AND NOT EXISTS (SELECT 1 FROM u WHERE u.book_id = p.book_id AND u.page = p.page) ORDER BY md5(concat('42:', book_id, ':', page)), book_id, page LIMIT 15)
SELECT * FROM t UNION ALL SELECT 'case6_random', book_id, page FROM r""")
def cross_page_patterns(t):
    return op.cross_page_patterns(doc_pages(t).withColumn("content", swapped(F.col("content"))))


def page_markers(t):
    """Every page with a marker cut from it; the way the marker is damaged depends on the role and length."""
    words = F.array_join(F.slice(F.split("content", " "), 3, 8), " ")
    size = F.length("content")
    marker = (F.when(size % 4 == 0, words).when(size % 4 == 1, F.upper(words)).when(size % 4 == 2, F.concat(F.lit("$"), F.replace(words, F.lit(" "), F.lit("  ")), F.lit("$")))
              .otherwise(F.regexp_replace(words, "([a-z])e", "$1")))
    return fx.pages(t).select((F.col("book_id") * 10 + F.col("page")).alias("id"), "book_id", "page", "content", marker.alias("marker"))


@query("locate_passage")
def locate_passage(t):
    return op.locate_passage(page_markers(t))


@query("locate_passage_exact", """
WITH b AS (SELECT item_id AS needle_id, text AS needle FROM benchmark UNION ALL SELECT 100000 + item_id, split_part(text, ' ', 3) FROM benchmark UNION ALL SELECT 200000 + item_id, concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3)) FROM benchmark)
SELECT needle_id, doc_id AS text_id, position(needle IN d.text) - 1 AS position FROM b JOIN documents d ON contains(d.text, needle) WHERE needle <> ''""")
def locate_passage_exact(t):
    def word(i):
        return F.split_part("text", F.lit(" "), F.lit(i))

    needles = t.benchmark.select(F.explode(F.array(
        *[F.struct((F.col("item_id") + shift).alias("needle_id"), needle.alias("needle")) for shift, needle in (
            (0, F.col("text")), (100000, word(3)), (200000, F.concat(word(2), F.lit(" "), word(3))))])).alias("n")).select("n.*").filter("needle <> ''")
    return op.locate_in_corpus(needles, t.documents.select(F.col("doc_id").alias("text_id"), "text"))


ENDED = f"""(SELECT book_id * 10 + page AS id, book_id, page, content, split_part(content, ' ', 2) AS marker, CASE WHEN role = 'user' THEN 'zqz' WHEN length(content) % 3 = 0 THEN NULL ELSE split_part(content, ' ', 6) END AS end_marker FROM {fx.PAGES_SQL})"""


@query("passage_text", f"""
WITH p AS (SELECT *, position(marker IN content) AS at FROM {ENDED} WHERE marker <> '' AND contains(content, marker)),
h AS (SELECT *, substr(content, at) AS tail, CASE WHEN end_marker IS NULL THEN NULL ELSE position(end_marker IN substr(content, at + length(marker))) END AS e FROM p),
pg AS (SELECT book_id, page, content AS c FROM {fx.PAGES_SQL})
SELECT h.id, CASE WHEN end_marker IS NULL THEN tail WHEN e > 0 THEN substr(tail, 1, length(marker) + e - 1)
  WHEN a.c IS NULL THEN tail WHEN contains(a.c, end_marker) THEN concat(tail, chr(10), chr(10), '% --- PAGE ', h.page + 1, ' ---', chr(10), chr(10), substr(a.c, 1, position(end_marker IN a.c) - 1))
  WHEN b.c IS NULL THEN concat(tail, chr(10), chr(10), '% --- PAGE ', h.page + 1, ' ---', chr(10), chr(10), a.c)
  ELSE concat(tail, chr(10), chr(10), '% --- PAGE ', h.page + 1, ' ---', chr(10), chr(10), a.c, chr(10), chr(10), '% --- PAGE ', h.page + 2, ' ---', chr(10), chr(10),
    CASE WHEN contains(b.c, end_marker) THEN substr(b.c, 1, position(end_marker IN b.c) - 1) ELSE b.c END) END AS body
FROM h LEFT JOIN pg a ON a.book_id = h.book_id AND a.page = h.page + 1 LEFT JOIN pg b ON b.book_id = h.book_id AND b.page = h.page + 2""".replace(" AS at ", " AS pos ").replace("content, at)", "content, pos)").replace("content, at +", "content, pos +"))
def passage_text(t):
    pairs = fx.pages(t).select(
        (F.col("book_id") * 10 + F.col("page")).alias("id"), "book_id", "page", "content", F.split_part("content", F.lit(" "), F.lit(2)).alias("marker"),
        F.when(F.col("role") == "user", "zqz").when(F.length("content") % 3 != 0, F.split_part("content", F.lit(" "), F.lit(6))).alias("end_marker"))
    located = op.locate_passage(pairs.select("id", "content", "marker")).filter("stage = 'exact'").select("id", "position")
    return op.passage_text(located, pairs, fx.pages(t).select("book_id", "page", "content"))


def placeholders(t):
    """Terms that lost their body; the page they name is one too high."""
    return fx.pages(t).select((F.col("book_id") * 10 + F.col("page")).alias("id"), "book_id", (F.col("page") + 1).alias("page"), F.concat(
        F.lit("% Term: x (marker: "), F.array_join(F.slice(F.split("content", " "), 2, 3), " "), F.lit(")")).alias("latex"))


@query("recover_placeholders", f"""
WITH p AS {fx.PAGES_SQL}, t AS (SELECT book_id * 10 + page AS id, book_id, page + 1 AS page, regexp_extract(concat('(marker: ', array_to_string(string_split(content, ' ')[2:4], ' '), ')'), '\\(marker: (.*?)\\)', 1) AS m FROM p),
h AS (SELECT t.id, min(p.page) AS page FROM t JOIN p ON p.book_id = t.book_id AND p.page BETWEEN t.page - 1 AND t.page + 2 AND contains(p.content, m) WHERE m <> '' GROUP BY 1)
SELECT h.id, h.page, substr(p.content, position(m IN p.content)) AS body FROM h JOIN t ON t.id = h.id JOIN p ON p.book_id = t.book_id AND p.page = h.page""")
def recover_placeholders(t):
    return op.recover_placeholders(placeholders(t), fx.pages(t).select("book_id", "page", "content"), fuzzy=False)


@query("recover_placeholders_fuzzy")
def recover_placeholders_fuzzy(t):
    damaged = placeholders(t).withColumn("latex", F.concat(F.lit("(marker: "), F.regexp_replace(F.regexp_extract("latex", r"\(marker: (.*?)\)", 1), "([a-z])e", "$1"), F.lit(")")))
    return op.recover_placeholders(damaged, fx.pages(t).select("book_id", "page", "content"))


@query("toc_metrics", """
WITH e AS (SELECT l_orderkey AS id, l_linenumber * 1000000 + l_partkey AS o, l_linenumber % 3 AS lvl, CASE l_returnflag WHEN 'R' THEN 0 ELSE l_partkey % 300 END AS p FROM lineitem),
w AS (SELECT *, last_value(CASE WHEN p > 0 THEN p END IGNORE NULLS) OVER (PARTITION BY id ORDER BY o, lvl, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp FROM e),
m AS (SELECT id, count(*) AS n, max(lvl) AS d, max(p) AS mp, count(*) FILTER (p > 0 AND p < lp) AS bad FROM w GROUP BY 1),
b AS (SELECT o_orderkey AS id, o_custkey % 400 AS pc, n, d, mp, bad FROM orders LEFT JOIN m ON m.id = o_orderkey WHERE o_orderpriority <> '5-LOW')
SELECT id, coalesce(n, 0) AS entries, coalesce(d, 0) AS depth, coalesce(mp, 0) AS max_page, array_to_string(list_filter([CASE WHEN n < 5 THEN 'SHORT' END, CASE WHEN d = 0 AND n > 10 THEN 'FLAT' END,
  CASE WHEN pc > 0 AND mp < pc * 0.7 THEN 'INCOMPLETE' END, CASE WHEN bad > 0 THEN 'DISORDERED' END, CASE WHEN n IS NULL THEN 'MISSING' END], lambda x: x IS NOT NULL), ',') AS flags FROM b""")
def toc_metrics(t):
    page = F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_partkey") % 300)
    level = F.col("l_linenumber") % 3
    entry = F.when(F.col("l_linestatus") == "F", F.format_string('{"level": %d, "title": "t", "pdf_page": %d, "page": %d}', level, page, page)).otherwise(F.format_string('[%d, "t", %d]', level, page))
    toc = t.lineitem.select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber") * 1000000 + F.col("l_partkey"), level, page, entry.alias("e")).alias("s")).groupBy("id").agg(
        F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("s"))["e"], ", "), F.lit("]")).alias("toc_json"))
    books = t.orders.join(toc, F.col("id") == F.col("o_orderkey"), "left").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 400).alias("page_count"), F.when(F.col("o_orderpriority") == "5-LOW", "not json [").otherwise(F.col("toc_json")).alias("toc_json"))
    return op.toc_metrics(books)


LISTED = f"""(SELECT book_id, page, concat('Chapter ', page, '.1 ', {fx.TITLE_SQL.replace('text', 'content')}, ' .... ', page + 3, chr(10), content, chr(10), '  ', page, ' Short  9', chr(10), page, '. x') AS content FROM {DOC_PAGES})"""


@query("toc_from_text", rf"""
WITH l AS (SELECT book_id, page, unnest(range(len(string_split(content, chr(10))))) AS line_no, list_transform(string_split(content, chr(10)), lambda x: trim(x)) AS ls FROM {LISTED}),
h AS (SELECT book_id, page, line_no, ls[line_no + 1] AS x FROM l WHERE length(ls[line_no + 1]) BETWEEN 5 AND 120 AND regexp_matches(ls[line_no + 1], '^((?:Chapter|Section|Part|Appendix)?\s*[\d\.]+\s+.*?)\s+[\.\s]*(\d+)$'))
SELECT book_id, page, line_no, trim(regexp_extract(x, '^((?:Chapter|Section|Part|Appendix)?\s*[\d\.]+\s+.*?)\s+[\.\s]*(\d+)$', 1)) AS title,
  CAST(regexp_extract(x, '^((?:Chapter|Section|Part|Appendix)?\s*[\d\.]+\s+.*?)\s+[\.\s]*(\d+)$', 2) AS BIGINT) AS target FROM h""")
def toc_from_text(t):
    page = F.col("page").cast("string")
    text = F.concat(F.lit("Chapter "), page, F.lit(".1 "), F.regexp_extract("content", r"^[^.\n]*", 0), F.lit(" .... "), (F.col("page") + 3).cast("string"), F.lit("\n"), "content", F.lit("\n  "), page, F.lit(" Short  9\n"), page, F.lit(". x"))
    return op.toc_from_text(doc_pages(t).select("book_id", "page", text.alias("content")))
