"""Filters, work lists and row rewrites over the driver tables."""

from pyspark.sql import functions as F

from bibliospark.operators import filters as op
from bibliospark.plans import fixtures as fx
from bibliospark.plans.registry import query


@query("browse_catalog", """
SELECT p_partkey AS id, p_name AS title, p_brand AS author, 1990 + p_size AS year, p_type AS msc_class FROM part
WHERE p_brand ILIKE '%brand%1%' AND (p_type ILIKE 'ECO%' OR p_type ILIKE '%, ECO%' OR p_type ILIKE 'SMA%' OR p_type ILIKE '%, SMA%')
  AND CAST(1990 + p_size AS VARCHAR) LIKE '200%' AND p_name ILIKE '%widget%'
ORDER BY year DESC, id LIMIT 100""")
def browse_catalog(t):
    books = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"),
                          (F.lit(1990) + F.col("p_size")).alias("year"), F.col("p_type").alias("msc_class"),
                          F.lit(None).cast("string").alias("summary"), F.lit("").alias("tags"))
    return op.browse_catalog(books, author="brand 1", msc="ECO, SMA", year="200", keyword="Widget").drop("summary", "tags")


def _books(t):
    return t.supplier.select(F.col("s_suppkey").alias("book_id"), F.col("s_name").alias("book_title"))


def _concepts(t):
    return t.nation.select(F.col("n_nationkey").cast("long").alias("concept_id"), F.col("n_name").alias("concept_name"))


@query("browse_terms_page", f"""
SELECT t.id, t.name, t.kind, t.status, t.book_id, t.concept_id, t.created_at, s.s_name AS book_title, n.n_name AS concept_name
FROM {fx.TERMS_SQL} t JOIN supplier s ON s.s_suppkey = t.book_id LEFT JOIN nation n ON n.n_nationkey = t.concept_id
WHERE status = 'approved' AND upper(substr(name, 1, 1)) = 'R' AND kind = 'theorem' ORDER BY name, id LIMIT 20 OFFSET 5""")
def browse_terms_page(t):
    return op.browse_terms_page(fx.terms(t), _books(t), _concepts(t), letter="r", kind="theorem", limit=20, offset=5)


@query("browse_terms_total", f"""SELECT count(*) AS total FROM {fx.TERMS_SQL} WHERE status = 'approved'""")
def browse_terms_total(t):
    return op.browse_terms_total(fx.terms(t), kind="remark")  # not a valid kind: no kind filter


@query("browse_terms_letters", f"""SELECT upper(substr(name, 1, 1)) AS letter, count(*) AS cnt FROM {fx.TERMS_SQL}
WHERE status = 'approved' AND kind = 'lemma' GROUP BY 1""")
def browse_terms_letters(t):
    return op.browse_terms_letters(fx.terms(t), kind="lemma")


@query("list_notes", """SELECT conv_id * 10 + turn AS id, text AS title, role AS source_type, conv_id AS book_id, conv_id AS created_at
FROM conversations WHERE role = 'user' ORDER BY created_at DESC, id LIMIT 50""")
def list_notes(t):
    notes = t.conversations.select((F.col("conv_id") * 10 + F.col("turn")).alias("id"), F.col("text").alias("title"),
                                   F.col("role").alias("source_type"), F.col("conv_id").alias("book_id"),
                                   F.col("conv_id").alias("created_at"))
    return op.list_notes(notes, source_type="user")


@query("bookmarks_with_book", """SELECT o_orderkey AS id, o_custkey AS book_id, o_orderpriority AS tags, c_name AS title
FROM orders JOIN customer ON c_custkey = o_custkey WHERE lower(o_orderpriority) LIKE '%high%'""")
def bookmarks_with_book(t):
    marks = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("book_id"), F.col("o_orderpriority").alias("tags"))
    books = t.customer.select(F.col("c_custkey").alias("book_id"), F.col("c_name").alias("title"))
    return op.bookmarks_with_book(marks, books, tag="High")


@query("bookmark_pages", f"""
WITH pages AS {fx.PAGES_SQL},
books AS (SELECT book_id, max(page) AS total, min(length(content)) % 9 AS a, max(length(content)) % 9 AS b FROM pages GROUP BY 1),
parts AS (SELECT book_id, total, a, b, 1 AS lo, a AS hi FROM books UNION ALL SELECT book_id, total, a, b, b, b FROM books
  UNION ALL SELECT book_id, total, a, b, a, b FROM books),
wanted AS (SELECT DISTINCT book_id, unnest(range(greatest(1, lo), least(hi, total) + 1)) AS page FROM parts)
SELECT w.book_id AS id, w.book_id, w.page, p.content FROM wanted w JOIN pages p USING (book_id, page)""")
def bookmark_pages(t):
    pages = fx.pages(t)
    size = F.length("content")
    books = pages.groupBy("book_id").agg(F.max("page").alias("total"), (F.min(size) % 9).alias("a"), (F.max(size) % 9).alias("b"))
    marks = books.select(F.col("book_id").alias("id"), "book_id", "total",
                         F.format_string("1-%d, %d, x, 2-3-4, %d - %d", "a", "b", "a", "b").alias("page_range"))
    return op.bookmark_pages(marks, pages.select("book_id", "page", "content"))


@query("page_work_list", """
WITH done AS (SELECT DISTINCT l_orderkey AS book_id, l_linenumber AS page, CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'ok' END AS status,
  l_linestatus = 'F' AS harvested FROM lineitem),
wanted AS (SELECT o_orderkey AS book_id, unnest(range(1, 8)) AS page FROM orders)
SELECT book_id, page, 'missing' AS mode FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.book_id = w.book_id AND d.page = w.page AND status = 'ok')
UNION ALL SELECT book_id, page, 'failed' FROM wanted w WHERE EXISTS (SELECT 1 FROM done d WHERE d.book_id = w.book_id AND d.page = w.page AND status = 'failed')
UNION ALL SELECT book_id, page, 'unharvested' FROM wanted w WHERE EXISTS (SELECT 1 FROM done d WHERE d.book_id = w.book_id AND d.page = w.page AND status = 'ok' AND NOT harvested)""")
def page_work_list(t):
    done = t.lineitem.select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("page"),
                             F.expr("CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'ok' END").alias("status"),
                             (F.col("l_linestatus") == "F").alias("harvested"))
    ranges = t.orders.select(F.col("o_orderkey").alias("book_id"), F.lit(1).alias("start"), F.lit(7).alias("end"))
    lists = [op.page_work_list(ranges, done, m).withColumn("mode", F.lit(m)) for m in ("missing", "failed", "unharvested")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


@query("enrich_candidates", """SELECT o_orderkey AS id, o_orderpriority AS title FROM orders
WHERE o_orderstatus <> 'P' AND o_orderpriority <> '4-NOT SPECIFIED' AND o_orderkey > 100""")
def enrich_candidates(t):
    books = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.expr("CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'Unknown' ELSE o_orderpriority END").alias("title"),
        F.expr("CASE o_orderstatus WHEN 'O' THEN 'raw' WHEN 'P' THEN 'verified' END").alias("metadata_status"))
    return op.enrich_candidates(books, after_id=100).select("id", "title")


@query("prose_repair_candidates", r"""
WITH terms AS (SELECT doc_id AS id, CASE source WHEN 'src2' THEN concat(text, ' \text{x}') ELSE text END AS latex, toxic AS attempted
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT id FROM terms WHERE (contains(lower(latex), ' is ') OR contains(lower(latex), ' the ') OR contains(lower(latex), ' of '))
  AND NOT contains(latex, '\text{') AND coalesce(attempted, 0) = 0""")
def prose_repair_candidates(t):
    terms = t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("attempted"),
        F.when(F.col("source") == "src2", F.concat("text", F.lit(r" \text{x}"))).otherwise(F.col("text")).alias("latex"))
    return op.prose_repair_candidates(terms).select("id")


ARTIFACT_NAME = """concat({title}, CASE source WHEN 'src1' THEN ' (subject index)' WHEN 'src2' THEN ' (Index), Page 4'
  WHEN 'src3' THEN ' (page 9)' WHEN 'src4' THEN ' Index' ELSE '' END)"""


@query("index_artifact_terms", f"""
WITH terms AS (SELECT doc_id AS id, {ARTIFACT_NAME.format(title=fx.TITLE_SQL)} AS name FROM documents)
SELECT id, name FROM terms WHERE contains(lower(name), '(subject index)') OR contains(lower(name), '(name index)')
  OR contains(lower(name), '(symbol index)') OR contains(lower(name), '(index)') OR contains(lower(name), ', page ') OR contains(lower(name), '(page ')""")
def index_artifact_terms(t):
    terms = t.documents.withColumn("title", fx.title()).select(
        F.col("doc_id").alias("id"), F.expr(ARTIFACT_NAME.format(title="title")).alias("name"))
    return op.index_artifact_terms(terms)


@query("corrupted_terms", r"""
SELECT source AS book_id, n_chars // 100 AS page, count(*) AS bad_terms FROM documents
WHERE contains(CASE lang WHEN 'de' THEN replace(text, chr(10), chr(10) || '### ') ELSE text END, '### ') GROUP BY 1, 2""")
def corrupted_terms(t):
    terms = t.documents.select(
        F.col("source").alias("book_id"), F.floor(F.col("n_chars") / 100).alias("page"),
        F.when(F.col("lang") == "de", F.replace("text", F.lit("\n"), F.lit("\n### "))).otherwise(F.col("text")).alias("latex"))
    return op.corrupted_pages(terms)


@query("metadata_cleanup", rf"""
WITH raw AS (SELECT doc_id AS id, source, lang, {fx.TITLE_SQL} AS t0, path,
  CASE lang WHEN 'en' THEN 'Unknown' WHEN 'de' THEN '' ELSE source END AS author0 FROM documents JOIN {fx.BOOKS_SQL} b ON b.id = doc_id),
books AS (SELECT id, path, author0, CASE source WHEN 'src1' THEN concat('  ', t0, ' - Vol ', lang, ' - ', source) WHEN 'src2' THEN NULL
  WHEN 'src4' THEN concat(lang, ' mathematics series') WHEN 'src6' THEN concat(t0, ': ', t0, '. ', t0, t0, t0) ELSE t0 END AS title0 FROM raw),
s1 AS (SELECT *, (author0 IN ('', 'Unknown')) AND contains(title0, ' - ') AS sp, string_split(title0, ' - ') AS parts FROM books),
s2 AS (SELECT id, path, CASE WHEN sp THEN trim(array_to_string(parts[1:len(parts)-1], ' - ')) ELSE title0 END AS t1,
  CASE WHEN sp THEN trim(parts[len(parts)]) ELSE author0 END AS author FROM s1),
s3 AS (SELECT *, trim(split_part(split_part(t1, '. ', 1), ': ', 1)) AS c FROM s2),
s4 AS (SELECT *, CASE WHEN length(t1) > 150 THEN CASE WHEN length(c) > 150 THEN substr(c, 1, 147) || '...' ELSE c END ELSE t1 END AS t2 FROM s3)
SELECT id, author, CASE WHEN t2 IS NULL OR t2 = '' OR (contains(lower(t2), 'mathematics series') AND length(t2) < 50)
    THEN regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') ELSE t2 END AS title,
  CASE WHEN t2 <> t1 THEN concat(chr(10), 'Original Title: ', t1) END AS description FROM s4""")
def metadata_cleanup(t):
    t0 = F.col("title")
    title = (F.when(F.col("author") == "src1", F.concat(F.lit("  "), t0, F.lit(" - Vol "), "language", F.lit(" - "), "author"))
             .when(F.col("author") == "src2", F.lit(None))
             .when(F.col("author") == "src4", F.concat("language", F.lit(" mathematics series")))
             .when(F.col("author") == "src6", F.concat(t0, F.lit(": "), t0, F.lit(". "), t0, t0, t0)).otherwise(t0))
    books = fx.books(t).select(
        "id", "path", title.alias("title"), F.lit(None).cast("string").alias("description"),
        F.when(F.col("language") == "en", "Unknown").when(F.col("language") == "de", "").otherwise(F.col("author")).alias("author"))
    return op.metadata_cleanup(books).select("id", "author", "title", "description")


@query("clear_index", """SELECT s_suppkey AS id, CASE WHEN s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 3) THEN s_name END AS index_text,
  CASE WHEN s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 3) THEN s_nationkey END AS index_version FROM supplier""")
def clear_index(t):
    books = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("index_text"), F.col("s_nationkey").alias("index_version"))
    return op.clear_index(books, t.lineitem.filter("l_returnflag = 'R' AND l_quantity < 3").select(F.col("l_suppkey").alias("id")))


@query("metadata_patch", """
SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN upper(c_name) ELSE c_name END AS title,
  CASE WHEN c_nationkey < 10 THEN NULL ELSE c_mktsegment END AS author,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1999 ELSE 2000 + c_nationkey END AS year FROM customer""")
def metadata_patch(t):
    books = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"),
                              (F.lit(2000) + F.col("c_nationkey")).alias("year"))
    c = t.customer
    patch = (
        c.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("id"), F.lit("title").alias("field"), F.upper("c_name").alias("value"))
        .unionByName(c.filter("c_nationkey < 10").select(F.col("c_custkey").alias("id"), F.lit("author").alias("field"), F.lit(None).cast("string").alias("value")))
        .unionByName(c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.lit("year").alias("field"), F.lit("1999").alias("value")))
        .unionByName(c.select(F.col("c_custkey").alias("id"), F.lit("path").alias("field"), F.lit("ignored").alias("value"))))
    return op.metadata_patch(books, patch)


@query("conflict_resolution", """
SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' AND c_name IS NOT NULL THEN c_name ELSE o_orderpriority END AS title,
  CASE WHEN o_orderpriority = '1-URGENT' AND c_name IS NOT NULL THEN 'verified' WHEN o_orderpriority = '5-LOW' THEN 'raw' ELSE o_orderstatus END AS metadata_status,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS zbl_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN 0.0 ELSE o_totalprice END AS trust_score
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'FURNITURE') ON c_custkey = o_custkey""")
def conflict_resolution(t):
    books = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("metadata_status"),
                            F.col("o_custkey").alias("zbl_id"), F.col("o_totalprice").alias("trust_score"))
    decisions = t.orders.filter("o_orderpriority in ('1-URGENT', '5-LOW')").select(
        F.col("o_orderkey").alias("id"), F.expr("CASE o_orderpriority WHEN '5-LOW' THEN 'reject' ELSE 'accept' END").alias("action"))
    registry = t.customer.filter("c_mktsegment <> 'FURNITURE'").select(F.col("c_custkey").alias("zbl_id"), F.col("c_name").alias("zb_title"))
    return op.conflict_resolution(books, decisions, registry)
