"""Joins over the driver tables."""

from pyspark.sql import functions as F

from bibliospark.operators import joins as op
from bibliospark.plans import fixtures as fx
from bibliospark.plans.registry import query


@query("book_detail", """
SELECT c_custkey AS id, c_nationkey AS zbl_id, c_name AS title, n_name AS zb_title,
  CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS INT) AS has_index,
  CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS INT) AS has_toc,
  CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS INT) AS has_deep,
  CAST(EXISTS (SELECT 1 FROM embeddings WHERE vec_id = c_custkey) AS INT) AS has_embedding
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey""")
def book_detail(t):
    books = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("zbl_id"), F.col("c_name").alias("title"))
    registry = t.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("zbl_id"), F.col("n_name").alias("zb_title"))
    key = F.col("o_custkey").alias("id")
    return op.book_detail(
        books, registry, index=t.orders.filter("o_orderstatus = 'O'").select(key),
        toc=t.orders.filter("o_orderpriority = '1-URGENT'").select(key), deep=t.orders.filter("o_totalprice > 400000").select(key),
        embedding=t.embeddings.select(F.col("vec_id").alias("id")))


@query("bibliography_view", """
SELECT book_id, id, zbl_id, p_name AS zb_title FROM (SELECT l_suppkey AS book_id, l_orderkey * 10 + l_linenumber AS id, l_partkey AS zbl_id FROM lineitem) x
LEFT JOIN (SELECT * FROM part WHERE p_type <> 'PROMO') ON p_partkey = zbl_id""")
def bibliography_view(t):
    entries = t.lineitem.select(F.col("l_suppkey").alias("book_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("zbl_id"))
    registry = t.part.filter("p_type <> 'PROMO'").select(F.col("p_partkey").alias("zbl_id"), F.col("p_name").alias("zb_title"))
    return op.bibliography_view(entries, registry)


@query("conflicts_view", """
SELECT o_orderkey AS id, o_custkey AS zbl_id, o_orderpriority AS local_title, c_name AS zb_title
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey WHERE o_orderstatus = 'P'""")
def conflicts_view(t):
    books = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("zbl_id"), F.col("o_orderpriority").alias("local_title"),
                            F.expr("CASE o_orderstatus WHEN 'P' THEN 'conflict' ELSE 'verified' END").alias("metadata_status"))
    registry = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("zbl_id"), F.col("c_name").alias("zb_title"))
    return op.conflicts_view(books, registry).drop("metadata_status")


def _lines(t):
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("book_id"),
                             F.col("l_suppkey").alias("concept_id"), F.col("l_returnflag").alias("kind"))


def _part_books(t):
    return t.part.select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("book_title"), F.col("p_brand").alias("book_author"),
                         F.col("p_type").alias("msc_class"), F.col("p_size").cast("long").alias("year"))


@query("term_detail", """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS book_id, l_suppkey AS concept_id, l_returnflag AS kind,
  p_name AS book_title, p_brand AS book_author, p_type AS msc_class, CAST(p_size AS BIGINT) AS year FROM lineitem JOIN part ON p_partkey = l_partkey""")
def term_detail(t):
    return op.term_detail(_lines(t), _part_books(t))


@query("term_enrich", """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS book_id, l_suppkey AS concept_id, l_returnflag AS kind,
  p_name AS book_title, p_brand AS book_author, p_type AS msc_class, CAST(p_size AS BIGINT) AS year, s_name AS concept_name
FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 1000) ON s_suppkey = l_suppkey
WHERE contains(p_type, 'MO') AND p_size = 7""")
def term_enrich(t):
    concepts = t.supplier.filter("s_acctbal > 1000").select(F.col("s_suppkey").alias("concept_id"), F.col("s_name").alias("concept_name"))
    return op.term_enrich(_lines(t), _part_books(t), concepts, msc="MO", year=7)


@query("note_relations_view", """
WITH rel AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey <> l_suppkey),
sym AS (SELECT a, b FROM rel UNION SELECT b, a FROM rel)
SELECT a AS note_id, 'note' AS kind, b AS target_id, p_name AS target_title FROM sym JOIN part ON p_partkey = b
UNION ALL SELECT n, 'book', o, o_orderpriority FROM (SELECT DISTINCT l_partkey AS n, l_orderkey AS o FROM lineitem) JOIN orders ON o_orderkey = o""")
def note_relations_view(t):
    relations = t.lineitem.select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"))
    notes = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    note_books = t.lineitem.select(F.col("l_partkey").alias("note_id"), F.col("l_orderkey").alias("book_id"))
    books = t.orders.select(F.col("o_orderkey").alias("book_id"), F.col("o_orderpriority").alias("title"))
    return op.note_relations_view(relations, notes, note_books, books)


@query("books_with_terms", """SELECT p_partkey AS book_id, p_name AS title FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)""")
def books_with_terms(t):
    books = t.part.select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"))
    return op.books_with_terms(books, t.lineitem.filter("l_quantity > 48").select(F.col("l_partkey").alias("book_id")))


@query("undone_books", """SELECT c_custkey AS book_id, c_name AS title FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def undone_books(t):
    books = t.customer.select(F.col("c_custkey").alias("book_id"), F.col("c_name").alias("title"))
    return op.undone(books, t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("book_id")))


@query("orphan_ids", """SELECT DISTINCT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)""")
def orphan_ids(t):
    return op.orphan_ids(t.embeddings.select(F.col("vec_id").alias("id")), t.labels.select(F.col("doc_id").alias("id")))


@query("ghost_records", f"""
WITH b AS (SELECT *, md5(content) AS hash FROM {fx.BOOKS_SQL}),
cat AS (SELECT id, CASE author WHEN 'src2' THEN 'moved/' || path ELSE path END AS path, hash FROM b WHERE language <> 'es' AND author <> 'src9'),
lst AS (SELECT path, hash FROM b WHERE author <> 'src4')
SELECT path, 'MISSING' AS state FROM cat WHERE path NOT IN (SELECT path FROM lst)
UNION ALL SELECT path, CASE WHEN EXISTS (SELECT 1 FROM cat c WHERE c.path = lst.path AND c.hash = lst.hash) THEN 'INDEXED'
  WHEN hash IN (SELECT hash FROM cat) THEN 'REDUNDANT' ELSE 'UNIQUE' END FROM lst""")
def ghost_records(t):
    books = fx.books(t).withColumn("hash", F.md5("content"))
    catalogue = books.filter("language <> 'es' AND author <> 'src9'").select(
        "id", F.when(F.col("author") == "src2", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), "hash")
    return op.ghost_records(catalogue, books.filter("author <> 'src4'").select("path", "hash"))


@query("terms_on_hit_pages", f"""
WITH terms AS (SELECT l_orderkey AS book_id, l_linenumber AS page, string_agg(concat(l_partkey, ' (', l_returnflag, ')'), ', ' ORDER BY concat(l_partkey, ' (', l_returnflag, ')')) AS terms
  FROM lineitem GROUP BY 1, 2)
SELECT p.book_id, p.page, terms FROM {fx.PAGES_SQL} p LEFT JOIN terms t ON t.book_id = p.book_id AND t.page = p.page WHERE role = 'user'""")
def terms_on_hit_pages(t):
    hits = fx.pages(t).filter("role = 'user'").select("book_id", "page")
    terms = t.lineitem.select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").cast("long").alias("page"),
                              F.col("l_partkey").cast("string").alias("name"), F.col("l_returnflag").alias("kind"))
    return op.terms_on_pages(hits, terms)


@query("chapter_list", """SELECT l_orderkey AS book_id, l_linenumber AS id, l_partkey AS page FROM lineitem ORDER BY 1, 2""")
def chapter_list(t):
    return op.chapter_list(t.lineitem.select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("page")))


NAME = r"^(\p{L}+)[^\p{L}]+(\p{L}+)"


@query("expand_author_initials", rf"""
WITH a AS (SELECT DISTINCT concat(regexp_extract(text, '{NAME}', 1), ' ', regexp_extract(text, '{NAME}', 2)) AS variant FROM documents),
q AS (SELECT DISTINCT concat(regexp_extract(text, '{NAME}', 1)[1], '. ', regexp_extract(text, '{NAME}', 2)) AS author FROM documents WHERE lang <> 'fr'),
p AS (SELECT author, regexp_extract(author, '\b([A-Z])\.\s*([\p{{L}}]+)', 1) AS i, lower(regexp_extract(author, '\b([A-Z])\.\s*([\p{{L}}]+)', 2)) AS s FROM q),
h AS (SELECT author, variant FROM p, a WHERE i <> '' AND contains(lower(variant), s) AND starts_with(variant, i) AND contains(variant, ' '))
SELECT * FROM h UNION ALL SELECT author, author FROM q WHERE author NOT IN (SELECT author FROM h)""")
def expand_author_initials(t):
    first, last = F.regexp_extract("text", NAME, 1), F.regexp_extract("text", NAME, 2)
    authors = t.documents.select(F.concat(first, F.lit(" "), last).alias("author"))
    queries = t.documents.filter("lang <> 'fr'").select(F.concat(F.substring(first, 1, 1), F.lit(". "), last).alias("author"))
    return op.expand_author_initials(queries, authors)


@query("registry_link")
def registry_link(t):
    b = t.benchmark.select(F.col("item_id").alias("id"), F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"), F.lit("Unknown").alias("author"))
    own = fx.books(t).select((F.col("id") + 1000000).alias("id"), F.concat("title", F.lit(": vol. 1")).alias("title"), F.concat(F.lit("A. "), "author").alias("author"))
    registry = fx.books(t).select(F.col("id").alias("zbl_id"), F.col("title").alias("zb_title"), F.col("author").alias("zb_authors"))
    return op.registry_link(b.unionByName(own), registry)


@query("verify_by_identifier", """
SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN p_partkey IS NULL THEN NULL WHEN l_returnflag = 'A' THEN 'ISBN' ELSE 'DOI' END AS source, p_partkey AS reg_id
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON p_partkey = l_partkey AND l_returnflag <> 'N'""")
def verify_by_identifier(t):
    part = F.col("l_partkey").cast("string")
    books = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("978-"), F.lpad(part, 10, "0"))).alias("isbn"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit(" https://doi.org/10.1007/b"), part, F.lit("_"), F.col("l_linenumber").cast("string"))).alias("doi"))
    registry = t.part.filter("p_size > 5").select(
        F.col("p_partkey").alias("reg_id"), F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("isbn"),
        F.concat(F.lit("10.1007/b"), F.col("p_partkey").cast("string")).alias("doi"))
    return op.verify_by_identifier(books, registry)


@query("enrich_rules", f"""
WITH b AS (SELECT *, CASE author WHEN 'src0' THEN 'Untitled' ELSE title END AS t, CASE author WHEN 'src1' THEN 'Unknown' ELSE author END AS a, (year % 20) / 20.0 AS sim FROM {fx.BOOKS_SQL}),
g AS (SELECT *, language = 'german' OR list_has_any(string_split_regex(lower(t), '\\s+'), ['und','der','die','das','für','lehrbuch','grundzüge','einführung','vorlesungen']) AS de FROM b)
SELECT id, CASE WHEN de AND t <> 'Untitled' THEN t ELSE upper(path) END AS title, CASE WHEN a = 'Unknown' THEN path ELSE a END AS author,
  CASE WHEN t IN ('Untitled', '') OR sim > 0.85 THEN 'verified' ELSE 'conflict' END AS metadata_status,
  CASE WHEN t IN ('Untitled', '') THEN 1.0 ELSE sim END AS trust_score FROM g""")
def enrich_rules(t):
    pairs = fx.books(t).select(
        "id", "language", F.when(F.col("author") == "src0", "Untitled").otherwise(F.col("title")).alias("title"),
        F.when(F.col("author") == "src1", "Unknown").otherwise(F.col("author")).alias("author"),
        F.upper("path").alias("zb_title"), F.col("path").alias("zb_authors"), ((F.col("year") % 20) / 20.0).alias("similarity"))
    return op.enrich_rules(pairs)


@query("enrich_from_registry")
def enrich_from_registry(t):
    books = fx.books(t).select("id", F.col("id").alias("zbl_id"), "title", "author", F.when(F.col("language") == "de", "german").alias("language"))
    registry = fx.books(t).select(F.col("id").alias("zbl_id"), F.concat(F.lit("On "), F.upper("title")).alias("zb_title"), F.col("author").alias("zb_authors"))
    return op.enrich_from_registry(books, registry)


@query("citation_edges", """SELECT DISTINCT l_orderkey AS book_id, l_partkey AS zbl_id FROM lineitem l WHERE l_returnflag <> 'N'
  AND NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_orderkey = l.l_orderkey AND e.l_partkey = l.l_partkey AND e.l_linestatus = 'F')""")
def citation_edges(t):
    entries = t.lineitem.select(F.col("l_orderkey").alias("book_id"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("zbl_id"))
    existing = t.lineitem.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("book_id"), F.col("l_partkey").alias("zbl_id"))
    return op.citation_edges(entries, existing)


@query("citation_query_clean", r"""
WITH raw AS (SELECT item_id AS id, concat('[', item_id, ']  ', text, ' p. ', length(text), ' ff.') AS raw FROM benchmark)
SELECT id, regexp_replace(regexp_replace(regexp_replace(raw, '^\[\d+\]\s*', ''), '(?m)p\.\s*\d+.*$', '', 'g'), '^\s+|\s+$', '', 'g') AS match_key FROM raw""")
def citation_query_clean(t):
    raw = F.concat(F.lit("["), F.col("item_id").cast("string"), F.lit("]  "), "text", F.lit(" p. "), F.length("text").cast("string"), F.lit(" ff."))
    return t.benchmark.select(F.col("item_id").alias("id"), op.citation_key(raw).alias("match_key"))


@query("page_neighbourhood", f"""
WITH p AS {fx.PAGES_SQL}, terms AS (SELECT book_id * 10 + page AS id, book_id, greatest(page - 2, 1) AS page, split_part(content, ' ', 2) AS marker FROM p)
SELECT t.id, t.book_id, min(p.page) AS page FROM terms t JOIN p ON p.book_id = t.book_id AND p.page BETWEEN t.page - 1 AND t.page + 2 AND contains(p.content, t.marker) GROUP BY 1, 2""")
def page_neighbourhood(t):
    pages = fx.pages(t)
    terms = pages.select((F.col("book_id") * 10 + F.col("page")).alias("id"), "book_id", F.greatest(F.col("page") - 2, F.lit(1)).alias("page"),
                         F.split_part("content", F.lit(" "), F.lit(2)).alias("marker"))
    return op.page_neighbourhood(terms, pages)
