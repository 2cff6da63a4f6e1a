"""Deduplication and matching over the driver tables."""

from pyspark.sql import functions as F

from bibliospark.functions import text as tx
from bibliospark.operators import matcher, resolve as op
from bibliospark.plans import fixtures as fx
from bibliospark.plans.registry import query


@query("content_hash", f"SELECT id, CASE WHEN author = 'src1' THEN 'known' ELSE sha256(content) END AS file_hash FROM {fx.BOOKS_SQL}")
def content_hash(t):
    return op.content_hash(fx.books(t).withColumn("file_hash", F.when(F.col("author") == "src1", "known")))


IDENTIFIED = f"""(SELECT id, path, sha256(content) AS file_hash, CASE author WHEN 'src1' THEN '' WHEN 'src2' THEN NULL ELSE concat('978', length(content)) END AS isbn,
  CASE language WHEN 'de' THEN 'Unknown' WHEN 'es' THEN NULL ELSE concat('10.1/', length(title)) END AS doi FROM {fx.BOOKS_SQL})"""
RANK = "CASE WHEN contains(path, '99_General_and_Diverse/Unsorted') THEN 1000 ELSE 0 END + length(path)"


def identified(t):
    b = fx.books(t)
    return b.select(
        "id", "path", F.sha2("content", 256).alias("file_hash"),
        F.when(F.col("author") == "src1", "").when(F.col("author") != "src2", F.concat(F.lit("978"), F.length("content").cast("string"))).alias("isbn"),
        F.when(F.col("language") == "de", "Unknown").when(F.col("language") != "es", F.concat(F.lit("10.1/"), F.length("title").cast("string"))).alias("doi"))


def groups_sql(key: str, source: str) -> str:
    skip = " AND doi <> 'Unknown'" if key == "doi" else ""
    return f"""SELECT '{key}' AS kind, {key} AS key, id, first_value(id) OVER (PARTITION BY {key} ORDER BY {RANK}, id) AS survivor, count(*) OVER (PARTITION BY {key}) AS n
  FROM {source} WHERE {key} IS NOT NULL AND {key} <> ''{skip} QUALIFY n > 1"""


@query("duplicate_groups", " UNION ALL ".join(f"SELECT * FROM ({groups_sql(k, IDENTIFIED)})" for k in ("file_hash", "isbn", "doi", "path")))
def duplicate_groups(t):
    return op.duplicate_report(identified(t), ["file_hash", "isbn", "doi", "path"])


@query("duplicate_resolve", f"""
WITH b AS {IDENTIFIED}, m AS (SELECT id FROM b WHERE contains(path, 'src9/')), s0 AS (SELECT * FROM b WHERE id NOT IN (FROM m)),
g1 AS (SELECT id FROM ({groups_sql('file_hash', 's0')}) WHERE id <> survivor), s1 AS (SELECT * FROM s0 WHERE id NOT IN (FROM g1)),
g2 AS (SELECT id FROM ({groups_sql('isbn', 's1')}) WHERE id <> survivor), s2 AS (SELECT * FROM s1 WHERE id NOT IN (FROM g2)),
g3 AS (SELECT id FROM ({groups_sql('doi', 's2')}) WHERE id <> survivor)
SELECT id, 'missing' AS removed_by FROM m UNION ALL SELECT id, 'file_hash' FROM g1 UNION ALL SELECT id, 'isbn' FROM g2 UNION ALL SELECT id, 'doi' FROM g3""")
def duplicate_resolve(t):
    books = identified(t)
    return op.duplicate_resolve(books, books.filter(~F.contains("path", F.lit("src9/"))).select("path"), ["file_hash", "isbn", "doi"])


STORED = f"(SELECT *, md5(content) AS hash FROM {fx.BOOKS_SQL} WHERE language IN ('en', 'fr'))"
INCOMING = f"""(SELECT id, CASE author WHEN 'src3' THEN md5(concat(content, 'x')) ELSE md5(content) END AS hash, CASE author WHEN 'src4' THEN concat(title, ': new') ELSE title END AS title,
  CASE author WHEN 'src5' THEN NULL ELSE author END AS author FROM {fx.BOOKS_SQL})"""


@query("incoming_duplicate", rf"""
WITH c AS {STORED}, i AS {INCOMING}, h AS (SELECT i.id, 'HASH' AS kind, min(c.id) AS match_id FROM i JOIN c ON c.hash = i.hash WHERE NOT contains(c.path, '99_General_and_Diverse/Unsorted') GROUP BY 1),
o AS (SELECT id, list_filter(string_split_regex(replace(lower(title), ':', ''), '\s+'), lambda x: x <> '')[1] AS w, lower(coalesce(author, '')) AS a FROM i WHERE id NOT IN (SELECT id FROM h)),
d AS (SELECT DISTINCT w, a FROM o WHERE length(w) > 4), m AS (SELECT w, a, min(c.id) AS match_id FROM d JOIN c ON contains(lower(c.title), w) AND contains(lower(c.author), a) GROUP BY 1, 2)
SELECT * FROM h UNION ALL SELECT o.id, 'SEMANTIC', match_id FROM o JOIN m USING (w, a)""")
def incoming_duplicate(t):
    b = fx.books(t)
    stored = b.filter("language IN ('en', 'fr')").select("id", "path", F.md5("content").alias("hash"), "title", "author")
    incoming = b.select(
        "id", F.when(F.col("author") == "src3", F.md5(F.concat("content", F.lit("x")))).otherwise(F.md5("content")).alias("hash"),
        F.when(F.col("author") == "src4", F.concat("title", F.lit(": new"))).otherwise(F.col("title")).alias("title"), F.when(F.col("author") != "src5", F.col("author")).alias("author"))
    return op.incoming_duplicate(incoming, stored, ignore_unsorted=True)


EDITION = f"""concat({{0}}, CASE lang WHEN 'en' THEN ' (2nd ed.), Vol-3' WHEN 'fr' THEN ': Revised  Edition' WHEN 'de' THEN ' 12th edition' ELSE ' International edition' END)"""
STOP = "'" + "','".join(tx.STOPWORDS) + "'"


@query("normalize_text", rf"""
WITH t AS (SELECT doc_id AS id, lower({EDITION.format(fx.TITLE_SQL)}) AS x FROM documents),
n AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\(\d+(?:st|nd|rd|th)?\s*ed\.?\)', '', 'g'), '\d+(?:st|nd|rd|th)?\s*edition', '', 'g'), 'revised\s+edition', '', 'g'),
  'international\s+edition', '', 'g'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS normalized FROM t), w AS (SELECT *, list_filter(string_split(normalized, ' '), lambda x: x <> '') AS a FROM n)
SELECT id, normalized, array_to_string(CASE WHEN len(list_filter(a, lambda x: x NOT IN ({STOP}))) > 0 THEN list_filter(a, lambda x: x NOT IN ({STOP})) ELSE a END, ' ') AS tokens FROM w""")
def normalize_text(t):
    rows = t.documents.withColumn("title", fx.title()).select(F.col("doc_id").alias("id"), F.expr(EDITION.format("title")).alias("x"))
    return rows.select("id", tx.normalize_title("x").alias("normalized"), F.array_join(tx.title_tokens("x"), " ").alias("tokens"))


def part_books(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"))


@query("match_exact", """
WITH q AS (SELECT DISTINCT upper(p_name) AS title, CASE WHEN p_size > 25 THEN lower(p_brand) ELSE '' END AS author FROM part)
SELECT title, q.author, min(p_partkey) AS id, 1.0::DOUBLE AS score, 'exact' AS strategy FROM q JOIN part ON lower(p_name) = lower(title) AND (q.author = '' OR lower(p_brand) = q.author) GROUP BY 1, 2""")
def match_exact(t):
    asked = t.part.select(F.upper("p_name").alias("title"), F.when(F.col("p_size") > 25, F.lower("p_brand")).alias("author"))
    return matcher.match_exact(matcher.distinct_requests(asked), matcher.distinct_books(part_books(t)))


@query("match_normalized", f"""
WITH b AS (SELECT id, translate(lower(title), '-.,', ' ') AS t, translate(lower(author), '-.,', ' ') AS a FROM {fx.BOOKS_SQL}),
q AS (SELECT DISTINCT concat(title, ' (3rd ed.)') AS title, CASE WHEN language = 'es' THEN '' ELSE upper(author) END AS author FROM {fx.BOOKS_SQL} WHERE title <> ''),
n AS (SELECT title, author, trim(regexp_replace(replace(lower(title), '(3rd ed.)', ''), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS t, lower(author) AS a FROM q WHERE author <> '')
SELECT title, author, min(b.id) AS id, 0.95::DOUBLE AS score, 'normalized' AS strategy FROM n JOIN b ON contains(b.t, n.t) AND contains(b.a, n.a) WHERE n.t <> '' GROUP BY 1, 2""")
def match_normalized(t):
    asked = fx.books(t).filter("title <> ''").select(F.concat("title", F.lit(" (3rd ed.)")).alias("title"), F.when(F.col("language") != "es", F.upper("author")).alias("author"))
    return matcher.match_normalized(matcher.distinct_requests(asked), matcher.distinct_books(fx.books(t)))


def misspelt(t):
    """Part names with a letter lost, brands kept."""
    return t.part.select(F.regexp_replace("p_name", "(.)([aeiou])(.)$", "$1$3").alias("title"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("author"))


@query("match_fuzzy")
def match_fuzzy(t):
    return matcher.match_fuzzy(matcher.distinct_requests(misspelt(t)), matcher.distinct_books(part_books(t)))


@query("match_token")
def match_token(t):
    asked = t.part.select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(": a "), "p_type").alias("title"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("author"))
    return matcher.match_token(matcher.distinct_requests(asked), matcher.distinct_books(part_books(t)))


@query("match_cascade")
def match_cascade(t):
    exact = t.part.select(F.col("p_partkey").alias("query_id"), F.upper("p_name").alias("title"), F.col("p_brand").alias("author"))
    typo = misspelt(t).withColumn("query_id", F.lit(-1).cast("long"))
    cited = t.benchmark.select((F.col("item_id") + 10000000).alias("query_id"), fx.title().alias("title"), F.lit(None).cast("string").alias("author"))
    return matcher.match_cascade(exact.unionByName(typo).unionByName(cited), part_books(t))


@query("wishlist_acquired")
def wishlist_acquired(t):
    wishes = t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), F.lower(F.substring("p_type", 1, 2))).alias("title"))
    return matcher.wishlist_acquired(wishes, part_books(t))


def page_terms(t):
    """Pages as terms, each with a slightly changed copy on the next page but one."""
    pages = fx.pages(t)
    own = pages.select((F.col("book_id") * 100 + F.col("page")).alias("id"), "book_id", "page", F.col("content").alias("latex"))
    copies = pages.select((F.col("book_id") * 100 + 50 + F.col("page")).alias("id"), "book_id", (F.col("page") + 2).alias("page"), F.regexp_replace("content", "en", "an").alias("latex"))
    same = pages.filter("role = 'system'").select((F.col("book_id") * 100 + 80 + F.col("page")).alias("id"), "book_id", "page", F.col("content").alias("latex"))
    return own.unionByName(copies).unionByName(same)


@query("near_dup_pairs")
def near_dup_pairs(t):
    return op.near_dup_pairs(page_terms(t))


@query("near_dup_delete")
def near_dup_delete(t):
    return op.near_dup_delete(op.near_dup_pairs(page_terms(t)))


@query("term_insert_filter")
def term_insert_filter(t):
    pages = fx.pages(t)
    new = pages.select((F.col("book_id") * 10 + F.col("page")).alias("id"), "book_id", "page", F.split_part("content", F.lit(" "), F.lit(1)).alias("name"),
                       F.when(F.col("role") == "system", "Proof").otherwise("theorem").alias("kind"), F.col("content").alias("latex"))
    known = pages.filter("role = 'user'").select((F.col("book_id") * 10 + F.col("page")).alias("id"), "book_id", (F.col("page") + 1).alias("page"),
                                                 F.lit("x").alias("name"), F.regexp_replace("content", "e", "a").alias("latex"))
    return op.term_insert_filter(new, known).select("id", "book_id", "page", "name")


@query("term_insert_pass2", """
WITH n AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS book_id, concat(l_returnflag, l_linestatus) AS name FROM lineitem),
k AS (SELECT o_orderkey AS book_id, lower(concat(o_orderstatus, 'F')) AS name FROM orders)
SELECT min(id) AS id, book_id, arg_min(name, id) AS name FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.book_id = n.book_id AND k.name = lower(n.name)) GROUP BY book_id, lower(name)""")
def term_insert_pass2(t):
    new = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("book_id"), F.concat("l_returnflag", "l_linestatus").alias("name"))
    known = t.orders.select(F.col("o_orderkey").alias("book_id"), F.lower(F.concat("o_orderstatus", F.lit("F"))).alias("name"))
    return op.term_insert_by_name(new, known)


CONCEPT_NAME = "CASE p_type WHEN 'PROMO' THEN concat('Theorem 3.1: ', p_name) WHEN 'SMALL' THEN concat('1.', CAST(p_size AS {0}), ' ', p_name) WHEN 'LARGE' THEN upper(p_name) WHEN 'MEDIUM' THEN concat('lemma x ', p_name) ELSE p_name END"


MERGE_SQL = rf"""
WITH c AS (SELECT p_partkey AS id, {CONCEPT_NAME.format('VARCHAR')} AS name, p_brand AS subject_area FROM part),
d AS (SELECT *, contains(name, ':') OR regexp_matches(lower(name), '^(theorem|lemma|proposition|corollary|definition|example|remark) ') OR regexp_matches(name, '^[1-9]\.') AS dirty FROM c),
k AS (SELECT *, CASE WHEN dirty THEN trim(regexp_replace(regexp_replace(name, '^(Theorem|Lemma|Proposition|Corollary|Definition|Example|Remark)\s+[0-9.]*\s*[:.]?\s*', ''), '^[0-9][0-9.]*\s*[:.]?\s*', '')) ELSE name END AS clean FROM d),
g AS (SELECT lower(trim(clean)) AS key, subject_area, coalesce(min(id) FILTER (name = lower(trim(clean))), min(id)) AS survivor FROM k GROUP BY 1, 2 HAVING bool_or(dirty)),
m AS (SELECT id, survivor, CASE WHEN id = survivor AND dirty AND clean <> name THEN clean END AS new_name FROM k JOIN g ON g.key = lower(trim(k.clean)) AND g.subject_area = k.subject_area)"""


@query("concept_repoint", MERGE_SQL + " SELECT l_orderkey * 10 + l_linenumber AS id, coalesce(survivor, l_partkey) AS concept_id FROM lineitem LEFT JOIN m ON m.id = l_partkey")
def concept_repoint(t):
    terms = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("concept_id"))
    return op.repoint(terms, concept_merge(t)).select("id", "concept_id")


@query("concept_merge", MERGE_SQL + " SELECT * FROM m")
def concept_merge(t):
    return op.concept_merge(t.part.select(F.col("p_partkey").alias("id"), F.expr(CONCEPT_NAME.format("STRING")).alias("name"), F.col("p_brand").alias("subject_area")))


@query("ingest_concepts", r"""
WITH r AS (SELECT page_id AS id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS name, split_part(url, '/', 4) AS subject_area, regexp_replace(trim(concat('Ref[12] ', regexp_extract(html, '<p>([^<]+)', 1), '[3]')), '\[\d+\]', '', 'g') AS summary FROM pages),
e AS (SELECT DISTINCT name, subject_area FROM r WHERE length(summary) % 5 = 0)
SELECT min(id) AS id, name, subject_area, arg_min(summary, id) AS summary FROM r WHERE length(name) > 1 AND length(summary) > 5 AND NOT EXISTS (SELECT 1 FROM e WHERE e.name = r.name AND e.subject_area = r.subject_area) GROUP BY name, subject_area""")
def ingest_concepts(t):
    rows = t.pages.select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"), F.split_part("url", F.lit("/"), F.lit(4)).alias("subject_area"),
                          F.concat(F.lit("Ref[12] "), F.regexp_extract("html", "<p>([^<]+)", 1), F.lit("[3]")).alias("summary"))
    shown = rows.select(F.trim("name").alias("name"), "subject_area", F.regexp_replace(F.trim("summary"), r"\[\d+\]", "").alias("s")).filter(F.length("s") % 5 == 0)
    return op.ingest_concepts(rows, shown.select("name", "subject_area").distinct())
