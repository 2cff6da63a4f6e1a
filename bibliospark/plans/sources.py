"""Sources, sinks and index builds over the driver tables."""

from pyspark.sql import functions as F

from bibliospark.operators import aggregate as agg
from bibliospark.partitioning import input_parts
from bibliospark.plans import fixtures as fx
from bibliospark.plans.aggregate import NAMED_SQL, order_authors
from bibliospark.plans.registry import query
from bibliospark.session import cut_lineage
from bibliospark.sources import catalog, exports, index


@query("catalog_scan", f"""
WITH f AS (SELECT concat({fx.FOLDER}, '/', lang, '/', source, ' - ', lang, ' - ', doc_id, {fx.EXTENSION}) AS path, source, lang, doc_id, n_chars AS size FROM documents)
SELECT path, size, CASE source WHEN 'src7' THEN concat('99_General_and_Diverse/Unsorted/', lang) ELSE concat(source, '/', lang) END AS directory,
  concat(lang, ' - ', doc_id) AS title, source AS author FROM f WHERE lang IN ('en', 'fr', 'de') AND source NOT IN ('src3', 'src5')""")
def catalog_scan(t):
    name = F.concat(F.expr(fx.FOLDER), F.lit("/"), "lang", F.lit("/"), F.concat_ws(" - ", "source", "lang", F.col("doc_id").cast("string")), F.expr(fx.EXTENSION))
    return catalog.catalog_scan(t.documents.select(name.alias("path"), F.col("n_chars").alias("size")))


@query("catalog_delta", """
SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderstatus = 'P' THEN 'new' WHEN o_orderpriority = '1-URGENT' OR o_custkey % 7 > 1 OR o_orderpriority = '5-LOW' THEN 'changed'
  ELSE 'unchanged' END AS change FROM orders""")
def catalog_delta(t):
    path = F.col("o_orderkey").cast("string").alias("path")
    known = t.orders.filter("o_orderstatus <> 'P'").select(
        path, F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("last_modified"),
        F.expr("CASE o_orderpriority WHEN '5-LOW' THEN 0 ELSE 1 END").alias("index_version"))
    current = t.orders.select(path, (F.col("o_totalprice") + F.col("o_custkey") % 7).alias("mtime"))
    return catalog.catalog_delta(current, known)


@query("merge_upsert", """
WITH u AS (SELECT o_orderkey AS id, 1 AS version, o_totalprice AS price, o_orderstatus AS status FROM orders
  UNION ALL SELECT o_orderkey, 2, o_totalprice * 2, 'U' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey + 10000000, 1, o_totalprice, 'I' FROM orders WHERE o_orderpriority = '2-HIGH')
SELECT id, version, price, status FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1""")
def merge_upsert(t):
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("version"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    updates = o.filter("status = 'F'").select("id", F.lit(2).alias("version"), (F.col("price") * 2).alias("price"), F.lit("U").alias("status")).unionByName(
        t.orders.filter("o_orderpriority = '2-HIGH'").select((F.col("o_orderkey") + 10000000).alias("id"), F.lit(1).alias("version"), F.col("o_totalprice").alias("price"), F.lit("I").alias("status")))
    return catalog.merge_upsert(o, updates, ["id"], "version")


@query("cascade_delete", """
WITH d AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT 'cascade' AS rule, o_orderkey AS id, o_custkey AS parent FROM orders WHERE o_custkey NOT IN (FROM d)
UNION ALL SELECT 'nullify', o_orderkey, CASE WHEN o_custkey IN (FROM d) THEN NULL ELSE o_custkey END FROM orders""")
def cascade_delete(t):
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent"))
    deleted = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("parent"))
    cascade = catalog.cascade_delete(orders, deleted, "parent").withColumn("rule", F.lit("cascade"))
    return cascade.unionByName(catalog.nullify_references(orders, deleted, "parent").withColumn("rule", F.lit("nullify")))


def _chapters(t):
    return t.lineitem.select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("id"),
                             F.concat("l_returnflag", F.lit("-"), F.col("l_partkey").cast("string")).alias("title"))


@query("assemble_book_doc", """
WITH c AS (SELECT l_orderkey AS id, string_agg(concat(l_returnflag, '-', l_partkey), chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag) AS toc FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS title, coalesce(toc, '') AS toc FROM orders LEFT JOIN c ON c.id = o_orderkey""")
def assemble_book_doc(t):
    books = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("title"))
    return index.assemble_book_doc(books, _chapters(t))


@query("page_doc_upsert", f"""SELECT concat('book_', book_id, '_p', page) AS id, CASE role WHEN 'assistant' THEN concat('LaTeX ', content) ELSE content END AS content FROM {fx.PAGES_SQL}""")
def page_doc_upsert(t):
    pages = fx.pages(t)
    raw = pages.select("book_id", "page", "content", F.lit(0).alias("priority"))
    latex = pages.filter("role = 'assistant'").select("book_id", "page", F.concat(F.lit("LaTeX "), "content").alias("content"), F.lit(1).alias("priority"))
    return index.page_doc_upsert(raw.unionByName(latex))


@query("index_patch", """
WITH s AS (SELECT doc_id AS id, trim(text) AS body, label AS concept_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
SELECT s.id, coalesce(s.concept_id, -1) AS concept_id, md5(s.body) AS body, 'patched' AS origin FROM s JOIN documents d ON d.doc_id = s.id WHERE lang <> 'de'
UNION ALL SELECT s.id, s.concept_id, md5(s.body), 'inserted' FROM s JOIN documents d ON d.doc_id = s.id WHERE lang = 'de'""")
def index_patch(t):
    docs = t.documents
    store = docs.join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left").select(
        F.col("doc_id").alias("id"), F.col("label").alias("concept_id"), F.md5(F.trim("text")).alias("body"))
    old = docs.filter("lang <> 'de'").select(F.col("doc_id").alias("id"), F.lit(-1).alias("concept_id"), F.lit("stale").alias("body"))
    patched = index.index_patch(old, store, ["concept_id", "body"]).withColumn("origin", F.lit("patched"))
    return patched.unionByName(index.index_backfill(old, store).withColumn("origin", F.lit("inserted")))


TOKENS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
POSTINGS_SQL = f"""docs AS (SELECT doc_id, 'text' AS field, {TOKENS.format('text')} AS w FROM documents UNION ALL SELECT doc_id, 'title', {TOKENS.format(fx.TITLE_SQL)} FROM documents),
post AS (SELECT doc_id, field, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, field, len(w) AS dl, unnest(w) AS token FROM docs) GROUP BY 1, 2, 3),
df AS (SELECT field, token, count(*) AS df FROM post GROUP BY 1, 2)"""


def search_docs(t):
    return t.documents.select("doc_id", fx.title().alias("title"), "text", "lang", "source")


@query("build_term_index", f"WITH {POSTINGS_SQL} SELECT doc_id, field, token, tf, dl, df FROM post JOIN df USING (field, token)")
def build_term_index(t):
    post, _ = index.kept_index(search_docs(t), ["title", "text"])
    return index.with_token_counts(post)


@query("corpus_stats", f"WITH {POSTINGS_SQL} SELECT field, count(*) AS n_docs, round(avg(len(w)), 6) AS avgdl FROM docs WHERE len(w) > 0 GROUP BY 1")
def corpus_stats(t):
    return index.corpus_stats(search_docs(t), ["title", "text"]).withColumn("avgdl", F.round("avgdl", 6))


LATEX_SQL = r"concat(text, ' $$ ', source, '+', doc_id, ' $$ \[', lang, chr(10), 'x\] $$  $$ \begin{align}', n_chars, '\end{align} \begin{equation}\end{equation}')"


def latex_terms(t):
    """Documents with display math appended."""
    s = F.col
    return t.documents.select(s("doc_id").alias("id"), F.concat(
        s("text"), F.lit(" $$ "), s("source"), F.lit("+"), s("doc_id").cast("string"), F.lit(" $$ \\["), s("lang"), F.lit("\nx\\] $$  $$ \\begin{align}"),
        s("n_chars").cast("string"), F.lit("\\end{align} \\begin{equation}\\end{equation}")).alias("latex"))


HARVEST_SQL = rf"""d AS (SELECT doc_id AS id, {LATEX_SQL} AS latex FROM documents),
f AS (SELECT id, list_concat(list_concat(list_concat(regexp_extract_all(latex, '\\\[(.*?)\\\]', 1, 's'), regexp_extract_all(latex, '\$\$(.*?)\$\$', 1, 's')),
  regexp_extract_all(latex, '\\begin\{{equation\}}(.*?)\\end\{{equation\}}', 1, 's')), regexp_extract_all(latex, '\\begin\{{align\}}(.*?)\\end\{{align\}}', 1, 's')) AS fs FROM d),
u AS (SELECT id, unnest(range(len(fs))) AS idx, fs FROM f)"""


@query("formula_harvest", f"WITH {HARVEST_SQL} SELECT id, idx, trim(fs[idx + 1], ' ' || chr(10)) AS formula FROM u WHERE trim(fs[idx + 1], ' ' || chr(10)) <> ''")
def formula_harvest(t):
    return index.formula_harvest(latex_terms(t))


@query("export_network_json", f"""WITH {NAMED_SQL}, act AS (SELECT * FROM nodes WHERE n > 1)
SELECT 'node' AS kind, id, concat('{{"id":"', id, '","type":"text","text":"### ', name, '\\n', n, ' books in library","width":250,"height":100}}') AS json FROM act
UNION ALL SELECT 'edge', concat(source, '|', target), concat('{{"fromNode":"', source, '","toNode":"', target, '","label":"', value, ' collaborations"}}') FROM links
WHERE source IN (SELECT id FROM act) AND target IN (SELECT id FROM act)""")
def export_network_json(t):
    found = cut_lineage(agg.author_occurrences(agg.canonical_author(agg.author_names(order_authors(t)))))
    return exports.export_network(agg.coauthor_nodes(found), agg.coauthor_links(exports.active_occurrences(found), input_parts(t.lineitem)), coordinates=False)


@query("export_bibliography", r"""
WITH b AS (SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'Unknown' ELSE p_brand END AS author, CASE WHEN p_size < 5 THEN 'Unknown' ELSE p_name END AS title, p_type AS publisher FROM part),
k AS (SELECT *, list_filter(string_split(title, ' '), lambda w: length(w) > 3) AS w FROM b),
e AS (SELECT *, concat(replace(author, '#', ''), coalesce(w[1], 'Book')) AS key FROM k)
SELECT id, key, count(*) OVER (PARTITION BY key) AS same_key, concat('@book{', key, ',', chr(10), '  author    = {', author, '},', chr(10), '  title     = {', title, '},', chr(10),
  '  year      = {20XX},', chr(10), '  publisher = {', publisher, '},', chr(10), '  note      = {File: ', id, '.pdf}', chr(10), '}') AS entry FROM e""")
def export_bibliography(t):
    books = t.part.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 40, F.col("p_brand")).alias("author"), F.when(F.col("p_size") >= 5, F.col("p_name")).alias("title"),
        F.lit(None).cast("int").alias("year"), F.col("p_type").alias("publisher"), F.concat(F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("filename"))
    return exports.export_bibliography(books)


@query("stratified_samples", f"""
WITH t AS (SELECT id, kind, md5(concat('s1', id)) AS h FROM {fx.TERMS_SQL}), o AS (SELECT id, kind FROM t ORDER BY h, id LIMIT 20)
SELECT id, kind, 'overall' AS sample FROM o UNION ALL SELECT id, kind, 'type' FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY h, id) AS r FROM t) WHERE r <= 5""")
def stratified_samples(t):
    return catalog.stratified_samples(fx.terms(t).select("id", "kind"), "s1")
