"""Network, class statistics and audits over the driver tables."""

from pyspark.sql import functions as F

from bibliospark.operators import aggregate as op
from bibliospark.partitioning import input_parts
from bibliospark.plans import fixtures as fx
from bibliospark.plans.registry import query
from bibliospark.session import cut_lineage

def order_authors(t):
    """(id, author, zb_authors): suppliers of an order as an author string, JSON names for status P."""
    rows = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("l_orderkey").alias("id"), "o_orderstatus", "s_suppkey")
    )
    return rows.groupBy("id", "o_orderstatus").agg(F.array_sort(F.collect_set("s_suppkey")).alias("s")).select(
        "id",
        F.when(F.col("o_orderstatus") == "F", F.array_join(F.transform("s", lambda k: F.concat(F.lit("Ann. Sup"), k.cast("string"))), "; "))
        .otherwise(F.array_join(F.transform("s", lambda k: F.concat(F.lit("Ann Sup"), k.cast("string"))), " & ")).alias("author"),
        F.when(F.col("o_orderstatus") == "P", F.to_json(F.transform("s", lambda k: F.concat(F.lit("Sup"), k.cast("string"), F.lit(", Ann"))))).alias("zb_authors"))


NAMED_SQL = """named AS (SELECT DISTINCT l_orderkey AS id, concat('SUP', l_suppkey, ' A') AS canon, concat('Ann Sup', l_suppkey) AS display
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey),
links AS (SELECT a.canon AS source, b.canon AS target, count(*) AS value FROM named a JOIN named b ON a.id = b.id AND a.canon < b.canon GROUP BY 1, 2),
nodes AS (SELECT canon AS id, max(display) AS name, count(*) AS n FROM named GROUP BY 1)"""


@query("coauthor_network", f"""WITH {NAMED_SQL}
SELECT 'node' AS kind, id AS a, name AS b, n AS weight FROM nodes WHERE n > 1 OR id IN (SELECT source FROM links) OR id IN (SELECT target FROM links)
UNION ALL SELECT 'link', source, target, value FROM links""")
def coauthor_network(t):
    found = cut_lineage(op.author_occurrences(op.canonical_author(op.author_names(order_authors(t)))))
    links, nodes = op.coauthor_links(found, input_parts(t.lineitem)), op.coauthor_nodes(found)
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("count").alias("weight")).unionByName(
        links.select(F.lit("link").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("value").alias("weight")))


STYLES = {"1-URGENT": "{0}, {1}; {2}", "2-HIGH": "{0} & {1}", "3-MEDIUM": "{0} AND {1} and {2}", "4-NOT SPECIFIED": "{0}, A, {1}, B", "5-LOW": "{0} And {1}, {2}"}


@query("parse_authors", """
WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS p, concat('N', o_custkey) AS a, concat('M', o_orderkey % 97) AS b, concat('K', o_custkey % 11) AS c FROM orders)
SELECT id, CASE p WHEN '1-URGENT' THEN concat(a, ', ', b, '|', c) WHEN '2-HIGH' THEN concat(a, '|', b) WHEN '3-MEDIUM' THEN concat(a, '|', b, '|', c)
  WHEN '4-NOT SPECIFIED' THEN concat('A ', a, '|B ', b) ELSE concat(a, ' And ', b, ', ', c) END AS names FROM o""")
def parse_authors(t):
    a, b, c = (F.concat(F.lit("N"), F.col("o_custkey").cast("string")), F.concat(F.lit("M"), (F.col("o_orderkey") % 97).cast("string")),
               F.concat(F.lit("K"), (F.col("o_custkey") % 11).cast("string")))
    author = F.lit(None)
    for priority, style in STYLES.items():
        text = F.format_string(style.replace("{0}", "%1$s").replace("{1}", "%2$s").replace("{2}", "%3$s"), a, b, c)
        author = F.when(F.col("o_orderpriority") == priority, text).otherwise(author)
    return t.orders.select(F.col("o_orderkey").alias("id"), F.array_join(op.parse_authors(author), "|").alias("names"))


@query("msc_timeline", """
WITH b AS (SELECT year(o_orderdate) AS y, CASE o_orderpriority WHEN '1-URGENT' THEN 'Algebra' WHEN '2-HIGH' THEN 'Number Theory' WHEN '3-MEDIUM' THEN 'Topology' ELSE 'Other' END AS category FROM orders),
c AS (SELECT concat(y // 10 * 10, 's') AS decade, category, count(*) AS n FROM b WHERE y > 1850 AND y <= 2025 GROUP BY 1, 2)
SELECT decade, category, coalesce(n, 0) AS n FROM (SELECT DISTINCT decade FROM c) CROSS JOIN (SELECT DISTINCT category FROM c) LEFT JOIN c USING (decade, category)""")
def msc_timeline(t):
    books = t.orders.select(
        F.year("o_orderdate").alias("year"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN '12-01, 11A05' WHEN '2-HIGH' THEN ' 11A05' WHEN '3-MEDIUM' THEN '54xx' WHEN '5-LOW' THEN '99Z' END").alias("msc_class"))
    return op.msc_timeline(books)


@query("bridge_authors", """
WITH p AS (SELECT DISTINCT concat('C ', c) AS author, code FROM (SELECT o_custkey AS c, lpad(CAST(p_size AS VARCHAR), 2, '0') AS code
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey))
SELECT author, count(*) AS count, string_agg(code, ',' ORDER BY code) AS categories FROM p GROUP BY 1 HAVING count(*) > 1""")
def bridge_authors(t):
    books = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.concat(F.lit("C. "), F.col("o_custkey").cast("string"), F.lit(" ;Various")).alias("author"),
        F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("A05, x9")).alias("msc_class"))
    return op.bridge_authors(books)


@query("msc_prefix_counts", """
WITH c AS (SELECT p_brand AS c FROM part UNION ALL SELECT substr(p_type, 1, 3) FROM part)
SELECT code, count(*) AS n FROM (SELECT substr(c, 1, 2) AS code FROM c WHERE length(c) >= 2 UNION ALL SELECT substr(c, 1, 3) FROM c WHERE length(c) >= 3
  UNION ALL SELECT c FROM c WHERE length(c) >= 5) GROUP BY 1""")
def msc_prefix_counts(t):
    return op.msc_prefix_counts(t.part.select(F.concat("p_brand", F.lit(", "), F.substring("p_type", 1, 3), F.lit(",")).alias("msc_class")))


def _trees(t):
    return t.events.select(F.format_string(
        '[{"code": "%1$02d-XX", "description": "top %1$d", "codes": [{"code": "%1$02d-01", "description": "d %2$s"}], "subcategories": '
        '[{"code": "%1$02dAxx", "description": "mid %2$s", "codes": [{"code": "%1$02dA05", "description": "leaf %2$s"}]}]}]',
        (F.col("event_id") % 100).cast("int"), F.get_json_object("props", "$.k")).alias("tree"))


@query("msc_flatten", r"""
WITH e AS (SELECT lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS c, CAST(event_id % 100 AS VARCHAR) AS i, props->>'$.k' AS k FROM events)
SELECT c AS code, concat('top ', i) AS description FROM e UNION ALL SELECT concat(c, '-01'), concat('d ', k) FROM e
UNION ALL SELECT concat(c, 'A'), concat('mid ', k) FROM e UNION ALL SELECT concat(c, 'A05'), concat('leaf ', k) FROM e""")
def msc_flatten(t):
    return op.msc_flatten(_trees(t))


@query("msc_parents", r"""
WITH e AS (SELECT lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS c, concat('x', props->>'$.k') AS k, event_type AS y FROM events)
SELECT code, level, parent, max(d) AS description FROM (
  SELECT c AS code, 2 AS level, NULL AS parent, k AS d FROM e WHERE y = 'view'
  UNION ALL SELECT concat(c, 'A'), 3, c, k FROM e WHERE y = 'click' UNION ALL SELECT concat(c, 'A05'), 5, concat(c, 'A'), k FROM e WHERE y NOT IN ('view', 'click')
  UNION ALL SELECT concat(c, 'A'), 3, c, '' FROM e WHERE y NOT IN ('view', 'click') UNION ALL SELECT c, 2, NULL, '' FROM e WHERE y <> 'view') GROUP BY 1, 2, 3""")
def msc_parents(t):
    codes = t.events.select(
        F.concat(F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"), F.expr("CASE event_type WHEN 'view' THEN '-XX' WHEN 'click' THEN 'Axx' ELSE 'A05' END")).alias("code"),
        F.concat(F.lit("x"), F.get_json_object("props", "$.k")).alias("description"))
    return op.msc_parents(codes)


@query("library_stats", """
SELECT 'total' AS metric, count(*) AS n FROM documents UNION ALL SELECT 'enriched', count(*) FROM documents WHERE lang = 'en'
UNION ALL SELECT 'indexed', count(*) FROM documents WHERE source <> 'src1' UNION ALL SELECT 'scanned', count(*) FROM events WHERE event_type = 'view'
UNION ALL SELECT 'terms', count(*) FROM part""")
def library_stats(t):
    books = t.documents.select(F.when(F.col("lang") == "en", "verified").alias("metadata_status"), F.when(F.col("source") != "src1", F.col("text")).alias("index_text"))
    scans = t.events.select(F.when(F.col("event_type") == "view", "completed").alias("status"))
    return op.library_stats(books, scans, t.part)


@query("sync_audit", """
WITH n AS (SELECT count(*) AS n FROM documents), c AS (SELECT 'total' AS "check", (SELECT n FROM n) AS n UNION ALL SELECT 'linked', count(quality) FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'indexed', count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'embedded', count(DISTINCT vec_id) FROM embeddings)
SELECT "check", n, CAST(n <> (SELECT n FROM n) AS INT) AS discrepancy FROM c""")
def sync_audit(t):
    terms = t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("quality").alias("concept_id"))
    return op.sync_audit(terms, t.documents.select(F.col("doc_id").alias("id")), t.embeddings.select(F.col("vec_id").alias("id")))


@query("book_health", """
WITH p AS (SELECT l_orderkey AS b, count(*) AS cached, count(*) FILTER (l_linestatus = 'F') AS terms, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'R') AS ph FROM lineitem GROUP BY 1)
SELECT o_orderkey AS book_id, 8 AS page_count, coalesce(cached, 0) AS cached, coalesce(terms, 0) AS terms, coalesce(ph, 0) AS placeholders,
  round(coalesce(cached, 0) * 100.0 / 8, 1) AS cached_pct, CASE WHEN terms > 0 THEN round(ph * 100.0 / terms, 1) END AS placeholder_pct FROM orders LEFT JOIN p ON b = o_orderkey""")
def book_health(t):
    books = t.orders.select(F.col("o_orderkey").alias("book_id"), F.lit(8).alias("page_count"))
    pages = t.lineitem.select(F.col("l_orderkey").alias("book_id"))
    terms = t.lineitem.filter("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("book_id"), F.when(F.col("l_returnflag") == "R", "% Term: x (marker: y)").otherwise("body").alias("latex"))
    return op.book_health(books, pages, terms)


@query("recent_errors", "SELECT user_id AS book_id, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS created_at FROM events WHERE event_type = 'error'")
def recent_errors(t):
    errors = t.events.filter("event_type = 'error'").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("id"), epoch("ts").alias("created_at"))
    return op.recent_errors(errors)


def epoch(column):
    """Whole seconds since 1970 of a zone-less timestamp, independent of the session zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


@query("review_round", """
WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS z, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority ELSE '' END AS m,
  (o_custkey % 11) / 10.0 AS s, o_orderstatus = 'P' AS c FROM orders WHERE epoch(o_orderdate) > 981000000 - 31536000),
e AS (SELECT id, list_filter([CASE WHEN z IS NULL THEN 'Missing Zbl ID (zbMATH link failed)' END, CASE WHEN m = '' THEN 'Missing MSC Classification' END,
  CASE WHEN s <> 0 AND s < 0.8 THEN printf('Low Trust Score (%.2f)', s) END, CASE WHEN c THEN 'Metadata Conflict (AI vs zbMATH mismatch)' END], lambda x: x IS NOT NULL) AS e FROM b)
SELECT id, array_to_string(e, '; ') AS errors, CAST(len(e) = 0 AS INT) AS perfect FROM e""")
def review_round(t):
    books = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey").cast("string")).alias("zbl_id"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).otherwise("").alias("msc_class"),
        ((F.col("o_custkey") % 11) / 10.0).alias("trust_score"),
        F.expr("CASE o_orderstatus WHEN 'P' THEN 'conflict' ELSE 'verified' END").alias("metadata_status"), epoch("o_orderdate").alias("last_metadata_refresh"))
    return op.review_round(books, now=981000000, window_seconds=31536000)


SCAN_STATUS = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'scanning' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'cancelled' ELSE 'lost' END"


def scans(t):
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("book_id"), F.expr(SCAN_STATUS).alias("status"), epoch("ts").alias("created_at"))


def _customers(t):
    return t.customer.select(F.col("c_custkey").alias("book_id"), F.col("c_name").alias("title"))


@query("queue_view", f"""
WITH s AS (SELECT event_id AS id, user_id AS book_id, {SCAN_STATUS} AS status, CAST(floor(epoch(ts)) AS BIGINT) AS created_at FROM events),
q AS (SELECT id, rank() OVER (ORDER BY created_at) AS p FROM s WHERE status = 'queued')
SELECT s.id, book_id, status, created_at, c_name AS title, CASE status WHEN 'scanning' THEN 'running' WHEN 'lost' THEN 'failed' ELSE status END AS bucket,
  coalesce(p, 0) AS queue_position FROM s JOIN customer ON c_custkey = book_id LEFT JOIN q ON q.id = s.id""")
def queue_view(t):
    return op.queue_view(scans(t), _customers(t))


@query("completed_scans", f"""SELECT event_id AS id, user_id AS book_id, c_name AS title, CAST(floor(epoch(ts)) AS BIGINT) AS completed_at FROM events JOIN customer ON c_custkey = user_id
WHERE event_type = 'purchase'""")
def completed_scans(t):
    return op.completed_scans(scans(t).withColumnRenamed("created_at", "completed_at"), _customers(t)).drop("status")


@query("category_groups", f"""
WITH n AS (SELECT CASE lang WHEN 'de' THEN concat(source, '_p', n_chars, '_p1') WHEN 'fr' THEN concat('2026', n_chars) ELSE source END AS name, source, lang FROM documents)
SELECT CASE lang WHEN 'de' THEN source WHEN 'fr' THEN 'Handwritten' ELSE 'General' END AS category, count(*) AS n FROM n GROUP BY 1""")
def category_groups(t):
    chars = F.col("n_chars").cast("string")
    name = F.when(F.col("lang") == "de", F.concat("source", F.lit("_p"), chars, F.lit("_p1"))).when(F.col("lang") == "fr", F.concat(F.lit("2026"), chars)).otherwise(F.col("source"))
    return op.category_groups(t.documents.select(name.alias("name")))
