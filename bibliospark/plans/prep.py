"""Text preparation over the driver tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from bibliospark.operators import prep as op
from bibliospark.plans import fixtures as fx
from bibliospark.plans.quality import STRIP, bodies
from bibliospark.plans.registry import query


@query("embedding_text_terms")
def embedding_text_terms(t):
    terms = bodies(t).select("id", F.col("lang").alias("name"), F.col("source").alias("kind"), "latex", F.to_json(F.array("lang", "source")).alias("used_terms"))
    return op.embedding_text_terms(terms)


MATH = r"concat('Proof. ', text, ' \blacksquare ', lang, ' $$', text, '$$ $', source, '$ \[', chr(10), 'y\] ', replace(text, ' ', chr(10)))"


@query("embedding_text_terms_native", rf"""
WITH d AS (SELECT doc_id AS id, lang, source, CASE WHEN contains(text, '$') THEN text ELSE {MATH} END AS x FROM documents),
m AS (SELECT id, lang, source, regexp_replace(regexp_replace(regexp_replace(x, 'Proof\..*?\\blacksquare', '', 'gs'), '\$\$.*?\$\$', ' [EQUATION] ', 'gs'), '\\\[.*?\\\]', ' [EQUATION] ', 'gs') AS y FROM d)
SELECT id, concat(lang, ' (Type: ', source, '). Concepts: ', CASE WHEN lang = 'de' THEN 'plain, text' ELSE concat(lang, ', ', source) END, '. Statement: ', trim(regexp_replace(y, '\s+', ' ', 'g'))) AS text FROM m""")
def embedding_text_terms_native(t):
    latex = F.concat(F.lit("Proof. "), "text", F.lit(r" \blacksquare "), "lang", F.lit(" $$"), "text", F.lit("$$ $"), "source", F.lit("$ \\[\ny\\] "), F.replace("text", F.lit(" "), F.lit("\n")))
    terms = t.documents.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("name"), F.col("source").alias("kind"), F.when(F.contains("text", F.lit("$")), F.col("text")).otherwise(latex).alias("latex"),
        F.when(F.col("lang") == "de", "plain, text").otherwise(F.to_json(F.array("lang", "source"))).alias("used_terms"))
    return op.embedding_text_terms(terms)


@query("embedding_text_concepts", """
SELECT p_partkey AS id, concat(p_name, ' (Subject: ', p_brand, '). Summary: ', CASE WHEN p_size > 10 THEN p_type ELSE '' END) AS sentence,
  concat('[Name] ', p_name, ' [Subject] ', p_brand, ' [Summary] ', CASE WHEN p_size > 10 THEN p_type ELSE '' END) AS tagged FROM part""")
def embedding_text_concepts(t):
    concepts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("subject_area"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("summary"))
    return op.embedding_text_concepts(concepts).withColumnRenamed("text", "sentence").join(op.embedding_text_concepts(concepts, "tagged").withColumnRenamed("text", "tagged"), "id")


@query("embedding_text_books", """
WITH c AS (SELECT l_suppkey AS id, string_agg(concat('- ', l_returnflag, l_partkey), chr(10) ORDER BY l_linenumber, o) AS cs FROM (SELECT *, l_orderkey * 10000000 + l_partkey AS o, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey * 10000000 + l_partkey) AS r
  FROM lineitem) GROUP BY 1)
SELECT s_suppkey AS id, substr(concat_ws(chr(10), concat('Title: ', s_name), CASE WHEN s_nationkey > 5 THEN concat('Author: ', s_nationkey) END, concat('Summary: ', repeat(s_name, 20)), concat('Chapters:', chr(10), cs),
  concat('Index Keywords: ', repeat(s_name, 80))), 1) AS text FROM supplier LEFT JOIN c ON c.id = s_suppkey""")
def embedding_text_books(t):
    books = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.when(F.col("s_nationkey") > 5, F.col("s_nationkey").cast("string")).otherwise("").alias("author"),
        F.lit(None).cast("string").alias("msc_class"), F.repeat("s_name", 20).alias("summary"), F.repeat("s_name", 80).alias("index_text"))
    chapters = t.lineitem.select(
        F.col("l_suppkey").alias("book_id"), F.col("l_linenumber").alias("page"), (F.col("l_orderkey") * 10000000 + F.col("l_partkey")).alias("id"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("title"))
    return op.embedding_text_books(books, chapters)


@query("missing_embeddings", "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(t):
    return op.missing_embeddings(t.documents.select(F.col("doc_id").alias("id"), "source"), t.embeddings.select(F.col("vec_id").alias("id")))


@query("chunk_text", "WITH d AS (SELECT doc_id AS id, unnest(range(CAST(ceil(length(text) / 8000) AS BIGINT))) AS chunk_no, text FROM documents) SELECT id, chunk_no, md5(substr(text, chunk_no * 8000 + 1, 8000)) AS chunk FROM d")
def chunk_text(t):
    return op.chunk_text(t.documents.select(F.col("doc_id").alias("id"), "text")).withColumn("chunk", F.md5("chunk"))


@query("html_to_chunks")
def html_to_chunks(t):
    return op.html_to_chunks(t.pages.select(F.col("page_id").alias("id"), "html"), element_id=None)


@query("term_rows_from_output", rf"""
WITH p AS (SELECT *, replace(split_part(content, ' ', 2), chr(10), '-') AS w FROM {fx.PAGES_SQL} WHERE role <> 'system'),
r AS (SELECT book_id, page, 0 AS block_no, trim(w) AS name, 'theorem' AS kind, 'a b, c' AS used_terms, content AS x, role, w FROM p UNION ALL SELECT book_id, page, 2, concat(w, ' two'), 'definition', '', concat('see  and', chr(10), content), role, w FROM p)
SELECT book_id, page, block_no, name, kind, used_terms, {STRIP.format('x')} AS latex FROM r WHERE length(name) >= 3""")
def term_rows_from_output(t):
    word = F.replace(F.split_part("content", F.lit(" "), F.lit(2)), F.lit("\n"), F.lit("-"))
    pages = fx.pages(t)
    text = F.concat(F.lit("### "), word, F.lit("  (Theorem) \n\nKeywords: a b ,c\n"), "content", F.lit(" Page 12\n### Index (Lemma)\nx\n###  "), word, F.lit(" two(Definition)\n\nsee page 3 and\n"), "content", F.lit("\nIntroduction to modern analysis"))
    raw = F.when(F.col("role") == "system", F.lit("NO_TERMS_FOUND")).when(F.col("role") == "user", F.concat(F.lit("```markdown\n"), text, F.lit("\n```\n"))).otherwise(text)
    return op.term_rows_from_output(pages.select("book_id", "page", raw.alias("raw")))


@query("batch_output_reconcile", rf"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page) - 1 AS position FROM {fx.PAGES_SQL}),
b AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page) - 1 AS i FROM p WHERE length(content) % 5 > 0),
m AS (SELECT b.book_id, CASE WHEN length(b.content) % 3 = 0 THEN q.page ELSE b.page END AS page, b.content, b.i FROM b LEFT JOIN p q ON q.book_id = b.book_id AND q.position = b.i),
f AS (SELECT book_id, page, {STRIP.format('arg_min(content, i)')} AS latex FROM m WHERE page IS NOT NULL GROUP BY 1, 2)
SELECT p.book_id AS batch_id, p.page, latex, CASE WHEN latex IS NULL THEN 'missing' ELSE 'ok' END AS status FROM p LEFT JOIN f ON f.book_id = p.book_id AND f.page = p.page""")
def batch_output_reconcile(t):
    pages = fx.pages(t)
    block = F.concat(
        F.lit("<page>"), F.when(F.length("content") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<pdf_page_idx> no. "), F.col("page").cast("string"), F.lit("</pdf_page_idx>"))),
        F.lit("\n<latex> ```latex\n"), "content", F.lit("\n``` </latex></page>\n"))
    outputs = pages.filter(F.length("content") % 5 > 0).groupBy(F.col("book_id").alias("batch_id")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("page", block.alias("b"))))["b"], "").alias("raw"))
    requested = pages.select(F.col("book_id").alias("batch_id"), "page", (F.row_number().over(Window.partitionBy("book_id").orderBy("page")) - 1).alias("position"))
    return op.batch_output_reconcile(outputs, requested)


@query("target_path_plan", rf"""
WITH b AS (SELECT doc_id AS id, CASE source WHEN 'src1' THEN concat('A/B: ', {fx.TITLE_SQL}) WHEN 'src2' THEN 'Same (Title)!' ELSE {fx.TITLE_SQL} END AS title, CASE lang WHEN 'fr' THEN 'Unknown' ELSE concat(source, '; é ', lang) END AS author, CASE lang WHEN 'de' THEN 'x/y' ELSE '99_General_and_Diverse/Unsorted' END AS folder FROM documents),
p AS (SELECT id, concat(folder, '/', substr(trim(regexp_replace(author, '[^\p{{L}}\p{{N}} \-_]', '', 'g')), 1, 50), ' - ', substr(trim(regexp_replace(title, '[^\p{{L}}\p{{N}} \-_]', '', 'g')), 1, 100), '.pdf') AS target FROM b)
SELECT id, target, count(*) OVER (PARTITION BY target) AS same_target FROM p""")
def target_path_plan(t):
    source = F.col("source")
    books = t.documents.select(
        F.col("doc_id").alias("id"), F.when(source == "src1", F.concat(F.lit("A/B: "), fx.title())).when(source == "src2", "Same (Title)!").otherwise(fx.title()).alias("title"),
        F.when(F.col("lang") != "fr", F.concat("source", F.lit("; é "), "lang")).alias("author"), F.when(F.col("lang") == "de", "x/y").alias("folder"), F.lit(".PDF").alias("suffix"))
    return op.target_path_plan(books)
