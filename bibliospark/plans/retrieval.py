"""Search and anchoring over the driver tables."""

from pyspark.sql import functions as F

from bibliospark.functions import text as tx
from bibliospark.operators import anchoring, retrieval as op, vectors
from bibliospark.plans import fixtures as fx
from bibliospark.plans.registry import query
from bibliospark.plans.sources import HARVEST_SQL, TOKENS, latex_terms, search_docs
from bibliospark.sources import index

DIM = 64
BOOSTS = {"title": 4.0, "text": 1.0}


def queries(t):
    """First sentences of the benchmark passages as search queries."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), fx.title().alias("query"))


def text_index(t):
    return index.kept_index(search_docs(t), list(BOOSTS))


def corpus(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def query_vectors(t):
    """The vector of a query is the one with its number."""
    return t.embeddings.join(t.benchmark, F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vec"))


def bm25_sql(docs: str, boosts: dict, combine: str = "max", source: str = "(SELECT item_id AS query_id, " + fx.TITLE_SQL + " AS query FROM benchmark)") -> str:
    """CTEs ending in scores(query_id, doc_id, score) for docs(doc_id, field, w)."""
    boost = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}" for f, b in boosts.items()) + " END"
    outer = "max(s)" if combine == "max" else "sum(s)"
    return f"""docs AS ({docs}),
post AS (SELECT doc_id, field, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, field, len(w) AS dl, unnest(w) AS token FROM docs) GROUP BY 1, 2, 3),
df AS (SELECT field, token, count(*) AS df FROM post GROUP BY 1, 2),
st AS (SELECT field, count(*) AS n, avg(len(w)) AS avgdl FROM docs WHERE len(w) > 0 GROUP BY 1),
qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS token FROM {source}) GROUP BY 1, 2),
parts AS (SELECT query_id, doc_id, field, sum(qtf * {boost} * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM post JOIN qt USING (token) JOIN df USING (field, token) JOIN st USING (field) GROUP BY 1, 2, 3),
scores AS (SELECT query_id, doc_id, round({outer}, 6) AS score FROM parts GROUP BY 1, 2)"""


DOC_FIELDS = f"SELECT doc_id, 'text' AS field, {TOKENS.format('text')} AS w FROM @docs UNION ALL SELECT doc_id, 'title', {TOKENS.format(fx.TITLE_SQL)} FROM @docs"
BM25 = bm25_sql(DOC_FIELDS.replace("@docs", "documents"), BOOSTS)


@query("bm25_search", f"WITH {BM25} SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 50")
def bm25_search(t):
    docs = search_docs(t)
    return op.bm25_search(*index.kept_index(docs, list(BOOSTS)), queries(t), BOOSTS, 50)


COSINE = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


def knn_sql(k: int | None, left: str, right: str) -> str:
    """hits(query_id, id, cosine, rank) between embedding rows of two selections; all of them without ``k``."""
    return f"""hits AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {COSINE} AS cosine,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS rank FROM {left} a, {right} b){f' WHERE rank <= {k}' if k else ''})"""


ASKED = "(SELECT e.* FROM embeddings e JOIN benchmark ON item_id = vec_id)"


@query("knn_search", f"WITH {knn_sql(10, ASKED, 'embeddings')} SELECT * FROM hits")
def knn_search(t):
    return vectors.knn(corpus(t), query_vectors(t), 10, DIM)


@query("similar_items", f"""WITH {knn_sql(6, 'embeddings', 'embeddings')}
SELECT * FROM (SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM hits WHERE id <> query_id) WHERE rank <= 5""")
def similar_items(t):
    return vectors.similar_items(corpus(t), 5, DIM)


@query("knn_search_lists")
def knn_search_lists(t):
    """Every row whose id is divisible by 20 against all rows, by inverted lists. The vectors of this table point in all
    directions alike, so many lists have to be probed for a recall of 0.9."""
    asked = corpus(t).filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    return vectors.knn_in_lists(corpus(t), asked, 10, DIM, vectors.Lists(20, 14))


@query("recommend_by_vector", f"WITH {knn_sql(3, ASKED, 'embeddings')} SELECT * FROM hits WHERE cosine > 0.4")
def recommend_by_vector(t):
    return vectors.recommend_by_vector(corpus(t), query_vectors(t), DIM)


HYBRID = f"""hyb AS (SELECT query_id, doc_id, round(coalesce(score, 0) + coalesce(0.4 * (1 + cosine) / 2, 0), 6) AS score FROM scores
  FULL JOIN (SELECT query_id, id AS doc_id, cosine FROM hits) USING (query_id, doc_id))"""


def catalogue(t):
    return fx.books(t).select(F.col("id").alias("doc_id"), "title", "author", "year")


@query("hybrid_search", f"""WITH {BM25}, {knn_sql(None, ASKED, 'embeddings')}, {HYBRID},
r AS (SELECT query_id, doc_id, score, title, author, year, count(*) OVER (PARTITION BY query_id) AS total,
  row_number() OVER (PARTITION BY query_id ORDER BY year DESC, score DESC, doc_id) AS position FROM hyb JOIN {fx.BOOKS_SQL} b ON b.id = doc_id)
SELECT * FROM r WHERE position > 5 AND position <= 25""")
def hybrid_search(t):
    return op.hybrid_search_page(*text_index(t), queries(t), BOOSTS, corpus(t), query_vectors(t), catalogue(t), DIM, "year", limit=20, offset=5)


@query("hybrid_search_relevance", f"""WITH {BM25}, {knn_sql(None, ASKED, 'embeddings')}, {HYBRID},
r AS (SELECT query_id, doc_id, score, count(*) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position
  FROM hyb JOIN documents USING (doc_id))
SELECT * FROM r WHERE position <= 20""")
def hybrid_search_relevance(t):
    return op.hybrid_search_page(*text_index(t), queries(t), BOOSTS, corpus(t), query_vectors(t), catalogue(t), DIM).select("query_id", "doc_id", "score", "total", "position")


FILTERED = "(SELECT * FROM documents WHERE starts_with(lang, 'e') AND source = 'src1')"


@query("search_filters", f"""WITH {BM25}, f AS (SELECT doc_id FROM {FILTERED}),
{knn_sql(None, ASKED, '(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM ' + FILTERED + '))')},
{HYBRID} SELECT query_id, doc_id, score FROM hyb WHERE doc_id IN (FROM f)""")
def search_filters(t):
    docs = search_docs(t).withColumnsRenamed({"lang": "msc_class", "source": "publisher"})
    kept = op.search_filters(docs, msc="e", publisher="src1").select("doc_id")
    return op.hybrid_blocks(*text_index(t), queries(t), BOOSTS, corpus(t), query_vectors(t), kept, DIM, narrow=True).drop("n")


@query("index_lookup")
def index_lookup(t):
    pair = F.regexp_extract("text", r"^\p{L}+[^\p{L}]+(\p{L}+ \p{L}+)", 1)
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), pair.alias("query")).filter("query <> ''")
    docs = search_docs(t)
    hits = op.bm25_scores(*index.kept_index(docs, ["title"]), asked, {"title": 4.0})
    texts = docs.select("doc_id", F.regexp_replace("text", r"[.,]", ", 12, 14-16, 20 ").alias("index_text"))
    return op.index_lookup(hits.join(asked, "query_id"), texts).select("query_id", "doc_id", "score", "index_matches")


def page_docs(t):
    """Pages with a document id."""
    return fx.pages(t).withColumn("doc_id", F.col("book_id") * 10 + F.col("page"))


PAGE_FIELDS = f"SELECT book_id * 10 + page AS doc_id, 'content' AS field, {TOKENS.format('content')} AS w FROM {fx.PAGES_SQL}"
PAGE_QUERIES = "(SELECT conv_id * 10 AS query_id, conv_id AS book_id, regexp_extract(text, '^[^.\\n]*') AS query FROM conversations WHERE turn = 0)"


def page_queries(t):
    """One query per book: the first sentence of its first page."""
    return t.conversations.filter("turn = 0").select((F.col("conv_id") * 10).alias("query_id"), F.col("conv_id").alias("book_id"), fx.title().alias("query"))


def page_index(t):
    docs = page_docs(t)
    return index.kept_index(docs, ["content"])


@query("search_within", f"""WITH {bm25_sql(PAGE_FIELDS, {'content': 1.0}, source=PAGE_QUERIES)}
SELECT * FROM (SELECT s.query_id, q.book_id, doc_id, doc_id - q.book_id * 10 AS page, score, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, doc_id) AS rank
  FROM scores s JOIN {PAGE_QUERIES} q ON q.query_id = s.query_id AND q.book_id = doc_id // 10) WHERE rank <= 50""")
def search_within(t):
    post, stats = page_index(t)
    return op.search_within(post, stats, page_docs(t).select("doc_id", "book_id", "page", "content"), page_queries(t), {"content": 1.0}, snippets=False)


SHORT_QUERIES = f"(SELECT conv_id * 10 AS query_id, array_to_string({TOKENS.format('text')}[1:2], ' ') AS query FROM conversations WHERE turn = 1)"


def short_queries(t):
    return t.conversations.filter("turn = 1").select((F.col("conv_id") * 10).alias("query_id"), F.array_join(F.slice(tx.tokens("text"), 1, 2), " ").alias("query"))


def fts_sql(docs: str, source: str, limit: int) -> str:
    base = bm25_sql(docs, {"content": 1.0}, source=source).replace("ln(1 + (n - df + 0.5) / (df + 0.5))", "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)")
    return f"""{base}, need AS (SELECT query_id, count(*) AS need FROM qt GROUP BY 1),
have AS (SELECT query_id, doc_id, count(*) AS have FROM post JOIN qt USING (token) GROUP BY 1, 2),
fts AS (SELECT s.query_id, s.doc_id, -score AS fts_rank FROM scores s JOIN have h ON h.query_id = s.query_id AND h.doc_id = s.doc_id JOIN need n ON n.query_id = s.query_id AND need = have
  QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY -score, s.doc_id) <= {limit})"""


@query("fts_page_search", f"""WITH {fts_sql(PAGE_FIELDS, SHORT_QUERIES, 20)},
w AS (SELECT f.query_id, f.doc_id, fts_rank, string_split(content, ' ') AS p, {TOKENS.format('query')} AS q FROM fts f JOIN {SHORT_QUERIES} s ON s.query_id = f.query_id
  JOIN {fx.PAGES_SQL} c ON c.book_id * 10 + c.page = f.doc_id),
h AS (SELECT *, list_transform(p, lambda x: CASE WHEN list_has_any({TOKENS.format('x').replace('lambda x: x', 'lambda y: y')}, q) THEN concat('**', x, '**') ELSE x END) AS m FROM w)
SELECT query_id, doc_id, fts_rank, array_to_string(m[greatest(1, coalesce(list_position(list_transform(m, lambda x: starts_with(x, '**')), true), 0)) : greatest(1, coalesce(list_position(list_transform(m, lambda x: starts_with(x, '**')), true), 0)) + 39], ' ') AS snippet FROM h""")
def fts_page_search(t):
    post, stats = page_index(t)
    asked = short_queries(t)
    hits = op.fts_search(post, stats, asked, 20).drop("rank")
    rows = hits.join(page_docs(t).select("doc_id", "content"), "doc_id").join(asked.select("query_id", tx.tokens("query").alias("_w")), "query_id")
    return rows.select("query_id", "doc_id", "fts_rank", op.word_snippet("content", F.col("_w")).alias("snippet"))


NOTE_FIELDS = f"SELECT conv_id * 10 + turn AS doc_id, 'content' AS field, {TOKENS.format('concat(text, chr(10), role)')} AS w FROM conversations"


@query("note_search", f"WITH {fts_sql(NOTE_FIELDS, SHORT_QUERIES, 50)} SELECT query_id, doc_id, fts_rank FROM fts")
def note_search(t):
    notes = t.conversations.select((F.col("conv_id") * 10 + F.col("turn")).alias("doc_id"), F.concat_ws("\n", "text", "role").alias("content"))
    return op.fts_search(*index.kept_index(notes, ["content"]), short_queries(t), 50).drop("rank")


MARKED = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: concat('[[PAGE_', i, ']]', x)), chr(10))"


@query("phrase_snippets", rf"""
WITH d AS (SELECT doc_id, replace({MARKED}, 'the ', '<b>the </b>') AS m FROM documents WHERE contains({MARKED}, 'the ')),
p AS (SELECT doc_id, m, string_split(m, '<b>') AS parts FROM d),
h AS (SELECT doc_id, m, parts, unnest(range(len(parts) - 1)) AS hit FROM p),
a AS (SELECT doc_id, m, hit, CAST(list_sum(list_transform(parts[1:hit + 1], lambda x: length(x))) + hit * 3 AS BIGINT) AS o FROM h)
SELECT doc_id, hit, coalesce(list_last(regexp_extract_all(substr(m, 1, o), '\[\[PAGE_(\d+)\]\]', 1)), '?') AS page,
  replace(substr(m, greatest(o - 100, 0) + 1, o + 157 - greatest(o - 100, 0)), chr(10), ' ') AS snippet FROM a""")
def phrase_snippets(t):
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("[[PAGE_"), (i + 1).cast("string"), F.lit("]]"), x)), "\n")
    return op.phrase_snippets(t.documents.select("doc_id", marked.alias("content")), "the ")


TERM_BOOSTS = {"name": 3.0, "latex": 1.0}
TERM_FIELDS = DOC_FIELDS.replace("'title'", "'name'").replace("'text' AS field", "'latex' AS field")
CONCEPTS = "(SELECT label AS vec_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1)"


def label_concepts(t):
    """One concept per label: its first vector."""
    return t.embeddings.groupBy(F.col("label").alias("id")).agg(F.min_by("embedding", "vec_id").alias("vec"))


def term_docs(t):
    return search_docs(t).select("doc_id", F.col("title").alias("name"), F.col("text").alias("latex"), F.col("lang").alias("kind"), "source")


FORMULA_QUERY = "src3 + ?a"


@query("rrf_term_search", f"""WITH {bm25_sql(TERM_FIELDS.replace("@docs", "(SELECT * FROM documents WHERE lang <> 'de')"), TERM_BOOSTS)},
{knn_sql(None, ASKED, "(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang <> 'de'))")},
{HARVEST_SQL},
ch AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS concept_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS rank FROM {ASKED} a, {CONCEPTS} b) WHERE rank <= 3),
tx AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM scores),
fu AS (SELECT query_id, doc_id, tx.r AS r1, h.rank AS r2 FROM tx FULL JOIN (SELECT query_id, id AS doc_id, rank FROM hits) h USING (query_id, doc_id)),
sc AS (SELECT fu.query_id, fu.doc_id, round(coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0) + CASE WHEN ch.concept_id IS NULL THEN 0 ELSE 0.15 END
    + CASE WHEN fu.doc_id IN (SELECT id FROM u WHERE regexp_matches(fs[idx + 1], 's\\s*r\\s*c\\s*3\\s*\\+\\s*\\S')) THEN 0.2 ELSE 0 END, 6) AS score
  FROM fu LEFT JOIN embeddings e ON e.vec_id = fu.doc_id LEFT JOIN ch ON ch.query_id = fu.query_id AND ch.concept_id = e.label LEFT JOIN documents d ON d.doc_id = fu.doc_id)
SELECT query_id, s.doc_id, score, {fx.TITLE_SQL} AS name, lang AS kind, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.doc_id) AS position
FROM sc s JOIN documents d ON d.doc_id = s.doc_id QUALIFY position <= 100""")
def rrf_term_search(t):
    docs = term_docs(t).filter("kind <> 'de'")
    kept = docs.select("doc_id")
    text = op.bm25_search(*index.kept_index(docs, list(TERM_BOOSTS)), queries(t), TERM_BOOSTS, None)
    near = vectors.knn(corpus(t).join(kept, F.col("id") == F.col("doc_id"), "left_semi"), query_vectors(t), None, DIM)
    concepts = vectors.knn(label_concepts(t), query_vectors(t), 3, DIM, in_place="queries").select("query_id", F.col("id").alias("concept_id"))
    of_term = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("concept_id"))
    formulas = op.formula_match(index.formula_harvest(latex_terms(t)), queries(t).select("query_id", F.lit(FORMULA_QUERY).alias("query")))
    fused = op.rrf_fusion(text, near, of_term, concepts, formulas.withColumnRenamed("id", "doc_id"))
    return op.rrf_page(fused, docs.select("doc_id", "name", "kind"), limit=100)


@query("formula_match")
def formula_match(t):
    asked = t.documents.select(F.xxhash64("source").alias("query_id"), F.concat("source", F.lit(" + ?a")).alias("query")).distinct()
    return op.formula_match(index.formula_harvest(latex_terms(t)), asked)


PART_FIELDS = f"SELECT p_partkey AS doc_id, 'name' AS field, {TOKENS.format('p_name')} AS w FROM part UNION ALL SELECT p_partkey, 'summary', {TOKENS.format('concat(p_type, chr(32), p_brand)')} FROM part"
PART_QUERIES = "(SELECT n_nationkey AS query_id, concat(CASE WHEN n_regionkey < 2 THEN 'cold' ELSE 'widget' END, ' Brand ', n_nationkey, ' promo') AS query FROM nation)"


@query("concept_fallback", "SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'cold') OR contains(lower(concat(p_type, ' ', p_brand)), 'brand#1')")
def concept_fallback(t):
    concepts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("summary"))
    return op.concept_fallback(concepts, "Cold", None).select("id").unionByName(op.concept_fallback(concepts, "BRAND#1", None).select("id")).distinct()


@query("concept_search", f"""WITH {bm25_sql(PART_FIELDS, {'name': 2.0, 'summary': 1.0}, 'sum', PART_QUERIES)}
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 20""")
def concept_search(t):
    docs = t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("summary"))
    asked = t.nation.select(F.col("n_nationkey").alias("query_id"), F.concat(
        F.when(F.col("n_regionkey") < 2, "cold").otherwise("widget"), F.lit(" Brand "), F.col("n_nationkey").cast("string"), F.lit(" promo")).alias("query"))
    boosts = {"name": 2.0, "summary": 1.0}
    return op.bm25_search(*index.kept_index(docs, list(boosts)), asked, boosts, 20, combine="sum")


@query("keyword_and_search", """SELECT p_partkey AS id, p_name AS title, p_brand AS author, p_type AS filename FROM part
WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')) AND (contains(lower(p_name), '#1') OR contains(lower(p_brand), '#1') OR contains(lower(p_type), '#1'))
  AND contains(lower(concat(p_name, chr(10), p_brand, chr(10), p_type)), 'mall') ORDER BY id LIMIT 5""")
def keyword_and_search(t):
    books = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_type").alias("filename"))
    return op.keyword_and_search(books, "Ring #1 mall")


@query("tag_suggestions", """
WITH own AS (SELECT DISTINCT trim(x) AS tag FROM (SELECT unnest(string_split(concat(p_type, ', ', p_brand), ',')) AS x FROM part) WHERE contains(lower(trim(x)), 'm')),
reg AS (SELECT DISTINCT trim(x) AS tag FROM (SELECT unnest(string_split(concat(c_mktsegment, ',', c_name), ',')) AS x FROM customer) WHERE contains(lower(trim(x)), 'm'))
SELECT DISTINCT tag FROM (FROM own UNION ALL SELECT * FROM reg WHERE (SELECT count(*) FROM own) < 10) ORDER BY tag LIMIT 10""")
def tag_suggestions(t):
    notes = t.part.select(F.concat_ws(", ", "p_type", "p_brand").alias("tags"))
    registry = t.customer.select(F.concat_ws(",", "c_mktsegment", "c_name").alias("keywords"))
    return op.tag_suggestions(notes, registry, "M")


@query("kb_vs_fulltext_eval", f"""WITH {bm25_sql(TERM_FIELDS.replace('@docs', 'documents'), TERM_BOOSTS)},
kb AS (SELECT query_id, doc_id FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 50),
k AS (SELECT query_id, count(*) AS kb_hits, count(*) FILTER (source = 'src2') AS placeholders FROM kb JOIN documents USING (doc_id) GROUP BY 1),
f AS (SELECT query_id, count(*) AS fts_hits FROM scores GROUP BY 1)
SELECT item_id AS query_id, coalesce(kb_hits, 0) AS kb_hits, coalesce(placeholders, 0) AS placeholders, coalesce(fts_hits, 0) AS fts_hits
FROM benchmark LEFT JOIN k ON k.query_id = item_id LEFT JOIN f ON f.query_id = item_id""")
def kb_vs_fulltext_eval(t):
    docs = term_docs(t)
    post, stats = index.kept_index(docs, list(TERM_BOOSTS))
    scores = op.bm25_scores(post, stats, queries(t), TERM_BOOSTS)
    kb = op.top_per_key(scores, ["query_id"], 50, F.col("score").desc(), "doc_id")
    bodies = docs.select("doc_id", F.when(F.col("source") == "src2", F.concat(F.lit("% Term: "), "latex")).otherwise(F.col("latex")).alias("latex"))
    return op.kb_vs_fulltext(queries(t), kb, scores, bodies)


TERM_VECS, CONCEPT_VECS = "(SELECT * FROM embeddings WHERE label >= 3)", "(SELECT * FROM embeddings WHERE label < 3)"
ANCHOR_HITS = f"""hits AS (SELECT query_id, id, rank, (1 + cosine) / 2 AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {COSINE} AS cosine,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS rank FROM {{0}} a, {{1}} b) WHERE rank <= 3),
anchor AS (SELECT query_id AS id, CASE WHEN max(score) >= 0.885 THEN 'LINKED' WHEN max(score) >= 0.85 THEN 'AMBIGUOUS' ELSE 'NONE' END AS status,
  min(id) FILTER (rank = 1) AS top, string_agg(concat(id, ':', printf('%.7f', score)), ',' ORDER BY rank) AS c FROM hits GROUP BY 1)"""


def term_vectors(t):
    return t.embeddings.filter("label >= 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def concept_vectors(t):
    return t.embeddings.filter("label < 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


# Mixed vectors: half a term and half its neighbour in number, so that all three outcomes occur.
def blended(t):
    other = t.embeddings.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("_o"))
    weight = (F.col("label") * 0.1).cast("float")
    mixed = F.zip_with("embedding", "_o", lambda a, b: (a * weight + b).cast("float"))
    return t.embeddings.join(other, "vec_id").select(F.col("vec_id").alias("id"), mixed.alias("vec"))


BLENDED = """(SELECT e.vec_id, list_transform(range(1, 65), lambda i: CAST(CAST(e.embedding[i] * CAST(e.label * 0.1 AS FLOAT) AS FLOAT) + o.embedding[i] AS FLOAT)) AS embedding
  FROM embeddings e JOIN embeddings o ON o.vec_id + 1 = e.vec_id)"""


@query("anchor_tier_a", f"""WITH {ANCHOR_HITS.format(BLENDED, 'embeddings')}
SELECT id, status, CASE status WHEN 'LINKED' THEN top END AS concept_id, CASE status WHEN 'AMBIGUOUS' THEN c END AS candidates FROM anchor""")
def anchor_tier_a(t):
    return anchoring.anchor_tier_a(blended(t), corpus(t), DIM)


@query("anchor_residue", f"""WITH {ANCHOR_HITS.format(BLENDED, CONCEPT_VECS)}, left_over AS (SELECT id FROM anchor WHERE status <> 'LINKED'),
{ANCHOR_HITS.format('(SELECT * FROM ' + BLENDED + ' WHERE vec_id IN (FROM left_over))', TERM_VECS).replace('hits', 'hits2').replace('anchor AS', 'anchor2 AS')}
SELECT id, status, CASE status WHEN 'LINKED' THEN top END AS concept_id, CASE status WHEN 'AMBIGUOUS' THEN c END AS candidates FROM anchor2""")
def anchor_residue(t):
    first = anchoring.anchor_tier_a(blended(t), concept_vectors(t), DIM)
    return anchoring.anchor_residue(first, term_vectors(t), blended(t), DIM)


@query("calibrate_thresholds", f"""
WITH s AS (SELECT * FROM {TERM_VECS} ), m AS (SELECT a.vec_id, (1 + max({COSINE})) / 2 AS s FROM s a, {CONCEPT_VECS} b GROUP BY 1)
SELECT round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(min(s), 6) AS min, round(max(s), 6) AS max, round(quantile_cont(s, 0.25), 6) AS p25, round(quantile_cont(s, 0.6), 6) AS p60,
  round(quantile_cont(s, 0.75), 6) AS p75, round(quantile_cont(s, 0.9), 6) AS p90 FROM m""")
def calibrate_thresholds(t):
    return anchoring.calibrate_thresholds(term_vectors(t), concept_vectors(t), DIM)


@query("concept_terms", f"""SELECT lang AS kind, count(*) OVER (PARTITION BY lang) AS n, {fx.TITLE_SQL} AS name FROM documents JOIN embeddings ON vec_id = doc_id WHERE label = 3""")
def concept_terms(t):
    terms = t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id")).select(F.col("label").alias("concept_id"), F.col("lang").alias("kind"), fx.title().alias("name"))
    return anchoring.concept_terms(terms, 3)
