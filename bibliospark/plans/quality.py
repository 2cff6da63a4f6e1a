"""Quality flags over the driver tables."""

from pyspark.sql import functions as F

from bibliospark.operators import quality as op
from bibliospark.plans import fixtures as fx
from bibliospark.plans.pages import DOC_PAGES, doc_pages
from bibliospark.plans.registry import query

RAW = """(SELECT doc_id AS id, source, lang, CASE source WHEN 'src1' THEN concat('  (c) ISBN ', text) WHEN 'src2' THEN concat('Bibliography', chr(10), text) WHEN 'src3' THEN concat('x', chr(10), 'Index', chr(10), text)
  WHEN 'src4' THEN repeat('1.2.', 40) ELSE text END AS t FROM documents)"""
STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def raw_pages(t):
    text, source = F.col("text"), F.col("source")
    return t.documents.select(F.col("doc_id").alias("id"), "source", (
        F.when(source == "src1", F.concat(F.lit("  (c) ISBN "), text)).when(source == "src2", F.concat(F.lit("Bibliography\n"), text))
        .when(source == "src3", F.concat(F.lit("x\nIndex\n"), text)).when(source == "src4", F.lit("1.2." * 40)).otherwise(text)).alias("t"))


CLASSES = f"""c AS (SELECT id, source, {STRIP.format('t')} AS t, lower(substr({STRIP.format('t')}, 1, 200)) AS h FROM {RAW}),
k AS (SELECT id, source, CASE WHEN length(t) < 100 OR regexp_matches(h, '©|isbn|all rights reserved|library of congress|printed in|table of contents')
  OR regexp_matches(h, '(^|\\n)(bibliography|references\\n|index\\n|index of notation|list of symbols|notation index|symbol index)')
  OR (len(string_split(t, '.')) - 1) / length(t) > 0.1 AND (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) / length(t) > 0.1 THEN 'skip' ELSE 'content' END AS page_class FROM c)"""


@query("classify_pages", f"WITH {CLASSES} SELECT id, page_class FROM k")
def classify_pages(t):
    return raw_pages(t).select("id", op.page_class("t").alias("page_class"))


@query("classify_counts", f"WITH {CLASSES} SELECT source, count(*) FILTER (page_class = 'content') AS content, count(*) FILTER (page_class = 'skip') AS skip FROM k GROUP BY 1")
def classify_counts(t):
    return op.classify_counts(raw_pages(t).select("source", op.page_class("t").alias("page_class")), "source")


# Bodies with markup put into the prose, the same way in both engines.
SWAPS = [(" of ", r" \begin{align} x & y \end{align} "), (" was ", r" \begin{proof} "), (" by ", r" \end{proof} "), (" are ", r" $a$ "), (" for ", r" & "), (" from ", r" \{ "), (" this ", r" {x "),
         (" with ", r" \left( \cite{a} "), (" une ", r" \bibitem{k} [1] "), (" les ", " $ "), (" der ", r" \begin{lemma} \begin{proof} \end{lemma} \end{proof} "), (" las ", r" \\ \$ } ")]


def body_sql(column: str = "text") -> str:
    for a, b in SWAPS:
        column = f"replace({column}, '{a}', '{b}')"
    return column


BODIES = f"(SELECT doc_id AS id, lang, source, {body_sql()} AS latex FROM documents)"


def bodies(t):
    latex = F.col("text")
    for a, b in SWAPS:
        latex = F.replace(latex, F.lit(a), F.lit(b))
    return t.documents.select(F.col("doc_id").alias("id"), "lang", "source", latex.alias("latex"))


def times(text: str, needle: str) -> str:
    return f"(len(string_split({text}, '{needle}')) - 1)"


@query("term_extractable", rf"""SELECT id, CAST(length(latex) >= 150 AND (contains(latex, '$') OR contains(latex, '\begin{{')) AND NOT ({times('lower(latex)', chr(92) + 'bibitem')} > 3 OR {times('latex', '[')} > 20) AS INT) AS extractable FROM {BODIES}""")
def term_extractable(t):
    return bodies(t).select("id", op.term_extractable("latex").cast("int").alias("extractable"))


LINT = rf"""n AS (SELECT id, latex, len(regexp_extract_all(latex, '\\begin\{{[^}}]+\}}')) AS b, len(regexp_extract_all(latex, '\\end\{{[^}}]+\}}')) AS e,
  replace(replace(replace(latex, '\\', ''), '\{{', ''), '\}}', '') AS s, {times("replace(replace(latex, '" + chr(92) + "$', ''), '$$', '')", '$')} AS d, {times('latex', '&')} - {times('latex', chr(92) + '&')} AS amp FROM {BODIES}),
l AS (SELECT id, list_filter([CASE WHEN b <> e THEN printf('Mismatched environment counts: %d begins vs %d ends', b, e) END,
  CASE WHEN {times('s', '{')} <> {times('s', '}')} THEN printf('Mismatched curly braces: %d opening vs %d closing', {times('s', '{')}, {times('s', '}')}) END,
  CASE WHEN d % 2 <> 0 THEN printf('Unbalanced inline math decorators ($ sign count is odd: %d)', d) END,
  CASE WHEN amp > 0 AND NOT regexp_matches(latex, 'tabular|matrix|align|gather|split|cases|array|multline|eqnarray') THEN printf('Found %d potential unescaped ampersands outside tabular/matrix environments', amp) END], lambda x: x IS NOT NULL) AS errors FROM n)"""


@query("latex_lint_counts", f"WITH {LINT} SELECT id, array_to_string(errors, '; ') AS errors FROM l")
def latex_lint_counts(t):
    return op.latex_lint(bodies(t), nesting=False).withColumn("errors", F.array_join("errors", "; "))


@query("latex_lint")
def latex_lint(t):
    return op.latex_lint(bodies(t)).withColumn("errors", F.array_join("errors", "; "))


@query("latex_lint_report", rf"WITH {LINT} SELECT regexp_replace(regexp_replace(e, '\d+', 'n', 'g'), '\{{[^}}]*\}}', '{{}}', 'g') AS error, count(*) AS n FROM (SELECT unnest(errors) AS e FROM l) GROUP BY 1")
def latex_lint_report(t):
    return op.lint_report(op.latex_lint(bodies(t), nesting=False))


@query("latex_lint_simple", rf"""SELECT id, CASE WHEN length({STRIP.format('latex')}) < 10 THEN 'Empty LaTeX code' ELSE array_to_string(list_filter([CASE WHEN {times('latex', '$')} % 2 <> 0 THEN 'Unbalanced $ delimiters' END,
  CASE WHEN {times('latex', chr(92) + 'begin{')} <> {times('latex', chr(92) + 'end{')} THEN 'Unbalanced \begin/\end environments' END, CASE WHEN {times('latex', chr(92) + 'left')} <> {times('latex', chr(92) + 'right')} THEN 'Unbalanced \left/\right delimiters' END], lambda x: x IS NOT NULL), '; ') END AS errors FROM {BODIES}""")
def latex_lint_simple(t):
    return bodies(t).select("id", F.array_join(op.latex_lint_simple("latex"), "; ").alias("errors"))


TOCS = """(SELECT doc_id AS id, CASE source WHEN 'src1' THEN concat(text, ' .....') WHEN 'src2' THEN replace(text, chr(10), ' . . . ... 12' || chr(10)) WHEN 'src3' THEN concat(text, ' \\dotfill 4') WHEN 'src4' THEN replace(text, '. ', '.. . .. .. ') ELSE text END AS latex FROM documents)"""


@query("toc_artifact", rf"""WITH d AS (SELECT id, latex, string_split(latex, chr(10)) AS l FROM {TOCS})
SELECT id, CAST(contains(latex, '.....') OR contains(latex, '. . . . .') OR contains(latex, '\dotfill') OR contains(latex, '\hspace')
  OR len(list_filter(l, lambda x: regexp_matches({STRIP.format('x')}, '(\d|\.)$') AND ({times('x', '.')} > 5 OR contains(x, '\dotfill')))) / len(l) > 0.3 AS INT) AS artifact FROM d""".replace("\\\\dotfill", "\\dotfill"))
def toc_artifact(t):
    text, source = F.col("text"), F.col("source")
    latex = (F.when(source == "src1", F.concat(text, F.lit(" ....."))).when(source == "src2", F.replace(text, F.lit("\n"), F.lit(" . . . ... 12\n")))
             .when(source == "src3", F.concat(text, F.lit(r" \dotfill 4"))).when(source == "src4", F.replace(text, F.lit(". "), F.lit(".. . .. .. "))).otherwise(text))
    return t.documents.select(F.col("doc_id").alias("id"), op.toc_artifact(latex).cast("int").alias("artifact"))


@query("ai_chatter", """WITH d AS (SELECT doc_id AS id, CASE source WHEN 'src1' THEN concat(text, ' (Note: x') WHEN 'src2' THEN concat('i WILL use ', text, ' Repair attempt') WHEN 'src3' THEN concat(text, ' I will fix') ELSE text END AS x FROM documents)
SELECT id, CAST(contains(x, '(Note:') OR list_sum(list_transform(['(note:', 'i will use', 'failed latex', 'repaired (c)', 'original text', 'i''ll try to match', 'the original text', 'i will fix', 'repair attempt'], lambda m: CAST(contains(lower(x), m) AS INT))) >= 2 AS INT) AS chatter FROM d""")
def ai_chatter(t):
    text, source = F.col("text"), F.col("source")
    latex = (F.when(source == "src1", F.concat(text, F.lit(" (Note: x"))).when(source == "src2", F.concat(F.lit("i WILL use "), text, F.lit(" Repair attempt")))
             .when(source == "src3", F.concat(text, F.lit(" I will fix"))).otherwise(text))
    return t.documents.select(F.col("doc_id").alias("id"), op.ai_chatter(latex).cast("int").alias("chatter"))


NAMES = f"CASE source WHEN 'src1' THEN 'Page 12' WHEN 'src2' THEN '•' WHEN 'src3' THEN concat(lang, ' Preface ') WHEN 'src4' THEN 'ab' WHEN 'src5' THEN 'z' ELSE {{0}} END"
GARBAGE_BODY = f"CASE WHEN lang = 'fr' THEN concat(title, '.') WHEN source = 'src6' THEN '% Term: x (Marker: y)' WHEN source = 'src7' THEN concat('\\textbf', '{{', title, '}}') WHEN source = 'src8' THEN repeat('\\cite', 20) ELSE text END".replace("{{", "{").replace("}}", "}")


@query("garbage_terms", rf"""
WITH d AS (SELECT doc_id AS id, source, lang, text, {fx.TITLE_SQL} AS title FROM documents), t AS (SELECT id, trim({NAMES.format('title')}) AS name, {STRIP.format('(' + GARBAGE_BODY + ')')} AS latex FROM d),
c AS (SELECT *, {STRIP.format("regexp_replace(latex, '" + chr(92)*2 + "begin" + chr(92) + "{[^}]+" + chr(92) + "}|" + chr(92)*2 + "end" + chr(92) + "{[^}]+" + chr(92) + "}|" + chr(92)*2 + "textbf|" + chr(92)*2 + "textit|%|Term:|marker:', '', 'g')")} AS b,
  len(regexp_extract_all(latex, '\\textit|\\cite|\(\d{{4}}\)')) AS ci, len(regexp_extract_all(latex, '[\$]|\\\[')) AS fo FROM t),
r AS (SELECT id, list_filter([CASE WHEN name IN ('•', '*', '.', '-', 'Page', 'Introduction to Modern Analysis', 'Introduction') THEN 'blacklisted name' END,
  CASE WHEN regexp_matches(lower(name), 'contents|index|bibliography|preface|notation|dedication|acknowledgements|copyright|series list|title page|foreword|introduction|exercises|references|epilogue|appendix|cover|oxford graduate texts') THEN 'structural name' END,
  CASE WHEN regexp_matches(name, '^Page \d+$') THEN 'page number' END, CASE WHEN length(name) < 3 AND NOT regexp_matches(name, '^[a-zA-Z]$') THEN 'short name' END,
  CASE WHEN contains(latex, '% Term:') OR contains(lower(latex), 'marker:') THEN 'placeholder body' END,
  CASE WHEN length(b) < 100 AND (NOT regexp_matches(b, '[\$\\]') OR lower(b) = lower(name) OR {STRIP.format("replace(lower(b), '.', '')")} = {STRIP.format("replace(lower(name), '.', '')")}) THEN 'short body' END,
  CASE WHEN ci > 15 AND fo < ci * 4 THEN 'citation list' END], lambda x: x IS NOT NULL) AS reasons FROM c)
SELECT id, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0""")
def garbage_terms(t):
    docs = t.documents.withColumn("title", fx.title())
    source, title = F.col("source"), F.col("title")
    name = (F.when(source == "src1", "Page 12").when(source == "src2", "•").when(source == "src3", F.concat("lang", F.lit(" Preface "))).when(source == "src4", "ab").when(source == "src5", "z").otherwise(title))
    latex = (F.when(F.col("lang") == "fr", F.concat(title, F.lit("."))).when(source == "src6", "% Term: x (Marker: y)").when(source == "src7", F.concat(F.lit("\\textbf{"), title, F.lit("}")))
             .when(source == "src8", F.lit("\\cite" * 20)).otherwise(F.col("text")))
    rows = docs.select(F.col("doc_id").alias("id"), name.alias("name"), latex.alias("latex"))
    return rows.select("id", op.garbage_reasons().alias("r")).filter(F.size("r") > 0).select("id", F.array_join("r", ",").alias("reasons"))


@query("strip_artifacts", rf"""
WITH d AS (SELECT doc_id AS id, CASE source WHEN 'src18' THEN 238 ELSE 1 END AS book_id, concat(' % --- PAGE ', n_chars, ' --- [latex  Body] ', text, ' introduction to modern analysis • Shmuel Kantorovitz and', ' Ami Viselter • Page 7 [ LaTeX Body: LATEX body :') AS x FROM documents)
SELECT id, {STRIP.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN book_id = 238 THEN replace(x, 'introduction to modern analysis • Shmuel Kantorovitz and Ami Viselter • Page 7', '') ELSE x END, '% --- PAGE " + chr(92) + "d+ ---', '', 'g'), '" + chr(92) + "[" + chr(92) + "s*latex" + chr(92) + "s*body" + chr(92) + "s*" + chr(92) + "]', '', 'gi'), '" + chr(92) + "[" + chr(92) + "s*latex" + chr(92) + "s*body" + chr(92) + "s*:" + chr(92) + "s*" + chr(92) + "]', '', 'gi'), 'latex" + chr(92) + "s*body" + chr(92) + "s*:', '', 'gi'), '" + chr(92) + "[" + chr(92) + "s*latex" + chr(92) + "s*body" + chr(92) + "s*', '', 'gi')")} AS latex FROM d""")
def strip_artifacts(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("source") == "src18", 238).otherwise(1).alias("book_id"), F.concat(
        F.lit(" % --- PAGE "), F.col("n_chars").cast("string"), F.lit(" --- [latex  Body] "), "text", F.lit(" introduction to modern analysis • Shmuel Kantorovitz and Ami Viselter • Page 7 [ LaTeX Body: LATEX body :")).alias("x"))
    return rows.select("id", op.strip_artifacts("x", "book_id").alias("latex"))


PROOFS = r"""CASE source WHEN 'src1' THEN concat('\noindent \textbf{Proof}. ', text) WHEN 'src2' THEN concat('proof \begin{lemma}', text) WHEN 'src3' THEN concat(text, ' [LaTeX Body]') WHEN 'src4' THEN concat(' {PROOF} LaTeX Body: ', text) ELSE text END"""


@query("term_diagnostics", rf"""
WITH d AS (SELECT doc_id AS id, source AS book_id, doc_id // 20 + 1 AS page, {PROOFS} AS x FROM documents),
f AS (SELECT *, contains(x, '[LaTeX Body]') OR contains(x, '[LaTeX body]') OR contains(x, 'LaTeX Body:') AS leak,
  starts_with(lower({STRIP.format("replace(replace(replace(replace(x, '" + chr(92) + "noindent', ''), '" + chr(92) + "textbf', ''), '{', ''), '}', '')")}), 'proof') AND NOT regexp_matches(lower(x), '\\begin\{{(theorem|proposition|lemma|corollary)\}}') AS orphan FROM d)
SELECT f.id, 'leak' AS issue, NULL AS previous_page, NULL AS own_page FROM f WHERE leak UNION ALL
SELECT f.id, 'orphaned proof', md5(a.content), md5(b.content) FROM f LEFT JOIN {DOC_PAGES} a ON a.book_id = f.book_id AND a.page = f.page - 1 LEFT JOIN {DOC_PAGES} b ON b.book_id = f.book_id AND b.page = f.page WHERE orphan""")
def term_diagnostics(t):
    text, source = F.col("text"), F.col("source")
    latex = (F.when(source == "src1", F.concat(F.lit(r"\noindent \textbf{Proof}. "), text)).when(source == "src2", F.concat(F.lit(r"proof \begin{lemma}"), text))
             .when(source == "src3", F.concat(text, F.lit(" [LaTeX Body]"))).when(source == "src4", F.concat(F.lit(" {PROOF} LaTeX Body: "), text)).otherwise(text))
    terms = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("book_id"), (F.floor(F.col("doc_id") / 20) + 1).alias("page"), latex.alias("latex"))
    none = F.lit(None).cast("string")
    leaks = terms.filter(op.body_leak("latex")).select("id", F.lit("leak").alias("issue"), none.alias("previous_page"), none.alias("own_page"))
    orphans = op.orphan_context(terms, doc_pages(t))
    return leaks.unionByName(orphans.select("id", F.lit("orphaned proof").alias("issue"), F.md5("previous_page").alias("previous_page"), F.md5("own_page").alias("own_page")))


INDEXES = r"""(SELECT doc_id AS id, CASE source WHEN 'src1' THEN replace(text, '.', ' | 12, 14-16' || chr(10)) WHEN 'src2' THEN replace(text, '. ', ', xiv' || chr(10)) WHEN 'src3' THEN replace(text, ' ', ' | 123' || chr(10)) WHEN 'src4' THEN repeat(text, 30) WHEN 'src5' THEN concat(chr(10), '  ') ELSE text END AS x FROM documents)"""


@query("index_audit", rf"""
WITH d AS (SELECT id, x, regexp_replace(x, '\s+', '', 'g') AS z, list_filter(list_transform(string_split_regex(x, '\r\n|[\n\r]'), lambda y: {STRIP.format('y')}), lambda y: y <> '') AS l FROM {INDEXES} WHERE length(x) > 0),
m AS (SELECT id, length(x) AS chars, len(l) AS lines, coalesce((length(z) - length(regexp_replace(z, '[0-9]', '', 'g'))) / nullif(length(z), 0), 0.0) AS density,
  coalesce(len(list_filter(l, lambda y: (contains(y, '|') AND regexp_matches(y, '[\d,\s-]+$')) OR regexp_matches(y, ',\s*[\divxIVX]+(?:[-–][\divxIVX]+)?$'))) / nullif(len(l), 0), 0.0) AS structured,
  coalesce(len(list_filter(l, lambda y: contains(y, '|') AND regexp_matches(y, '[\d,\s-]+$'))) / nullif(len(l), 0), 0.0) AS piped FROM d)
SELECT id, chars, lines, density, structured, array_to_string(list_filter([CASE WHEN lines = 0 OR chars < 200 THEN 'SHORT' END, CASE WHEN lines > 0 AND chars > 50000 THEN 'LONG' END,
  CASE WHEN density < 0.02 THEN 'TXT' END, CASE WHEN structured < 0.3 THEN 'UNSTRUCT' END], lambda y: y IS NOT NULL), ',') AS flags, CAST(density >= 0.05 AND piped >= 0.2 AS INT) AS backfill FROM m""")
def index_audit(t):
    text, source = F.col("text"), F.col("source")
    index = (F.when(source == "src1", F.replace(text, F.lit("."), F.lit(" | 12, 14-16\n"))).when(source == "src2", F.replace(text, F.lit(". "), F.lit(", xiv\n")))
             .when(source == "src3", F.replace(text, F.lit(" "), F.lit(" | 123\n"))).when(source == "src4", F.repeat(text, 30)).when(source == "src5", F.lit("\n  ")).otherwise(text))
    return op.index_audit(t.documents.select(F.col("doc_id").alias("id"), index.alias("index_text")))


@query("language_mismatch", rf"""
WITH b AS (SELECT doc_id AS id, lang, CASE WHEN source = 'src1' THEN concat('Analysis ', lang) WHEN source = 'src2' THEN concat('The ', {fx.TITLE_SQL}) WHEN source = 'src3' THEN 'english analysis' WHEN source = 'src4' THEN 'Translated for all transl. from the German' ELSE {fx.TITLE_SQL} END AS title,
  CASE WHEN source = 'src2' AND lang = 'en' THEN 'x/German/a' WHEN lang = 'fr' THEN 'y/(English)/b' ELSE 'z' END AS path,
  CASE WHEN source = 'src1' THEN concat('Algebra ', doc_id, ' - Band.pdf') WHEN source = 'src2' THEN concat('Author - Titel ', doc_id, '.v2.pdf') ELSE 'plain.pdf' END AS filename, text AS content FROM documents),
f AS (SELECT *, list_has_any(string_split_regex(lower(content), '\s+'), ['und','der','die','das','für','einleitung','lehrbuch','vorlesungen','bände','band']) AS g,
  list_has_any(string_split_regex(lower(title), '\s+'), ['and','the','for','introduction','textbook','lectures','volume','transl.']) OR contains(lower(title), 'analysis') AS e FROM b)
SELECT id, title, CASE WHEN filename LIKE 'Algebra%' THEN split_part(filename, ' - ', 1) WHEN filename LIKE 'Author%' THEN regexp_replace(split_part(filename, ' - ', 2), '\.[^.]*$', '') END AS proposed FROM f
WHERE (g OR contains(lower(path), 'german')) AND e AND NOT contains(lower(path), '(english)') AND (contains(lower(title), 'transl. from the german') OR NOT (contains(lower(title), 'english') OR contains(lower(title), 'translated')))""")
def language_mismatch(t):
    source, lang, doc = F.col("source"), F.col("lang"), F.col("doc_id").cast("string")
    title = (F.when(source == "src1", F.concat(F.lit("Analysis "), lang)).when(source == "src2", F.concat(F.lit("The "), fx.title())).when(source == "src3", "english analysis")
             .when(source == "src4", "Translated for all transl. from the German").otherwise(fx.title()))
    books = t.documents.select(
        F.col("doc_id").alias("id"), title.alias("title"), F.when((source == "src2") & (lang == "en"), "x/German/a").when(lang == "fr", "y/(English)/b").otherwise("z").alias("path"),
        F.when(source == "src1", F.concat(F.lit("Algebra "), doc, F.lit(" - Band.pdf"))).when(source == "src2", F.concat(F.lit("Author - Titel "), doc, F.lit(".v2.pdf"))).otherwise("plain.pdf").alias("filename"),
        F.col("text").alias("content"))
    return op.language_mismatch(books)


@query("title_filename_conflict")
def title_filename_conflict(t):
    return op.title_filename_conflict(t.documents.select(F.col("doc_id").alias("id"), fx.title().alias("title"), F.concat("source", F.lit("_"), "lang", F.lit(".pdf")).alias("filename")))


@query("extract_identifiers", rf"""
WITH p AS (SELECT book_id, page, CASE WHEN role = 'user' AND page > 2 THEN concat(content, ' isbn-13: 978-', lpad(CAST(book_id // 2 AS VARCHAR), 10, '0'), ' ') ELSE content END AS c FROM {fx.PAGES_SQL}),
x AS (SELECT book_id, regexp_replace(regexp_extract(string_agg(c, '' ORDER BY page), 'ISBN(?:-1[03])?:?\s*([\d\- X]{{10,17}})', 1, 'i'), '[^\dXx]', '', 'g') AS i FROM p GROUP BY 1),
y AS (SELECT book_id, CASE WHEN length(i) IN (10, 13) THEN i END AS isbn FROM x),
f AS (SELECT DISTINCT book_id, CASE WHEN book_id % 3 = 0 THEN concat('2101.', lpad(CAST(book_id AS VARCHAR), 5, '0')) WHEN book_id % 3 = 1 THEN concat('math-ph/', lpad(CAST(book_id AS VARCHAR), 7, '0')) END AS arxiv_id FROM p)
SELECT f.book_id, isbn, arxiv_id, CASE WHEN isbn IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY isbn) END AS same_isbn FROM f LEFT JOIN y ON y.book_id = f.book_id""")
def extract_identifiers(t):
    book = F.col("book_id")
    pages = fx.pages(t).select("book_id", "page", F.when((F.col("role") == "user") & (F.col("page") > 2), F.concat(
        "content", F.lit(" isbn-13: 978-"), F.lpad(F.floor(book / 2).cast("string"), 10, "0"), F.lit(" "))).otherwise(F.col("content")).alias("content"))
    name = (F.when(book % 3 == 0, F.concat(F.lit("2101."), F.lpad(book.cast("string"), 5, "0"), F.lit("v1.pdf")))
            .when(book % 3 == 1, F.concat(F.lit("1/math-ph/"), F.lpad(book.cast("string"), 7, "0"), F.lit(".pdf"))).otherwise("plain.pdf"))
    return op.extract_identifiers(pages, pages.select("book_id", name.alias("filename")).distinct())
