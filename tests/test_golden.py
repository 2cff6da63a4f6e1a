"""Known answers: index lookup, title normalisation, matching, duplicates, markup and parsing."""

import difflib
import hashlib
import os
import random
import tempfile

from pyspark.sql import functions as F

from bibliospark.functions import text as tx
from bibliospark.functions.latex import drop_environment, environment_errors
from bibliospark.functions.markup import html_to_text
from bibliospark.functions.similarity import ratio, token_set
from bibliospark.operators import filters, matcher, quality, resolve, retrieval, vectors
from bibliospark.operators.aggregate import parse_authors
from bibliospark.sources import catalog, exports
from bibliospark.sources.index import kept_index


def test_index_pages(spark):
    cases = [
        ("Hausdorff space 12, 14-16, 20", "Hausdorff space", "12, 14-16, 20"),
        ("Compactness, sequential 45\nCompactness, local 48, 50", "Compactness, local", "48, 50"),
        ("Metric space 100", "metric space", "100"), ("Metric space 100", "Banach space", None),
        ("Lebesgue integral\n   definition of, 150\n   properties of, 152-155", "Lebesgue integral", "150, 152-155"),
        ("p-series 10", "p series", "10"), ("p series 20", "p-series", "20")]
    rows = spark.createDataFrame([(i, t, q, 1.0) for i, (t, q, _) in enumerate(cases)], "id long, index_text string, query string, score double")
    got = {r["id"]: (r["index_matches"], r["score"]) for r in retrieval.index_lookup(rows).collect()}
    assert got == {i: (w, 1.5 if w else 1.0) for i, (_, _, w) in enumerate(cases)}


def test_normalize(spark):
    row = spark.range(1).select(tx.normalize_title(F.lit("Real Analysis (2nd ed.)")), tx.normalize_title(F.lit("Algebraic-Topology")), F.array_join(tx.title_tokens(F.lit("The of")), " ")).first()
    assert tuple(row) == ("real analysis", "algebraic topology", "the of")


BOOKS = [(1, "Probability and Measure", "P. Billingsley"), (2, "Real Analysis: Modern Techniques and Their Applications", "Gerald B. Folland"),
         (3, "Algebraic Topology", "Allen Hatcher")]


def test_match_cascade(spark):
    books = spark.createDataFrame(BOOKS, "id long, title string, author string")
    asked = [(1, "Probability and Measure", "P. Billingsley", "exact"), (2, "Probability and Measure", "P Billingsley", "normalized"),
             (3, "Algebrac Topology", "Allen Hatcher", "fuzzy"), (4, "Real Techniques", "Folland", "token"), (5, "Non-existent Book", "Nobody", None)]
    got = {r["query_id"]: r["strategy"] for r in matcher.match_cascade(spark.createDataFrame([a[:3] for a in asked], "query_id long, title string, author string"), books, 0.7).collect()}
    assert got == {a[0]: a[3] for a in asked}


def title_sample(seed, n):
    rng = random.Random(seed)
    stems = ["analysis", "algebra", "topology", "measure", "the", "of", "real", "modern", "theory", "graphs"]
    def damage(w):
        return w if rng.random() < 0.7 else w.replace(rng.choice(w), "", 1)
    return [" ".join(damage(rng.choice(stems)) for _ in range(rng.randrange(2, 5))) for _ in range(n)]


def test_fuzzy_and_wishlist_against_all_pairs(spark):
    titles, wishes = title_sample(1, 80), title_sample(2, 60)
    books = spark.createDataFrame([(i, t, "") for i, t in enumerate(titles)], "id long, title string, author string")
    asked = spark.createDataFrame([(t, "") for t in sorted(set(wishes))], "title string, author string")
    tokens = {r["title"]: r["w"] for r in asked.select("title", tx.title_tokens("title").alias("w")).collect()}
    expected = {}
    for wish in set(wishes):
        held = [(round((ratio(wish, t) * 0.7 + 30.0) / 100, 6), -i) for i, t in enumerate(titles) if any(w in t for w in tokens[wish][:3]) and ratio(wish, t) >= 85]
        if held:
            best = max(held)
            same = [i for i, t in enumerate(titles) if t == titles[-best[1]]]
            expected[wish] = (min(same), best[0])
    got = {r["title"]: (r["id"], r["score"]) for r in matcher.match_fuzzy(asked, matcher.distinct_books(books)).collect()}
    assert got == expected
    wanted = spark.createDataFrame(list(enumerate(wishes)), "id long, title string")
    acquired = {r["id"] for r in matcher.wishlist_acquired(wanted, books).collect()}
    assert acquired == {i for i, w in enumerate(wishes) if any(token_set(w, t) > 85 for t in titles)}


def near_terms(seed, n):
    rng = random.Random(seed)
    base = ["let x be a compact space with a countable base", "every bounded sequence has a convergent subsequence", "a graph is a pair of sets"]
    rows = []
    for i in range(n):
        text = rng.choice(base)
        if rng.random() < 0.5:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("xyz") + text[at + rng.randrange(4):]
        rows.append((i, rng.randrange(2), rng.randrange(14), text))
    return rows


def brute_near(rows):
    ordered = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    pairs = []
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if a[1] == b[1] and b[2] - a[2] <= 5 and abs(len(a[3]) - len(b[3])) / max(len(a[3]), len(b[3])) <= 0.3:
                if difflib.SequenceMatcher(None, a[3], b[3]).ratio() > 0.85:
                    pairs.append((a[0], b[0]))
    return ordered, pairs


def test_near_duplicates_against_all_pairs(spark):
    rows = near_terms(5, 90)
    ordered, pairs = brute_near(rows)
    df = spark.createDataFrame(rows, "id long, book_id long, page long, latex string")
    got = resolve.near_dup_pairs(df)
    first = {}
    for r in sorted(rows):
        first.setdefault(r[1:], r[0])
    rep = {r[0]: first[r[1:]] for r in rows}
    compact = {(rep[a], rep[b]) for a, b in pairs if rep[a] != rep[b]} | {(rep[i], i) for i in rep if rep[i] != i}
    place = {r[0]: (r[2], r[0]) for r in rows}
    compact = {(a, b) if place[a] < place[b] else (b, a) for a, b in compact}
    assert {(r["id_a"], r["id_b"]) for r in got.collect()} == compact
    removed = set()
    for i, _ in enumerate(ordered):
        a = ordered[i][0]
        if a not in removed:
            removed |= {y for x, y in pairs if x == a}
    assert {r["id"] for r in resolve.near_dup_delete(got).collect()} == removed


def test_duplicate_survivor_and_incoming(spark):
    rows = [(1, "99_General_and_Diverse/Unsorted/a.pdf", "h"), (2, "Analysis/a-long-long-long-name.pdf", "h"), (3, "x", "other")]
    books = spark.createDataFrame(rows, "id long, path string, file_hash string")
    assert {(r["id"], r["survivor"]) for r in resolve.duplicate_groups(books, "file_hash").collect()} == {(1, 2), (2, 2)}
    stored = spark.createDataFrame([(7, "p", "h1", "Algebraic Topology", "Allen Hatcher")], "id long, path string, hash string, title string, author string")
    new = spark.createDataFrame([(1, "h1", "Anything", "X"), (2, "h2", "Algebraic: notes", "Hatcher"), (3, "h3", "Set Theory", "Jech")], "id long, hash string, title string, author string")
    assert {tuple(r) for r in resolve.incoming_duplicate(new, stored).collect()} == {(1, "HASH", 7), (2, "SEMANTIC", 7)}
    hashed = resolve.content_hash(spark.createDataFrame([(1, "abc", None)], "id long, content string, file_hash string")).first()
    assert hashed["file_hash"] == hashlib.sha256(b"abc").hexdigest()


def test_bibtex_keys(spark):
    rows = [("Patrick Billingsley", "Probability and Measure"), (None, None), ("L.C. Evans", "Partial Differential Equations"), ("A", "On it")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, t string").select(exports.bibtex_key(F.col("a"), F.col("t"))).collect()]
    assert got == ["PatrickProbability", "UnknownUnknown", "LCPartial", "ABook"]


def test_page_ranges_and_authors(spark):
    row = spark.range(1).select(
        filters.pages_of_range(F.lit("1-5, 10, 9-7, x, 3-4-5, 40"), F.lit(12)), parse_authors(F.lit("Doe, J., Roe, R.")), parse_authors(F.lit("A and B AND C")), parse_authors(F.lit("A And B"))).first()
    assert list(row) == [[1, 2, 3, 4, 5, 10], ["J. Doe", "R. Roe"], ["A", "B", "C"], ["A And B"]]


def test_file_listing(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name in ("A/Doe - On Sets.pdf", "A/plain.PDF", ".git/x.pdf", "exports/y.epub", "A/notes.txt", "b.djvu"):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        open(f"{root}/{name}", "w").write("x")
    got = {r["path"]: (r["author"], r["title"]) for r in catalog.catalog_scan(catalog.list_files(spark, root)).collect()}
    assert got == {"A/Doe - On Sets.pdf": ("Doe", "On Sets"), "A/plain.PDF": ("Unknown", "plain"), "b.djvu": ("Unknown", "b")}


def test_latex_helpers(spark):
    crossed = spark.createDataFrame([(r"\begin{a}\begin{b}\end{a}\end{b}",)], "x string").select(environment_errors(F.col("x"))).first()[0]
    assert crossed == [r"Environment nesting error: expected \end{b}, found \end{a}", r"Environment nesting error: expected \end{a}, found \end{b}"]
    assert drop_environment(r"x\begin{p}a\begin{p}b\end{p}c\end{p}y\begin{p}z", "p", "-") == "x-y-"
    rows = spark.createDataFrame([(1, r"\begin{a}{x}\end{a} $y$"), (2, ""), (3, r"\end{b}\begin{b}"), (4, r"a & b $")], "id long, latex string")
    got = {r["id"]: list(r["errors"]) for r in quality.latex_lint(rows).collect()}
    assert got[1] == [] and got[2] == ["Empty LaTeX code"] and got[3] == [r"Unmatched \end{b}", "Unclosed environments remaining: b"] and len(got[4]) == 2


def test_html():
    page = "<html><body><nav><p>no</p></nav><div id='c'><p>One <b>two</b>&amp;<br>three<!-- x -->four</p><table><tr><td>no</td></tr></table><script>var a='<p>';</script></div><p>five</p></body></html>"
    assert html_to_text(page, "c") == "One\n\ntwo\n\n&\n\nthree\n\nfour"
    assert html_to_text(page).endswith("five")


def test_formula_patterns(spark):
    rows = spark.createDataFrame([(1, 0, r"a^2 + b^2 = c^2"), (2, 0, r"x + y = y + x"), (3, 0, r"\frac{1}{n} + 1"), (4, 0, "x + y = z + x")], "id long, idx int, formula string")
    asked = spark.createDataFrame([(1, "?a + ?b = ?b + ?a"), (2, r"\frac{1}{?n}"), (3, "b^2 = ?x")], "query_id long, query string")
    assert {tuple(r) for r in retrieval.formula_match(rows, asked).collect()} == {(1, 2), (2, 3), (3, 1)}


def test_knn_blocks_and_sides_agree(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(150)] + [(500, [0.0] * 8), (501, [1.0, 2.0])]
    corpus = spark.createDataFrame(rows, "id long, vec array<float>")
    asked = corpus.filter("id < 40").selectExpr("id as query_id", "vec")
    one = {tuple(r) for r in vectors.knn(corpus, asked, 5, 8).collect()}
    assert len(one) == 200
    for block, side in ((16, "corpus"), (16, "queries"), (1024, "queries")):
        assert {tuple(r) for r in vectors.knn(corpus, asked, 5, 8, block, side).collect()} == one


def test_highlight_and_search(spark):
    docs = spark.createDataFrame([(1, "Measure theory and integration"), (2, "Theory of sets"), (3, "Measures")], "doc_id long, text string")
    post, stats = kept_index(docs, ["text"])
    asked = spark.createDataFrame([(9, "measure theory")], "query_id long, query string")
    assert [r["doc_id"] for r in retrieval.bm25_search(post, stats, asked, {"text": 1.0}).orderBy("rank").collect()] == [1, 2]
    assert [r["doc_id"] for r in retrieval.fts_search(post, stats, asked, field="text").collect()] == [1]
    shown = spark.range(1).select(retrieval.highlight(F.lit("On Measure spaces"), F.array(F.lit("measure")))).first()[0]
    assert shown == "On <b>Measure</b> spaces"
