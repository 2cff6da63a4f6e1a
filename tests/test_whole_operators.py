"""Operators with Python steps as wholes, against plain rewritings of their rules."""

import random

from test_similarity import brute_partial

from bibliospark.functions.passages import Form, proposed_starts
from bibliospark.operators import pages, prep


def found_at(text, marker):
    """(position, stage) by trying every start."""
    if marker in text:
        return text.index(marker), "exact"
    if marker.lower() in text.lower():
        return text.lower().index(marker.lower()), "lower"
    form, wanted = Form(text), Form(marker).text
    if not wanted:
        return None
    if wanted in form.text:
        return form.offsets[form.text.index(wanted)], "fuzzy"
    text, marker = text.lower(), marker.lower()
    best, at = 85.0, -1
    for i in [*proposed_starts(text, marker), *range(max(0, len(text) - len(marker)) + 1)]:
        score = brute_partial(marker, text[i : i + len(marker) + 40])
        if score > best:
            best, at = score, i
    return (at, "fuzzy") if at >= 0 else None


def damaged(rng, text):
    return "".join(rng.choice("xyz") if rng.random() < 0.06 else c for c in text)


def test_locate_passage(spark):
    rng = random.Random(41)
    vocabulary = ["ring", "module", "the", "finite", "cover", "Let", "of", "a", "prime"]
    rows = [(0, "", "ring"), (1, None, "ring"), (2, "a ring", ""), (3, "$a$ \\emph{ring} b", "a ring"), (4, "a ring", "$ -"), (5, "THE RING", "the ring")]
    for i in range(10, 34):
        words = [rng.choice(vocabulary) for _ in range(14)]
        text = " ".join(words)
        start = rng.randrange(10)
        marker = " ".join(words[start : start + 3])
        rows.append((i, text if i % 3 else damaged(rng, text), marker if i % 4 else damaged(rng, marker)))
    got = {r.id: (r.position, r.stage) for r in pages.locate_passage(spark.createDataFrame(rows, "id long, content string, marker string")).collect()}
    want = {i: found_at(text, marker) for i, text, marker in rows if text is not None and marker}
    assert got == {i: hit for i, hit in want.items() if hit} and {stage for _, stage in got.values()} == {"exact", "lower", "fuzzy"}


def test_recover_placeholders_fuzzy(spark):
    terms = [(1, 7, 3, "(marker: finite cover of)"), (2, 7, 3, "(marker: finte cover of)"), (3, 7, 9, "(marker: finite cover of)"), (4, 7, 3, "body"), (5, 7, 3, "(marker: )")]
    held = [(7, 1, "finite cover of nothing"), (7, 2, "no such"), (7, 4, "every finite cover of it"), (7, 5, "a finite cover of b"), (8, 3, "finite cover of")]
    got = pages.recover_placeholders(spark.createDataFrame(terms, "id long, book_id long, page long, latex string"), spark.createDataFrame(held, "book_id long, page long, content string"))
    text = held[2][2]
    assert {tuple(r) for r in got.collect()} == {(1, 4, "finite cover of it"), (2, 4, text[found_at(text, "finte cover of")[0] :])}


def test_html_to_chunks(spark):
    body = "".join(f"<p>{'word ' * 120}{i}</p>" for i in range(30))
    rows = [(1, f"<html><body><nav>no</nav><div id='bodyContent'>{body}</div><p>outside</p></body></html>"), (2, "<p>x</p>"), (3, ""), (4, None)]
    got = {}
    for r in prep.html_to_chunks(spark.createDataFrame(rows, "id long, html string"), size=500).collect():
        got.setdefault(r.id, {})[r.chunk_no] = r.chunk
    text = "\n\n".join(f"{('word ' * 120)}{i}" for i in range(30))
    assert set(got) == {1} and sorted(got[1]) == list(range(len(got[1])))
    joined = "".join(got[1][n] for n in sorted(got[1]))
    assert joined == text and all(len(c) == 500 for n, c in got[1].items() if n < len(got[1]) - 1)


def test_embedding_text_terms(spark):
    rows = [(1, "A", "lemma", r"x \begin{proof}gone \begin{proof}deep\end{proof}\end{proof} y $$z$$ w", '["p","q"]'),
            (2, "B", "theorem", r"\begin{align}a\end{align} b  \[c\]  d", "plain"), (3, "C", "remark", None, None), (4, "D", "lemma", "e\n\nf Proof. g \\blacksquare h", "[]")]
    got = {r.id: r.text for r in prep.embedding_text_terms(spark.createDataFrame(rows, "id long, name string, kind string, latex string, used_terms string")).collect()}
    assert got == {1: "A (Type: lemma). Concepts: p, q. Statement: x y [EQUATION] w", 2: "B (Type: theorem). Concepts: plain. Statement: [EQUATION] b [EQUATION] d",
                   3: "C (Type: remark). Concepts: . Statement: ", 4: "D (Type: lemma). Concepts: . Statement: e f h"}
