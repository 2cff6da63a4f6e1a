"""Normalised titles: candidates follow the matches, not the texts that share a word, and rows equal brute force."""

import random
import re

from bibliospark.operators import blocking, matcher, resolve

CATALOGUE = "id long, b_title string, b_author string"


def brute(wanted, books):
    def normal(s):
        return re.sub(r"[^\w]+", " ", re.sub(r"\(\d+(?:st|nd|rd|th)?\s*ed\.?\)", "", s.lower())).strip()

    def loose(s):
        return s.lower().replace("-", " ").replace(".", "").replace(",", "")

    held = [(loose(t), loose(a), i) for i, t, a in books]
    out = {}
    for title, author in wanted:
        ids = [i for t, a, i in held if normal(title) and normal(title) in t and normal(author) in a]
        if author and ids:
            out[title, author] = min(ids)
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "an", "anna", "x_y", "art", "part", "arts", "smart", "7", "été", "to", "too"]
    gaps = [" "] * 8 + ["  ", "-", ", ", ". ", ": ", "'", "\n", " ́"]

    def title(most):
        parts = [rng.choice(words) for _ in range(rng.randint(1, most))]
        return "".join(w + rng.choice(gaps) for w in parts[:-1]) + parts[-1]

    authors = ["src1", "src12", "SRC2", "o. hara", "src-1", ""]
    books = [(i, title(9).upper() if i % 3 else title(9), rng.choice(authors)) for i in range(400)] + [(900, "", "src1"), (901, "...", "src1")]
    wanted = [(title(7) + rng.choice(["", " (3rd ed.)"]), rng.choice(authors + ["!!", "nobody"])) for _ in range(600)] + [("...", "src1")]
    wanted = sorted(set(wanted))
    rows = matcher.match_normalized(spark.createDataFrame(wanted, "title string, author string"), spark.createDataFrame(books, CATALOGUE))
    got = {(r.title, r.author): r.id for r in rows.collect()}
    want = brute(wanted, books)
    assert len({len(tokens.split()) for tokens, _ in want}) >= 5
    assert got == want


def test_common_words_make_no_pairs(spark, monkeypatch):
    """Every title shares its inner words with many others, but not three of them in a row."""
    candidates, pairs = [], blocking.rare_key_pairs

    def counted(*args):
        found = pairs(*args)
        candidates.append(found.count())
        return found

    for module in (matcher, resolve, blocking):
        monkeypatch.setattr(module, "rare_key_pairs", counted)
    words = [f"w{i}" for i in range(6)]
    titles = [f"{a} {b} {c} {d} {e}" for a in "pq" for b in words for c in words for d in words for e in "rs"]
    books = spark.createDataFrame([(i, t, "src1") for i, t in enumerate(titles)], CATALOGUE)
    got = matcher.match_normalized(spark.createDataFrame([(t, "src1") for t in titles], "title string, author string"), books)
    assert {(r.title, r.id) for r in got.collect()} == {(t, i) for i, t in enumerate(titles)}
    assert sum(candidates) < 6 * len(titles), candidates


def test_windows(spark):
    row = spark.createDataFrame([("aa b  cc d-e f x_1 gg",)], "t string")
    assert [row.select(matcher.word_windows("t", n).alias("w")).first().w for n in (1, 2, 3)] == [
        ["aa", "b", "cc", "d", "e", "f", "x_1", "gg"], ["aa b", "cc d", "e f", "f x_1", "x_1 gg"], ["e f x_1", "f x_1 gg"]]
