"""Ratios against brute force."""

import difflib
import random

import numpy as np
import pandas as pd

from bibliospark.functions.similarity import Blocks, Subsequence, lcs_length, partial, ratio, token_set
from bibliospark.functions.passages import Form, aligned, locate, proposed_starts


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def brute_ratio(a, b):
    return 100.0 if not a + b else 200.0 * brute_lcs(a, b) / (len(a) + len(b))


def brute_partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    windows = [b[max(s, 0) : s + len(a)] for s in range(1 - len(a), len(b))]
    best = max(brute_ratio(a, w) for w in windows)
    if len(a) == len(b):
        best = max(best, max(brute_ratio(b, a[max(s, 0) : s + len(b)]) for s in range(1 - len(b), len(a))))
    return best


def words(rng, n, alphabet="abcé "):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_ratios_match_brute_force():
    rng = random.Random(7)
    for _ in range(400):
        a, b = words(rng, rng.randrange(12)), words(rng, rng.randrange(16))
        assert lcs_length(a, b) == brute_lcs(a, b)
        assert abs(ratio(a, b) - brute_ratio(a, b)) < 1e-9
        assert ratio(a, b) == ratio(b, a)
        assert 0 <= ratio(a, b) <= 100
        assert abs(partial(a, b) - brute_partial(a, b)) < 1e-9


def test_partial_with_floor_keeps_better_scores():
    rng = random.Random(8)
    for _ in range(200):
        a, b = words(rng, 6), words(rng, 14)
        assert partial(a, b, 60.0) == max(60.0, brute_partial(a, b))


def test_token_set():
    assert token_set("real analysis", "analysis real modern") == 100.0
    assert token_set("", "a") == 0.0
    assert token_set("abc", "abd") == ratio("abc", "abd")
    assert token_set("x abc", "x abd") == max(ratio("x abc", "x abd"), ratio("x", "x abc"), ratio("x", "x abd"))


def test_alignment_skips_nothing():
    rng = random.Random(9)
    for _ in range(40):
        text, marker = words(rng, 80), words(rng, 8)
        expected, at = 50.0, -1
        for i in range(len(text) - len(marker)):
            score = brute_partial(marker, text[i : i + len(marker) + 40])
            if score > expected:
                expected, at = score, i
        assert aligned(text, marker, 50.0, list(range(len(text) - len(marker)))) == at


def test_markers():
    text = "Intro text. Let $x$ be a $compact$  set in the plane, then every cover is finite and so on."
    assert text[locate(text, "be a compact set in") :].startswith("be a $compact$")
    assert 10 < locate(text, "be a cmpact sets in the plane then") < text.index("compact")
    assert locate(text, "zzzz qqqq kkkk wwww vvvv") == -1 and locate(text, "$ -") == -1
    assert text[locate(text, "let x be a compact") :].startswith("Let $x$")
    damaged = "a \\emph{b}C~d\\section*[x]{E}"
    assert Form(damaged).text == "abcde" and [damaged[i] for i in Form(damaged).offsets] == ["a", "b", "C", "d", "E"]
    assert damaged[locate(damaged, "\\textbf{c} d e") :].startswith("C~d")


def test_damaged_markers_whose_stop_word_stands_elsewhere():
    marker, damaged = "the noetherian module condition", "tne noetherlan modu1e conditlon"
    for text in (f"all the rest of this page is about other things, at some length; {damaged} holds.", f"{damaged} holds, and more than forty characters further on the page ends."):
        assert abs(locate(text, marker) - text.index(damaged)) <= 40 and locate(text, marker) >= 0
    rng = random.Random(11)
    for _ in range(30):
        marker = " ".join(words(rng, rng.randrange(3, 6), "abc") for _ in range(3))
        text = " ".join(rng.choice([*marker.split(), words(rng, 4, "abcd"), marker[2:]]) for _ in range(25))
        expected, at = 60.0, -1
        for i in [*proposed_starts(text, marker), *range(len(text) - len(marker) + 1)]:
            score = brute_partial(marker, text[i : i + len(marker) + 40])
            if score > expected:
                expected, at = score, i
        assert aligned(text, marker, 60.0) == at


def test_matching_blocks_are_difflibs():
    rng = random.Random(12)
    for k in range(600):
        letters = "ab" if k % 3 == 0 else "abcdé "
        a = words(rng, rng.randrange(40), letters)
        b = "".join(c if rng.random() < 0.8 else rng.choice(letters + "x") for c in a) if k % 2 else words(rng, rng.randrange(40), letters)
        want = sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        for cells in (0, 10**7):  # row by row, and from one table
            assert Blocks(a, b, cells).total() == want
            least = rng.randrange(40)
            assert Blocks(a, b, cells).total(least) == (want if want > least else 0)
        for least in (brute_lcs(a, b) - 1, brute_lcs(a, b), brute_lcs(a, b) + 0.5):
            assert Subsequence(a).at_least(b, least, 3) == (brute_lcs(a, b) >= least)


def test_near_duplicates_against_all_pairs(spark):
    """near_dup_pairs and term_insert_filter as whole operators, with copies, ties, nulls and empty bodies."""
    from bibliospark.operators.resolve import near_dup_pairs, term_insert_filter

    rng = random.Random(13)
    rows, base = [], [words(rng, rng.randrange(40, 120), "abcdefgh ") for _ in range(12)]
    for i in range(150):
        body = "".join(c if rng.random() < 0.93 else rng.choice("abxy") for c in rng.choice(base)) if i % 7 else rng.choice([None, "", base[0]])
        rows.append((i, i % 2, rng.randrange(12), f"name{i % 60}", "lemma", body))
    terms = spark.createDataFrame(rows, "id long, book_id long, page long, name string, kind string, latex string")
    alike = lambda a, b: 100 * difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    full = sorted((r for r in rows if r[5]), key=lambda r: (r[2], r[0]))
    first = {}
    for r in full:
        first.setdefault((r[1], r[2], r[5]), r[0])
    heads = [r for r in full if first[r[1], r[2], r[5]] == r[0]]
    want = {(a[0], b[0]) for k, a in enumerate(heads) for b in heads[k + 1 :]
            if a[1] == b[1] and b[2] - a[2] <= 5 and abs(len(a[5]) - len(b[5])) <= 0.3 * max(len(a[5]), len(b[5])) and alike(a[5], b[5]) > 85}
    got = near_dup_pairs(terms).collect()
    assert {(r.id_a, r.id_b) for r in got if not r.is_copy} == want and len(want) > 20
    assert {(r.id_a, r.id_b) for r in got if r.is_copy} == {(first[r[1], r[2], r[5]], r[0]) for r in full if first[r[1], r[2], r[5]] != r[0]}
    old, new = rows[:75], rows[75:]
    kept = term_insert_filter(terms.filter("id >= 75"), terms.filter("id < 75"))
    named, expected = {(r[1], r[2], r[3]) for r in old}, set()
    for r in new:
        clash = (r[1], r[2], r[3]) in named or any(s[0] < r[0] and (s[1], s[2], s[3]) == (r[1], r[2], r[3]) for s in new)
        close = r[5] and len(r[5]) > 50 and any(s[5] and s[1] == r[1] and abs(s[2] - r[2]) <= 1 and brute_ratio(r[5], s[5]) > 85 for s in old)
        if not clash and not close:
            expected.add(r[0])
    assert {r.id for r in kept.collect()} == expected and len(expected) < len(new)


def test_all_windows_come_from_one_table():
    import random
    import time

    from bibliospark.functions import similarity as sim

    pick = random.Random(1)
    for _ in range(500):
        m, letters = pick.randint(1, 12), "abcdef"[: pick.choice((2, 3, 6))]
        a = "".join(pick.choice(letters) for _ in range(m))
        b = "".join(pick.choice(letters) for _ in range(pick.randint(m, 25)))
        windows = [(max(e - m, 0), min(e, len(b))) for e in range(1, len(b) + m)]
        want = [(lo, hi, sim.lcs_length(a, b[lo:hi])) for lo, hi in windows]
        assert list(zip(*[x.tolist() for x in sim.window_lengths(a, b)])) == want
        assert sim.best_alignment(a, b, 0.0, tries=pick.choice((0, 2, 16))) == max(200.0 * n / (m + hi - lo) for lo, hi, n in want)
    title = "".join(pick.choice("abcdefghij klmnopqrstß") for _ in range(9000))
    start = time.time()
    assert 90 < sim.partial(title, "on " + title.replace("ß", "ss")) < 100
    other = "".join(pick.choice("abcdefghij klmnopqrst") for _ in range(9500))
    assert sim.partial(title, other) < 50
    assert time.time() - start < 20  # minutes where every window was aligned


def test_blocks_of_near_copies_need_no_table():
    """Near copies are settled by pieces; texts that repeat themselves go to the table, with difflib's blocks either way."""
    from bibliospark.operators import blockpairs

    rng = random.Random(14)
    for text in (words(rng, 1500, "abcdefgh "), "ab" * 400, "Repeated line here.\n" * 30):
        copy = "".join(c if rng.random() < 0.97 else "x" for c in text)
        want = sum(x.size for x in difflib.SequenceMatcher(None, text, copy, autojunk=False).get_matching_blocks())
        assert [Blocks(text, copy, looks=looks).total() for looks in (-1, 0, 16, 10**6)] == [want] * 4
    text = words(rng, 1500, "abcdefgh ")
    blocks = Blocks(text, text.replace("ab", "ba"))
    assert blocks.total() > 1000 and blocks.runs is None  # no table of all letters by all letters
    # Of two texts only the later is compared with the earlier, and only within the given number of places.
    compared, score = [], blockpairs._score
    blockpairs._score = lambda *a: compared.append(a[1:3]) or score(*a)
    try:
        side = {"ids": [np.array([1, 2, 3])], "places": [np.array([1, 1, 9])], "texts": [["one body", "one body!", "one body?"]]}
        frame = pd.DataFrame({f"{x}{k}": v for x in "lr" for k, v in side.items()})
        got = pd.concat(blockpairs._evaluate("sequence", 60.0, None, 5)(iter([frame])))
    finally:
        blockpairs._score = score
    assert {(r.left_id, r.right_id) for r in got.itertuples() if r.left_id != r.right_id} == {(1, 2)}
    assert ("one body!", "one body") not in compared and ("one body", "one body?") not in compared
