"""Places that the edit filter rules out cannot hold the marker, and pages after a hit are not read."""

import random

import pandas as pd

from bibliospark.functions import passages
from bibliospark.functions.similarity import partial


def edits_at(text, marker):
    column, out = list(range(len(marker) + 1)), []
    for ch in text:
        new = [0]
        for i, m in enumerate(marker, 1):
            new.append(min(column[i] + 1, new[i - 1] + 1, column[i - 1] + (m != ch)))
        column = new
        out.append(column[-1])
    return out


def test_ends_against_a_table():
    rng = random.Random(3)
    for _ in range(500):
        text, marker, most = "".join(rng.choices("abc", k=rng.randrange(40))), "".join(rng.choices("abc", k=rng.randrange(1, 9))), rng.randrange(6)
        assert passages.near_ends(text, marker, most) == [i for i, n in enumerate(edits_at(text, marker), 1) if n <= most]


def test_closed_starts_score_too_little():
    rng = random.Random(4)
    closed = 0
    for _ in range(150):
        text, marker = "".join(rng.choices("abcdefgh ", k=rng.randrange(120))), "".join(rng.choices("abcdefgh ", k=rng.randrange(1, 30)))
        starts = set(passages.open_starts(text, marker, 85.0))
        for start in set(range(max(0, len(text) - len(marker)) + 1)) - starts:
            closed += 1
            assert partial(marker, text[start : start + len(marker) + passages.SLACK]) <= 85.0
    assert closed


def test_pages_after_a_hit_are_not_read(monkeypatch):
    read = []
    monkeypatch.setattr(passages, "locate", lambda text, marker: read.append(text) or text.find("x"))
    frame = pd.DataFrame([(1, 1, "m", "a", -1), (1, 2, "m", "bx", -1), (1, 3, "m", "cx", -1), (2, 1, "m", "dd", 1), (2, 2, "m", "e", -1)], columns=["id", "page", "marker", "content", "at"])
    found = pd.concat(passages.first_found(iter([frame.iloc[:2], frame.iloc[2:]])))
    assert found.values.tolist() == [[1, 2, "x"], [2, 1, "d"]] and read == ["a", "bx"]
