"""Approximate location of a marker inside one page (small per-row helpers behind Arrow functions).

Text and marker are reduced to one comparable form: letters and digits, lower case, command names out. The form keeps
the source offset of each of its characters, so a hit in it is a position in the page. What is not found that way is
aligned: the places that words of the marker propose are scored first, then every other place that can still be better.
Places where no part of the text is within the allowed number of edits are ruled out before, in one pass (``near_ends``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from math import ceil

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliospark.functions.similarity import Subsequence, partial

COMMAND = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?")
WORD = re.compile(r"[^\W_]+")
SLACK = 40


class Form:
    """The comparable form of a text: ``text`` and, for each of its characters, the offset in the source."""

    def __init__(self, source: str):
        skipped = [False] * len(source)
        for m in COMMAND.finditer(source):
            skipped[m.start() : m.end()] = [True] * (m.end() - m.start())
        chars = [(c, i) for i, ch in enumerate(source) if not skipped[i] and ch.isalnum() for c in ch.lower() if c.isalnum()]
        self.text = "".join(c for c, _ in chars)
        self.offsets = [i for _, i in chars]


def words_of(text: str) -> list[tuple[str, int]]:
    return [(m.group(), m.start()) for m in WORD.finditer(text)]


def proposed_starts(text: str, marker: str) -> list[int]:
    """Places where the marker would begin if one of its words stood at the same word of the text."""
    places: dict[str, list[int]] = {}
    for word, at in words_of(marker):
        if len(word) >= 3:
            places.setdefault(word, []).append(at)
    starts = {max(0, at - inside) for word, at in words_of(text) for inside in places.get(word, ())}
    last = max(0, len(text) - len(marker))
    return sorted({min(s, last) for s in starts})


def near_ends(text: str, marker: str, most: int) -> list[int]:
    """Ends of the parts of ``text`` that at most ``most`` edits turn into the marker: one pass over bit vectors (Myers)."""
    size = len(marker)
    full, top, masks = (1 << size) - 1, 1 << (size - 1), {}
    for i, ch in enumerate(marker):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    up, down, distance, ends = full, 0, size, []
    for end, ch in enumerate(text, 1):
        same = masks.get(ch, 0)
        across = same | down
        level = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(level | up)), up & level
        if more & top:
            distance += 1
        elif less & top:
            distance -= 1
        more, less = (more << 1) & full, (less << 1) & full
        up, down = less | (full & ~(across | more)), more & across
        if distance <= most:
            ends.append(end)
    return ends


def open_starts(text: str, marker: str, least: float) -> list[int]:
    """Starts of windows that can have a ratio above ``least``: a ratio r of strings of m and n letters means fewer than
    (m + n)(1 - r / 100) insertions and deletions. The last window may be no longer than the marker, where the marker is
    cut instead, and a text shorter than the marker has one window only; these stay."""
    size, last = len(marker), max(0, len(text) - len(marker))
    if not last:
        return [0]
    starts, done = [], 0
    for end in near_ends(text, marker, int(2 * size * (1 - least / 100) + 1e-6)):
        starts.extend(range(max(done, end - size - SLACK), min(end, last - 1) + 1))
        done = max(done, min(end, last - 1) + 1)
    return [*starts, last]


def aligned(text: str, marker: str, least: float, starts: list[int] | None = None) -> int:
    """The first start of the window with the best partial ratio above ``least``, -1 if none.

    Proposed starts come first, so they win ties, and only give the best so far. Every start is looked at after them: a window is scored only if its common
    subsequence with the marker leaves it a chance, and as that grows by at most one a step, starts that cannot have
    reached the wanted length are passed over.
    """
    size, common = len(marker), Subsequence(marker)
    best, found, reached = least, -1, 0
    possible = open_starts(text, marker, least) if starts is None else sorted(starts)
    inside = set(possible)
    for start in proposed_starts(text, marker) if starts is None else ():
        if start not in inside:
            continue
        window = text[start : start + size + SLACK]
        shared = common.length(window)
        score = partial(marker, window, best) if 200.0 * shared > best * (size + shared) else best
        if score > best:
            best, found = score, start
    for start in possible:
        if start < reached:
            continue
        window = text[start : start + size + SLACK]
        missing = best * size / (200.0 - best) - common.length(window) - 1e-6
        if missing > 0:
            reached = start + ceil(missing)
            continue
        score = partial(marker, window, best)
        if score > best:
            best, found = score, start
    return found


def locate(text: str, marker: str, least: float = 85.0) -> int:
    """Position of a marker that is not in the text verbatim; -1 if absent or if the marker holds no letter or digit."""
    page, wanted = Form(text), Form(marker)
    if not wanted.text:
        return -1
    at = page.text.find(wanted.text)
    if at >= 0:
        return page.offsets[at]
    lower = text.lower()
    at = aligned(lower, marker.lower(), least)
    if at < 0 or len(lower) == len(text):
        return at
    return [i for i, n in enumerate(accumulate(len(ch.lower()) for ch in text)) if n > at][0]


@F.pandas_udf(T.IntegerType())
def marker_position(text: pd.Series, marker: pd.Series) -> pd.Series:
    return pd.Series([-1 if t is None or m is None else locate(t, m) for t, m in zip(text, marker)], dtype="int32")


def first_found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, page, body) of the first page of every id that holds its marker; rows (id, page, marker, content, at) come in
    order of id and page, and pages after a hit are not looked at. ``at`` is the offset of a verbatim marker, else -1."""
    done = None
    for frame in frames:
        out = []
        for key, page, marker, content, at in zip(frame["id"], frame["page"], frame["marker"], frame["content"], frame["at"]):
            if key == done or content is None or marker is None:
                continue
            at = at if at >= 0 else locate(content, marker)
            if at >= 0:
                done = key
                out.append((key, page, content[int(at):]))
        yield pd.DataFrame(out, columns=["id", "page", "body"])
