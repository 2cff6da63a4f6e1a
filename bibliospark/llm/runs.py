"""Periodic run detection: seeds of guaranteed overlap, extended along diagonals.

A run is a stretch of consecutive words with smallest period q and at least max(12, 2 q) words that no neighbouring word
extends. The words at i and i + q then agree on at least max(12 - q, q) >= 6 consecutive places i, so any run of lag q in
[k, 2 k) holds two equal k-grams q words apart (k = 6, 12, 24, ...; lags under 12 belong to k = 6).

1. Index. k-grams are numbered by doubling: a 2k-gram is a pair of k-gram numbers. Numbers are exact, nothing is hashed.
   A level without a repeated k-gram ends the document, as longer ones cannot repeat either.
2. Occurrence pairs. An occurrence is a head unless the same k-gram also starts at most k / 2 words earlier; heads and the
   occurrences that follow at such steps form a chain. Only pairs with a head are enumerated, and none inside a chain but
   the first two of it: at the first place of a maximal stretch one of both ends is a head (two non-heads share a small
   period, which would carry the stretch one word further left), and a lag inside a chain is a multiple of its step. Heads
   of one k-gram are over k / 2 words apart, so a level has O(n) pairs, also where one word fills the text.
3. Extension. Pairs are taken by lag and place; a table per lag keeps the furthest place covered, and seeds before it are
   skipped. Others are extended word by word, in slices of doubling size, to the whole stretch. Of stretches with equal
   bounds the smallest lag is the period.

Documents are independent rows: one scan, no shuffle, time O(n log n) and memory O(n) in the words of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from bibliospark.llm.common import WORD, plain, restored_id

LEAST, SEED = 12, 6  # words of the shortest run; the overlap that every run guarantees
RUNS = "array<struct<start:long,length:long,period:long>>"


def numbered(*parts: np.ndarray) -> np.ndarray:
    """Equal tuples get equal numbers, counted from 0 (the parts are numbers below 2**31)."""
    key = parts[0].astype(np.int64)
    for part in parts[1:]:
        key = np.unique((key << 31) | part, return_inverse=True)[1]
    return key


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n, at, size = min(len(a), len(b)), 0, 16
    while at < n:
        other = a[at : min(at + size, n)] != b[at : min(at + size, n)]
        if other.any():
            return at + int(other.argmax())
        at, size = at + size, size * 2
    return n


def within(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, index into the sorted key) for all entries with low <= key < high of each range."""
    first, last = np.searchsorted(key, low), np.searchsorted(key, high)
    count = last - first
    owner = np.repeat(np.arange(len(low)), count)
    return owner, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[owner]


def seeds(names: np.ndarray, k: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place), ordered, of the occurrence pairs of equal k-grams with a lag in [low, 2 k)."""
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    repeated = np.append(same, False) | np.append(False, same)
    place, name = order[repeated], names[order][repeated].astype(np.int64)
    if not len(place):
        return place, place
    key = name * (4 * len(names)) + place + len(names)  # a range of lags never reaches the next k-gram's places
    follows = np.append(False, (name[1:] == name[:-1]) & (place[1:] - place[:-1] <= k // 2))
    chain, heads = np.cumsum(~follows), np.flatnonzero(~follows)
    owner, to = within(key, key[heads] + low, key[heads] + 2 * k)
    back, origin = within(key, key[heads] - 2 * k + 1, key[heads] - low + 1)
    left, right = np.concatenate([heads[owner], origin]), np.concatenate([to, heads[back]])
    apart = chain[left] != chain[right]
    left, right = left[apart], right[apart]
    if low < k:  # the step of a chain is a lag of the first level
        second = np.flatnonzero(follows & ~np.append(False, follows[:-1]))
        left, right = np.append(left, second - 1), np.append(right, second)
    lag, start = place[right] - place[left], place[left]
    order = np.lexsort((start, lag))
    return lag[order], start[order]


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period; words are numbers from 0, below 2**31."""
    n = len(words)
    found: dict[tuple[int, int], int] = {}
    if n < LEAST:
        return []
    three = numbered(words[: n - 2], words[1 : n - 1], words[2:])
    names, k, backwards = numbered(three[: n - 5], three[3:]), SEED, words[::-1]
    while len(names) > k and names.max() + 1 < len(names):
        lags, places = seeds(names, k, k if k > SEED else 1)
        by, at = lags * n + places, 0
        while at < len(by):
            q, i = int(lags[at]), int(places[at])
            end = i + k + agreeing(words[i + k : n - q], words[i + k + q :])
            start = i - agreeing(backwards[n - i :], backwards[n - i - q :])
            if end - start >= max(LEAST - q, q):
                found.setdefault((start, end + q), q)  # lags ascend
            at = int(np.searchsorted(by, q * n + end))  # seeds of this lag before the furthest covered place are done
        names, k = numbered(names[:-k], names[k:]), 2 * k
    return sorted((start, end - start, q) for (start, end), q in found.items())


def collapsed(text: str) -> tuple[list[tuple[int, int, int]], str]:
    """(runs, words joined by one space without those that a run contains after its first period)."""
    words = WORD.findall(text)
    number: dict[str, int] = {}
    found = runs_of(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    if not found:
        return found, " ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return found, " ".join(compress(words, np.cumsum(edges)[:-1] == 0))


def periodic_runs(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, runs (array of start, length, period in words, by start, then period), collapsed
    (the words joined by one space, each run cut to its first period).

    Null, empty and short texts have no run and keep their words. Rows are judged one by one, so repeated rows give
    repeated results and a null id stays null; other columns are ignored. Every run is returned, of any length.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [collapsed(t) for t in frame["text"]]
            yield pd.DataFrame({"_id": frame["_id"], "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in m[0]] for m in made], "collapsed": [m[1] for m in made]})

    return plain(documents).mapInPandas(run, f"_id long, runs {RUNS}, collapsed string").select(restored_id(), "runs", "collapsed")
