import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from bibliospark.llm.common import LAST_ID, WORD
from bibliospark.llm.jaccard import components, linked_components, one_per_component


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    n = min(3, len(words))
    return frozenset(tuple(words[a : a + n]) for a in range(len(words) - n + 1)) if n else frozenset()


def brute(rows, percent=90):
    sets = [(LAST_ID if i is None else i, shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        common = len(sets[a][1] & sets[b][1])
        if common and 100 * common >= percent * len(sets[a][1] | sets[b][1]):
            parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k in range(len(sets)):
        groups[root(k)].append(sets[k][0])
    known = lambda i: None if i == LAST_ID else i
    return Counter((known(i), len(s), known(min(groups[root(k)]))) for k, (i, s) in enumerate(sets))


def near_copies(rows, seed=4):
    """Chains and stars of near copies with Jaccard on both sides of the limit, and a line that many documents share."""
    rng = random.Random(seed)
    base = [t for _, t, *_ in rows if t and 60 < len(t.split()) < 400][:6]
    out, key = [], 10_000
    for text in base:
        words = text.split(" ")
        for _ in range(25):
            if rng.random() < 0.5:
                words = list(words)
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(copy) // 45))):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            words = copy if rng.random() < 0.3 else words
            out.append((key, " ".join(copy), None))
            key += 1
    line = "this line stands in very many of the documents here"
    for _ in range(60):
        out.append((key, line + " " + " ".join(f"{rng.choice('abcdef')}{rng.randrange(40)}" for _ in range(rng.randint(0, 15))), None))
        key += 1
    return out


@pytest.mark.parametrize("frequent,shard", [(50_000, 40_000_000), (5, 50_000)])
def test_against_brute_force(spark, small, small_rows, frequent, shard):
    more = near_copies(small_rows)
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string, source string").select("doc_id", "text"))
    want = brute([*small_rows, *more])
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in linked_components(docs, frequent=frequent, shard_bytes=shard).collect())
    assert got == want
    assert sum(i != c for i, _, c in got) > 50


def test_one_of_each_group(small, small_rows, nothing):
    kept = one_per_component(small)
    assert kept.columns == small.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    found = linked_components(small).collect()
    groups = {(r.component_id) for r in found if r.n_shingles}
    assert sum(1 for (_, t), n in got.items() if shingles(t)) == len(groups) and max(got.values()) == 1
    assert {(i, t) for i, t, _ in small_rows if not shingles(t)} <= set(got)
    assert linked_components(nothing).count() == 0 and one_per_component(nothing).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_sketches_never_part_linked_sets():
    import pandas as pd

    from bibliospark.llm.jaccard import BITS, _can_link_wide, near, sketch, unpacked, wide_sketch

    rng = np.random.default_rng(2)
    parted = 0
    for size in (50, 700, 2 * BITS + 1, 4 * BITS - 50, 9000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            b = np.unique(np.concatenate([a[: len(a) - rng.integers(0, size // 8 + 1)], rng.integers(0, 2**63, rng.integers(0, size // 8 + 1)).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            for percent in (80, 90):
                linked = 100 * common >= percent * (len(a) + len(b) - common)
                if linked:
                    assert near(unpacked([sketch(a)]), unpacked([sketch(b)]), np.array([len(a) + len(b)]), percent)[0]
                frame = pd.DataFrame({"a": [1], "b": [2], "n": [len(a) + len(b)], "wide": [wide_sketch(a)], "_wide": [wide_sketch(b)]})
                kept = sum(len(f) for f in _can_link_wide(iter([frame]), percent))
                assert kept or not linked
        other = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        frame = pd.DataFrame({"a": [1], "b": [2], "n": [2 * size], "wide": [wide_sketch(a)], "_wide": [wide_sketch(other)]})
        parted += size > 2 * BITS and not sum(len(f) for f in _can_link_wide(iter([frame]), 80))
    assert parted == 3
