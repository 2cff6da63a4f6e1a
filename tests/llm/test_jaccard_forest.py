"""A group of near copies whose buckets are led by strangers is joined by a forest, not by all of its pairs."""

import random

import numpy as np
import pandas as pd

from bibliospark.llm import jaccard


def group(sets):
    c = np.arange(1, len(sets) + 1)
    return pd.DataFrame({"token": 7, "side": 0, "c": c, "n": [len(s) for s in sets], "component": c,
                         "sketch": [jaccard.sketch(s) for s in sets], "wide": [jaccard.wide_sketch(s) for s in sets]})


def test_a_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    copies = [jaccard.distinct(np.append(base[i % 5 :], rng.integers(0, 2**63, 2).astype(np.uint64))) for i in range(60)]
    frame = group(copies)
    every, forest = (jaccard._meet(frame, 90, forest=f) for f in (False, True))
    assert len(every) == 60 * 59 // 2 and len(forest) == 59
    assert set(forest["b"]) == {1} and set(forest["a"]) == set(range(2, 61))


def test_long_sets_are_told_apart_where_they_meet():
    """1024 bits say nothing of two sets of 6,000 tokens; the wide sketches do."""
    rng = np.random.default_rng(5)
    sets = [jaccard.distinct(rng.integers(0, 2**63, 6_000).astype(np.uint64)) for _ in range(12)]
    sets.append(sets[0][:-50])
    met = jaccard._meet(group(sets), 80, forest=False)
    assert met.to_numpy().tolist() == [[13, 1]]


def test_near_copies_among_strangers(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = " ".join(word() for _ in range(12))
    base = [word() for _ in range(80)]
    texts = [line + " " + " ".join(word() for _ in range(40)) for _ in range(60)]  # shorter: they lead the line's buckets
    texts += [line + " " + " ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(40)]
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    near = lambda a, b: 100 * len(a & b) >= 90 * len(a | b)
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near(sets[i], sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if x in (a, b) else x for x in parent]
    asked, stored = [], jaccard.stored

    def counted(df, purpose):
        kept = stored(df, purpose)
        if purpose == "candidates":
            asked.append(kept.count())
        return kept

    monkeypatch.setattr(jaccard, "stored", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.linked_components(docs, frequent=0).collect()}
    assert got == dict(enumerate(parent)) and len(asked) == 3
    assert sum(asked[1:]) < 400
