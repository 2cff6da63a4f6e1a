import random
from collections import Counter

import corpus_pipeline
from test_jaccard import near_copies

from bibliospark.llm.common import WORD


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    n = min(5, len(words))
    return frozenset(tuple(words[a : a + n]) for a in range(len(words) - n + 1)) if n else frozenset()


def kept(rows):
    """Ids of the documents without shingles, and the smallest id of each component of five-word Jaccard >= 0.8."""
    sets, group = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            common = len(x & y)
            if common and 100 * common >= 80 * (len(x) + len(y) - common) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    return set(group.values())


def links_by_tokens(rows):
    """Like ``kept``, with intersections counted token by token, for larger tables."""
    sets, group, held, common = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}, {}, Counter()
    for i, tokens in sets.items():
        for token in tokens:
            common.update((i, other) for other in held.get(token, ()))
            held.setdefault(token, []).append(i)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            group[b] = a
    return {root(i) for i in group}


def test_near_duplicates_stage(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for _ in range(12):  # two of 100 words changed: 0.81 on five words, 0.885 on three
        words = fresh(100)
        rows.append(" ".join(words))
        words[30], words[60] = fresh(2)
        rows.append(" ".join(words))
    lines = [(k, " ".join(fresh(200)), None) for k in range(6)]
    rows += [t for _, t, _ in near_copies(lines)] + ["", "one two", "One two", "one two three"]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect())
    assert got == Counter(kept(rows)) and kept(rows) == links_by_tokens(rows)
    assert not any(i in got for i in range(1, 24, 2))
