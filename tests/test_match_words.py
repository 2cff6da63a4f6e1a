"""Titles of common syllables: matched by whole words, not by grams that all titles share."""

from itertools import product

from bibliospark.operators import matcher, resolve


def test_common_grams(spark, monkeypatch):
    candidates, pairs = [], resolve.rare_key_pairs

    def counted(*args):
        found = pairs(*args)
        candidates.append(found.count())
        return found

    for module in (matcher, resolve):
        monkeypatch.setattr(module, "rare_key_pairs", counted)
    middles = ["".join(p) for p in product(("than", "anth"), repeat=8)]
    titles = [f"than {m} anth" for m in middles] + ["an an", "th"]
    books = spark.createDataFrame([(i, f"thth{t}an, than", "src1") for i, t in enumerate(titles)], "id long, b_title string, b_author string")
    wanted = spark.createDataFrame([(t, "SRC1") for t in titles[:-2]] + [("an an", "src1"), ("Th", "src"), ("than missing anth", "src1")], "title string, author string")
    got = {(r.title, r.author): r.id for r in matcher.match_normalized(wanted, books).collect()}
    held = [f"thth{t}an  than" for t in titles]
    want = {(t, a): min((i for i, h in enumerate(held) if t.lower() in h), default=None) for t, a in [(t, "SRC1") for t in titles[:-2]] + [("an an", "src1"), ("Th", "src")]}
    assert got == {k: v for k, v in want.items() if v is not None}
    assert sum(candidates) < 4 * len(titles), candidates
