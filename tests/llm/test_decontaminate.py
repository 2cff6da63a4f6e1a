import random
from collections import Counter

from bibliospark.llm.common import WORD
from bibliospark.llm.decontaminate import EDGE, contained_items, decontaminated


def shingles(text, width=None):
    words = [w for w in (EDGE.sub("", w) for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) if w]
    n = width or min(5, len(words))
    return n, {tuple(words[a : a + n]) for a in range(len(words) - n + 1)} if n else set()


def brute(rows, items):
    out = []
    for key, text in {(k, t) for k, t in items if k is not None and t}:
        n, want = shingles(text)
        for doc, body, *_ in rows:
            common = len(want & shingles(body, n)[1]) if want else 0
            if want and common >= 0.8 * len(want) - 1e-9:
                out.append((doc, key, len(want), common))
    return Counter(out)


def fixture(spark, folder, rows):
    rng = random.Random(3)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    texts = [t for _, t, _ in rows if t and len(t) > 400]
    for i in range(30):  # pieces of documents, some words changed: containments on both sides of the limit
        words = rng.choice(texts).split(" ")
        a = rng.randrange(max(1, len(words) - 60))
        words = words[a : a + rng.randrange(1, 60)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "changed"
        items.append((1000 + i, " ".join(words)))
    return [*items, (None, texts[0]), (2000, None), (2001, ""), (2002, "..."), (1000, "one two"), (items[0][0], items[0][1])]


def test_against_brute_force(spark, folder, small, small_rows):
    items = fixture(spark, folder, small_rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute(small_rows, items)
    for block in (20_000, 30):
        got = Counter((r.doc_id, r.item_id, r.n_item, r.n_common) for r in contained_items(small, table, block=block).collect())
        assert got == want
    kept = Counter((r.doc_id, r.text) for r in decontaminated(small, table, block=30).collect())
    hit = {r for r in want}
    dirty = {d for d, *_ in hit}
    assert all((d, t) in kept for d, t, _ in small_rows if d not in dirty) and sum(kept.values()) < len(small_rows)
    assert decontaminated(small, table).columns == small.columns


def test_empty(spark, small, nothing):
    items = spark.createDataFrame([], "item_id long, text string")
    assert contained_items(small, items).count() == 0 and decontaminated(small, items).count() == small.count()
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert contained_items(nothing, some).count() == 0
