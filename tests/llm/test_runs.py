import hashlib
import random
import re
import time
import zlib

import numpy as np

from bibliospark.llm.queries import QUERIES, with_periods
from bibliospark.llm.runs import collapsed, periodic_runs, runs_of


def every_lag(words):
    """Runs by comparing the whole text with itself at every lag."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = None
        for i, equal in enumerate(same):
            if equal and start is None:
                start = i
            elif not equal and start is not None:
                if i - start + q >= max(12, 2 * q):
                    found.setdefault((start, i + q), q)
                start = None
    return sorted((s, e - s, q) for (s, e), q in found.items())


def without(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def word_lists():
    rng = random.Random(3)
    for _ in range(400):
        yield [rng.randrange(2) for _ in range(rng.randrange(120))]
        yield [rng.randrange(3) for _ in range(rng.randrange(1, 30))] * rng.randrange(1, 8) + [rng.randrange(3) for _ in range(rng.randrange(10))]
        yield [rng.choice((0, 0, 0, 0, 0, 0, 0, 1)) for _ in range(rng.randrange(200))]
        blocks = [[0] * rng.randrange(1, 9), [0] * rng.randrange(1, 9) + [1], [2]]
        yield [x for b in [rng.choice(blocks) for _ in range(rng.randrange(1, 12))] for x in b] * rng.randrange(1, 5)
        text = [rng.randrange(50) for _ in range(200)]
        for _ in range(4):
            i, p = rng.randrange(150), rng.randrange(1, 40)
            for x in range(i + p, min(200, i + p * rng.randrange(2, 5))):
                text[x] = text[x - p]
        yield text
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
        yield b


def test_against_every_lag():
    for words in word_lists():
        assert runs_of(np.array(words, np.int64)) == every_lag(words), words


def test_known_runs():
    assert collapsed("a " * 12) == ([(0, 12, 1)], "a") and collapsed("a " * 11) == ([], " ".join("a" * 11))
    assert collapsed("x " + "b c " * 6 + "y") == ([(1, 12, 2)], "x b c y")
    assert collapsed("p q r s t u " * 2)[0] == [(0, 12, 6)] and collapsed("p q r s t u " * 2 + "p q r")[0] == [(0, 15, 6)]
    assert collapsed(None or "") == ([], "")


def test_one_word_and_hard_texts_stay_fast():
    began = time.time()
    assert runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert runs_of(np.arange(300_000) % 100_000) == [(0, 300_000, 100_000)]
    assert runs_of(np.arange(300_000) % 2) == [(0, 300_000, 2)]
    assert time.time() - began < 30


def damaged(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_operator_and_damage_on_odd_rows(small, nothing):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect() if len(r.text or "") < 3000]
    short = small.filter("coalesce(length(text), 0) < 3000")
    want = sorted(((i, every_lag(damaged(i, t)), without(damaged(i, t), every_lag(damaged(i, t)))) for i, t in rows), key=str)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(with_periods(short)).collect()), key=str)
    assert got == want and sum(len(r[1]) for r in want) > 20
    assert periodic_runs(small).count() == small.count() and periodic_runs(nothing).count() == 0


def test_query_columns(spark, folder):
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        words = damaged(d.doc_id, d.text)
        if len(words) > 900:
            continue
        runs, r = every_lag(words), got[d.doc_id]
        assert r.n_runs == len(runs) and r.collapsed_sha256 == hashlib.sha256(without(words, runs).encode()).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
