import hashlib
import random
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliospark.llm.conversations import Solved, digests, repaired

SCHEMA = "conv_id long, turn long, role string, text string"


def in_order(rows):
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    tie = lambda r, x: hashlib.sha256((hashlib.sha256(r.encode()).hexdigest() + x).encode()).digest()
    return sorted(plain, key=lambda p: (p[1] is not None, p[1] or 0, tie(p[2], p[3])))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        out.append(1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines): all edit sequences by plain recursion on (place, state), least cost, then least audit."""
    kinds = faults(rows)
    fits = {0: "su", 1: "u", 2: "a", 3: "u"}
    after = lambda letter: {"s": 1, "u": 2, "a": 3}[letter]

    @lru_cache(None)
    def least(place, state, inserts):
        ways = [(0, "", ())] if place == len(rows) and state in (0, 3) else []
        new = "a" if state == 2 else "u"
        full = {"a": "assistant", "u": "user"}[new]
        if inserts < 3:
            c, a, x = least(place, after(new), inserts + 1)
            ways.append((c + 2, "I" + a, (full + ":", *x)))
        if place < len(rows):
            role, text = rows[place][2:]
            c, a, x = least(place + 1, state, 0)
            ways.append((c + 3, "D" + a, x))
            late = int(kinds[place] == 3)
            if kinds[place] in (0, 3):
                if role[:1] and role[:1] in fits[state]:
                    c, a, x = least(place + 1, after(role[0]), 0)
                    ways.append((c + late, "K" + a, (f"{role}:{text}", *x)))
                c, a, x = least(place + 1, after(new), 0)
                ways.append((c + 2 + late, "R" + a, (f"{full}:{text}", *x)))
        return min(ways, default=(10**9, "", ()))

    for place in range(len(rows), -1, -1):
        for state in range(4):
            least(place, state, 0)
    return least(0, 0, 0)


def expected(rows):
    rows = in_order(rows)
    kinds, turns = faults(rows), {t for _, t, _, _ in rows if t is not None}
    cost, audit, lines = cheapest(tuple(rows))
    wrong = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in (1, 2, 3)), wrong, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(rng, conv, n, texts, turns):
    return [(conv, rng.choice((None, *range(turns))) if rng.random() < 0.3 else i, rng.choice(("user", "assistant", "system", "user", "assistant", "tool", "", None, "u2")), rng.choice(texts)) for i in range(n)]


def compared(spark, rows, columns=()):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in columns:
        df = df.withColumn(name, F.lit("x"))
    summary, lines = repaired(df)
    found = {r.conv_id: r.sha256 for r in digests(lines).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, found.get(r.conv_id, empty)) for r in summary.collect()}
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    want = {conv: expected(own) for conv, own in by.items()}
    assert got == want, [(c, want[c], got.get(c)) for c in want if want[c] != got.get(c)][:3]
    return df


def test_many_small_conversations(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "Fine.", "Good!", "Cut off", "So? ", "Long, very\nlong", "Ünïcode …", "x.", "y.", "z."]
    rows = [r for conv in (None, -5, 2**60 + 1, *range(150)) for r in made(rng, conv, rng.randrange(1, 11), texts, 6)]
    compared(spark, rows, ("piece", "rows", "digest", "n", "cost", "audit", "_p", "fault"))


def test_one_conversation_over_all_partitions(spark):
    rng = random.Random(4)
    texts = [f"Text {i}{rng.choice(('.', '', '!'))}" for i in range(300)] + [None]
    rows = made(rng, 7, 500, texts, 40) + [(7, 3, "user", "Same.")] * 400 + made(rng, 8, 5, texts, 3) + made(rng, None, 300, texts, 9)
    compared(spark, rows)
    cut = repaired(spark.createDataFrame(rows, SCHEMA))[1].filter("conv_id = 7").select("piece").distinct().count()
    assert cut > 1


def test_empty(spark):
    summary, lines = repaired(spark.createDataFrame([], SCHEMA))
    assert summary.count() == 0 == digests(lines).count()
    assert summary.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


@pytest.mark.parametrize("seed", range(30))
def test_any_cut_gives_the_same_path(seed):
    """A conversation solved whole, and in two pieces of which the first asks what its exits cost."""
    rng = random.Random(seed)
    rows = [{"role": rng.randrange(4), "fault": rng.choice((0, 0, 0, 1, 2, 3)), "n": rng.choice((1, 1, 1, 3))} for _ in range(rng.randrange(2, 14))]
    ending = np.array([[0, 4, 2, 0]])
    whole = Solved([rows], ending)
    cut = rng.randrange(1, len(rows))
    last = Solved([rows[cut:]], ending)
    first = Solved([rows[:cut]], last.cost)
    assert first.cost[0, 0] == whole.cost[0, 0]
    assert first.audit(0, 0) + last.audit(0, first.path(0, 0)[2]) == whole.audit(0, 0)
