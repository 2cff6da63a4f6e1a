import hashlib
import random
import re
from collections import Counter

import numpy as np

from bibliospark.llm.secret_scan import codes, gradients, labelled_by_patterns, secret_spans, train, windows

KINDS = [("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
         ("access", r"(AKIA[A-Z0-9]+)"), ("hex", r"([0-9a-f]+)")]
LEAST = {"assign": 12, "access": 18, "hex": 16}


def brute(text):
    spans = [(m.start(), i, m.end()) for i, (kind, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if len(m[1]) >= LEAST[kind]]
    return [(KINDS[i][0], a, b) for a, i, b in sorted(spans)]


def secret_rows():
    rng = random.Random(2)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    rows = []
    for i in range(400):
        filler = " ".join(rng.choice(["lorem", "ipsum", "dolor", "été"]) for _ in range(rng.randrange(30)))
        thing = [f'TOKEN = "{hexa(40)}"', f"AKIA{word(16)}", hexa(20), f"10.{rng.randrange(255)}.{rng.randrange(255)}.{rng.randrange(255)}:8080/index", f"2024-0{rng.randrange(1, 9)}-11T10:{rng.randrange(10, 60)}:00.000", f"file_{rng.randrange(99)}_name_long.txt"][i % 6]
        rows.append((i, f"{filler} {thing} {filler}"))
    rows += [(1000 + i, f"the value {hexa(40).upper()} was seen") for i in range(5)]  # no pattern fits these
    rows += [(2000, "token: secret = abcdefghijkl12 Passwd'='abc"), (2001, "api_key:aaaaaaaaaaaaaaaa"), (2002, "apiKEY==abcdefabcdef0123"), (2003, "ſecret=abcdefghijklmn toKen=abcdefghijklmn"), (2004, None), (None, "AKIA" + "B" * 13 + " AKIA" + "B" * 14), (2005, "x" * 70_000 + hexa(16))]
    return rows


def test_base_spans_counts_and_additions(spark, nothing):
    rows = secret_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = secret_spans(docs, labelled_by_patterns(docs.filter("doc_id < 400"))).collect()
    say = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = Counter((i, *[sum(k == kind for k, *_ in brute(t)) for kind in LEAST], hashlib.sha256(say(brute(t)).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        base = [s for s in by_id[i].spans.split(",") if s and not s.startswith("cnn:")]
        assert ",".join(base) == say(brute(t))
    assert sum(r.n_cnn > 0 for r in got if r.doc_id and 1000 <= r.doc_id < 1005) >= 4
    assert sum(r.n_cnn > 0 for r in got if r.doc_id is not None and r.doc_id < 400) <= 12
    assert secret_spans(nothing, labelled_by_patterns(nothing)).count() == 0
    assert all(r.n_cnn == 0 for r in secret_spans(docs, labelled_by_patterns(nothing)).collect())


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    from bibliospark.llm.secret_scan import SHAPE, forward

    w = {k: rng.normal(0, 0.3, s) for k, s in SHAPE.items()}
    x, y = codes(windows("abc 0123456789abcdef0123 def", 4, 24) + windows("10.20.30.40:8080/a", 0, 18)), np.array([1.0, 0.0])
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * forward(w, x)[-1]))))
    g = gradients(w, x, y)
    for k in SHAPE:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in SHAPE[k])
            w[k][at] += 1e-6
            up = loss()
            w[k][at] -= 2e-6
            down = loss()
            w[k][at] += 1e-6
            assert abs((up - down) / 2e-6 - g[k][at]) < 1e-5


def test_windows_cover_long_candidates():
    text = "k=" + "".join(chr(97 + i % 26) for i in range(500)) + "!"
    pieces = windows(text, 2, 502)
    assert {len(p) for p in pieces} == {64} and pieces[-1].startswith(text[502 - 12 - 20 - 20:][:2]) or len(pieces) > 20
    assert train(["x" * 64] * 20, [1] * 20, 0.99) is None


def test_keys_without_digits_are_scored(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(n))
    plain = ["responsibilities", "characterization", "well-understood", "counterexamples.", "representation", "state-of-the-art"]
    filler = lambda: " ".join(rng.choice(plain + ["lorem", "ipsum"]) for _ in range(rng.randrange(2, 9)))
    rows = [(i, f"{filler()} token = {letters(24)} {filler()}" if i % 2 else f"{filler()} file_{i}_name_long.txt {filler()}") for i in range(300)]
    bare = [(1000 + i, f"{filler()} {letters(24)} {filler()}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r.label for r in labelled_by_patterns(docs, findings=200).collect()) == {1: 100, 0: 100}
    labelled = labelled_by_patterns(docs).collect()
    assert any(not re.search("[0-9+/=]", r.piece[12:52]) for r in labelled if not r.label)
    got = {r.doc_id: r for r in secret_spans(spark.createDataFrame(rows + bare, "doc_id long, text string"), spark.createDataFrame(labelled)).collect()}
    assert sum(any(s == f"cnn:{m.start()}:{m.end()}" for m in re.finditer("[A-Za-z]{24}", t) for s in got[i].spans.split(",")) for i, t in bare) >= 5
    assert sum(got[i].n_cnn for i, _ in rows) <= 30
