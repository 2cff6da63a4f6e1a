import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bibliospark.llm.common import WORD
from bibliospark.llm.language import lgamma, text_scores


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


class Tree:
    """Context-tree weighting written down node by node."""

    def __init__(self, texts, depth=4):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        for data in texts:
            padded = b"\0" * depth + data + b"\0"
            for i in range(depth, len(padded)):
                for d in range(depth + 1):
                    for j in range(8):
                        self.counts[padded[i - d : i], j, padded[i] >> (8 - j)][padded[i] >> (7 - j) & 1] += 1
        self.children = defaultdict(list)
        for context, j, prefix in list(self.counts):
            if context:
                self.children[context[1:], j, prefix].append((context, j, prefix))
        self.memo = {}

    def evidence(self, node):
        if node not in self.memo:
            a, b = self.counts[node]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            total = own if len(node[0]) == self.depth else np.logaddexp(own + math.log(0.5), math.log(0.5) + sum(map(self.evidence, self.children[node])))
            self.memo[node] = (total, 1.0 if len(node[0]) == self.depth else math.exp(own + math.log(0.5) - total))
        return self.memo[node][0]

    def log10(self, data):
        padded, total = b"\0" * self.depth + data + b"\0", 0.0
        for i in range(self.depth, len(padded)):
            for j in range(8):
                def one(d, parent, i=i, j=j):
                    node = padded[i - d : i], j, padded[i] >> (8 - j)
                    if d > self.depth or node not in self.counts:
                        return parent
                    a, b = self.counts[node]
                    self.evidence(node)
                    own, share = (b + 0.5) / (a + b + 1), self.memo[node][1]
                    return share * own + (1 - share) * one(d + 1, own)
                p = one(0, 0.5)
                total += math.log10(p if padded[i] >> (7 - j) & 1 else 1 - p)
        return total


@pytest.mark.parametrize("chars,shard", [(8_000_000, 16_000_000), (3_000, 2_000)])
def test_against_a_written_out_tree(spark, chars, shard):
    rng = random.Random(1)
    syllables = ["the", "on", "er", "é", "ing", "AB", "x1"]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "the on"), (77, None), (78, ""), (79, "\0a\0 ❤"), (None, None)]
    got = text_scores(spark.createDataFrame(rows, "doc_id long, text string"), batch_chars=chars, shard_bytes=shard).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [lower(t) for i, t in rows if not held(i)]
    counts = Counter(w for t in train for w in [*WORD.findall(t), None])
    n, v = sum(counts.values()), len(counts)
    tree = Tree([t.encode() for t in train])
    want = []
    for i, t in rows:
        tokens = [*WORD.findall(lower(t)), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.append((-1 if i is None else i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, base, tree.log10(lower(t).encode())))
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [f[:5] for f in found] == [w[:5] for w in sorted(want)]
    assert all(abs(a - b) < 1e-4 * max(1, abs(b)) for f, w in zip(found, sorted(want), strict=True) for a, b in zip(f[5:], w[5:], strict=True))


def test_odd_rows(small, nothing):
    got = text_scores(small).collect()
    assert len(got) == small.count() and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert text_scores(nothing).count() == 0


def test_without_training_texts(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = text_scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert abs(row.score - 24 * math.log10(0.5)) < 1e-5 and row.base_score == 0 and row.n_known == 0


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 7, 1000.5, 1e9])
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-9)
