"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of 128 words. Every passage is encoded from its bytes: shares of byte classes and of
pairs of coarse classes, word lengths, and how much of it repeats inside the passage and in the whole text. A layer of
tanh units turns the code into h_k; gated attention a_k = softmax(w . (tanh(V h_k) * sigmoid(U h_k))) weighs passages;
the score is sigmoid(c . sum_k a_k h_k + b). All of it is learned from document labels alone, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import mix, plain, restored_id

PASSAGE = 128
SAMPLE_DOCS, SAMPLE_PASSAGES = 6_000, 512
HIDDEN, GATE = 24, 12

FINE = np.full(256, 36, np.int64)  # letters by kind, digits, each ASCII sign, white space, other bytes
FINE[[ord(c) for c in "aeiouy"]], FINE[[ord(c) for c in "bcdfghjklmnpqrstvwxz"]] = 0, 1
FINE[ord("A") : ord("Z") + 1], FINE[ord("0") : ord("9") + 1] = 2, 3
FINE[[9, 11, 12, 13, 32]], FINE[10] = 4, 5
for _i, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    FINE[ord(_c)] = 6 + _i if _i < 30 else 35
FINE[128:] = 37
FINES = 38
COARSE = np.array([0, 0, 1, 2, 3, 3] + [4] * 31 + [0])[FINE]  # letters, capitals, digits, white space, signs
CODE = FINES + 25 + 9
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def word_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words in the bytes of a text."""
    edges = np.diff(np.concatenate([[1], SPACE[data].astype(np.int8), [1]]))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    begun = np.zeros(len(data), np.int64)
    begun[starts] = starts
    inside = np.minimum(np.arange(len(data)) - np.maximum.accumulate(begun), len(_POWERS) - 1)
    terms = np.where(SPACE[data], np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _POWERS[inside])
    return starts, ends, mix(np.add.reduceat(terms, starts))


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def encode(text: str) -> np.ndarray:
    """float32 codes, one row per passage; a text without a word is one passage of zeros."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    starts, ends, hashes = word_codes(data)
    n = len(starts)
    if not n:
        return np.zeros((1, CODE), np.float32)
    passages = -(-n // PASSAGE)
    owner = np.arange(n) // PASSAGE
    begin = starts[::PASSAGE].copy()
    begin[0] = 0
    byte_owner = np.repeat(np.arange(passages), np.diff(np.append(begin, len(data))))
    size = np.bincount(byte_owner, minlength=passages).astype(float)[:, None]
    fine = np.bincount(byte_owner * FINES + FINE[data], minlength=passages * FINES).reshape(passages, -1) / size
    coarse = COARSE[data]
    pairs = np.bincount(byte_owner[1:] * 25 + coarse[:-1] * 5 + coarse[1:], minlength=passages * 25).reshape(passages, -1) / size
    count = np.bincount(owner, minlength=passages).astype(float)
    lengths = (ends - starts).astype(float)
    mean = np.bincount(owner, lengths, passages) / count
    share = lambda mask: np.bincount(owner[: len(mask)], mask, passages) / count
    again = np.zeros(n)
    again[1:] = hashes[1:] == hashes[:-1]
    within = repeated(mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    twos = hashes[:-1] * np.uint64(3) + hashes[1:]
    more = np.stack([
        mean / 8, np.sqrt(np.maximum(np.bincount(owner, lengths**2, passages) / count - mean**2, 0)) / 4, share(again), share(within),
        share(repeated(twos)) if n > 1 else np.zeros(passages), share(lengths > 20), share(lengths == 1), np.log1p(count) / 5, np.full(passages, np.log1p(n) / 8)], 1)
    return np.concatenate([np.sqrt(fine), np.sqrt(pairs), more], 1).astype(np.float32)


def forward(w: dict, x: np.ndarray, bag: np.ndarray, bags: int) -> tuple:
    """x: passages of all bags, bag: the bag of each (ascending), every bag non-empty."""
    h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["encode"] + w["shift"])
    v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    energy = (v * u) @ w["w"]
    starts = np.searchsorted(bag, np.arange(bags))
    e = np.exp(energy - np.maximum.reduceat(energy, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    return h, v, u, a, z, z @ w["c"] + w["b"]


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, seed: int = 11, rate: float = 0.01, decay: float = 1e-4) -> dict:
    """Adam on the logistic loss of the bags. Without both labels the score is the share of label 1 (0.5 without any)."""
    y = np.asarray(labels, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    rng = np.random.default_rng(seed)
    w = {"encode": rng.normal(0, CODE**-0.5, (CODE, HIDDEN)), "shift": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
         "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": rng.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "b": np.full(1, np.log(share / (1 - share)))}
    allx = np.concatenate(bags) if bags else np.zeros((1, CODE))
    fixed = {"mean": allx.mean(0), "scale": allx.std(0) + 1e-2}
    if len(set(y)) < 2:
        return w | fixed
    first, second = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    sizes, step = np.array([len(b) for b in bags]), 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for part in np.array_split(order, max(1, len(bags) // 64)):
            x, bag, n = np.concatenate([bags[i] for i in part]), np.repeat(np.arange(len(part)), sizes[part]), len(part)
            h, v, u, a, z, logit = forward(w | fixed, x, bag, n)
            d = (1 / (1 + np.exp(-logit)) - y[part]) / n
            dz = d[:, None] * w["c"]
            da = (dz[bag] * h).sum(1)
            starts = np.searchsorted(bag, np.arange(n))
            de = a * (da - np.add.reduceat(a * da, starts)[bag])
            dv, du = de[:, None] * w["w"] * u * (1 - v * v), de[:, None] * w["w"] * v * u * (1 - u)
            dh = a[:, None] * dz[bag] + dv @ w["V"].T + du @ w["U"].T
            dp = dh * (1 - h * h)
            grads = {"encode": ((x - fixed["mean"]) / fixed["scale"]).T @ dp + decay * w["encode"], "shift": dp.sum(0), "V": h.T @ dv, "U": h.T @ du,
                     "w": (v * u).T @ de, "c": z.T @ d + decay * w["c"], "b": d.sum(keepdims=True)}
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w | fixed


def scores(model: dict, texts: list[str]) -> np.ndarray:
    bags = [encode(t) for t in texts]
    logit = forward(model, np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags))[-1]
    return 1 / (1 + np.exp(-logit))


def sample(documents: DataFrame, labels: DataFrame, column: str = "quality", docs: int = SAMPLE_DOCS) -> DataFrame:
    """(codes, label) of at most ``docs`` labelled documents, chosen by a hash of the id; the same in every run.

    A document with several labels has the larger share; a tie is 1. Null ids and labels are no labels. Of documents
    that share an id each row counts. Bags of more than 512 passages are left out of the sample (never of the scores).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_labelled"), F.col(column).cast("double").alias("_label")).filter("_labelled is not null and _label is not null")
    chosen = known.groupBy("_labelled").agg((F.avg("_label") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("_labelled"), "_labelled").limit(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [encode(t) for t in frame["text"]]
            keep = [i for i, m in enumerate(made) if len(m) <= SAMPLE_PASSAGES]
            yield pd.DataFrame({"codes": [made[i].astype(np.float16).tobytes() for i in keep], "label": frame["label"].iloc[keep], "_order": frame["_order"].iloc[keep]})

    texts = plain(documents, F.xxhash64("doc_id", "text").alias("_order")).join(F.broadcast(chosen), F.col("_id") == F.col("_labelled")).select("text", "label", "_order")
    return texts.mapInPandas(run, "codes binary, label int, _order long").orderBy("_order", "label").limit(docs)


def fit(documents: DataFrame, labels: DataFrame, column: str = "quality", docs: int = SAMPLE_DOCS) -> dict:
    rows = sample(documents, labels, column, docs).collect()
    return train([np.frombuffer(r.codes, np.float16).reshape(-1, CODE).astype(np.float64) for r in rows], np.array([r.label for r in rows]))


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, column: str = "quality", docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (score >= threshold), from the whole text alone.

    labels(doc_id, ``column``) are the labels to learn from; leave held-out ids out of them. Null texts score like empty
    ones; repeated rows give repeated results; other columns are ignored.
    """
    model = fit(documents, labels, column, docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"_id": frame["_id"], "score": np.concatenate([scores(model, list(frame["text"][i : i + 256])) for i in range(0, len(frame), 256)] or [np.empty(0)])})

    scored = plain(documents).mapInPandas(run, "_id long, score double")
    return scored.select(restored_id(), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_by_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, column: str = "quality", docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents whose score reaches the threshold, all columns unchanged, without a shuffle."""
    model = fit(documents, labels, column, docs)

    def score(texts: pd.Series) -> pd.Series:
        whole = [t or "" for t in texts]
        return pd.Series(np.concatenate([scores(model, whole[i : i + 256]) for i in range(0, len(whole), 256)] or [np.empty(0)]))

    return documents.filter(F.pandas_udf(score, "double")(F.col("text")) >= threshold)
