"""Toxicity by a classifier chain: linear models over words, one per category, each fed the categories before it.

Category k is a logistic model over the distinct words of a whole text and the probabilities of categories 0..k-1. In
training those probabilities are out of fold: a document's earlier categories are predicted by models that have not seen
it, down to the choice of their words, so later models meet inputs of the kind they will meet when scoring. Words become
features by their evidence over the documents a model is fitted on. The last category's out-of-fold probabilities also
set the threshold: the lowest one that at most ``FALSE`` of the documents without the label reach.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import ascii_lower, plain, restored_id

SAMPLE, FEATURES, FOLDS, FALSE = 8_000, 2_000, 5, 0.002
TERM = re.compile(r"[^\W\d_]+|[^\w\s]+")
STEMS = (4, 5)


def terms(text: str) -> set[str]:
    """Distinct runs of letters (A-Z lower-cased) and runs of signs."""
    return set(TERM.findall(ascii_lower(text)))


def stems(term: str) -> list[str]:
    """A term's features: itself and its first letters, which tell inflected and compound forms."""
    return [term, *(term[:n] + "*" for n in STEMS if len(term) > n)]


class Places(dict):
    """term -> numbers of its features, looked up once; emptied at 300,000 terms."""

    def __init__(self, place: dict[str, int]):
        super().__init__()
        self.place = place

    def __missing__(self, term: str):
        if len(self) >= 300_000:
            self.clear()
        found = self[term] = tuple(self.place[s] for s in stems(term) if s in self.place)
        return found

    def rows(self, texts: list[str]) -> list[list[int]]:
        return [sorted({i for found in map(self.__getitem__, terms(t)) for i in found}) for t in texts]


def chosen_terms(bags: list[set[str]], y: np.ndarray, features: int) -> list[str]:
    """For each category its share of the words with the most evidence for it: log-odds times the root of the count."""
    out: dict[str, None] = {}
    for k in range(y.shape[1]):
        with_, without = Counter(), Counter()
        for bag, label in zip(bags, y[:, k], strict=True):
            (with_ if label else without).update(bag)
        n, m = y[:, k].sum() + 1, len(y) - y[:, k].sum() + 1
        score = {w: (np.log((c + 0.5) / n) - np.log((without[w] + 0.5) / m)) * c**0.5 for w, c in with_.items() if c >= 3}
        out.update(dict.fromkeys(sorted(score, key=lambda w: (-score[w], w))[: features // y.shape[1]]))
    return list(out)


class Sparse:
    """Rows of feature numbers, as (row, column) pairs; with dense columns beside them."""

    def __init__(self, rows: list[list[int]], width: int, dense: np.ndarray):
        self.n, self.width, self.dense = len(rows), width, dense
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.fromiter((c for r in rows for c in r), np.int64, len(self.row))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + self.dense @ w[self.width :]

    def transposed(self, d: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, d[self.row], self.width), self.dense.T @ d])

    def part(self, mask: np.ndarray) -> Sparse:
        new, keep = np.cumsum(mask) - 1, mask[self.row]
        out = Sparse([], self.width, self.dense[mask])
        out.n, out.row, out.col = int(mask.sum()), new[self.row[keep]], self.col[keep]
        return out


def logistic(x: Sparse, y: np.ndarray, penalty: float = 0.3, steps: int = 150) -> np.ndarray:
    """Ridge-penalised logistic weights by Adam steps of a falling rate; one label alone gives its smoothed log-odds."""
    w = np.zeros(x.width + x.dense.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(share / (1 - share))
    if min(y.sum(), len(y) - y.sum()) == 0:
        return w
    free = np.full(len(w), penalty)
    free[-1] = 0
    first, second = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        g = x.transposed(1 / (1 + np.exp(-np.clip(x.times(w), -35, 35))) - y) + free * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - 0.15 * (1 - i / (steps + 1)) * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-9)
    return w


def probability(w: np.ndarray, x: Sparse) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.times(w), -35, 35)))


def train_chain(texts: list[str], y: np.ndarray, features: int = FEATURES, folds: int = FOLDS) -> dict:
    """Terms and one weight vector per category, in the order of the columns of ``y``."""
    bags = [{s for w in terms(t) for s in stems(w)} for t in texts]
    fold = np.arange(len(bags)) % folds

    def placed(names: list[str]) -> tuple[dict[str, int], list[list[int]]]:
        place = {w: i for i, w in enumerate(names)}
        return place, [sorted(place[w] for w in bag & place.keys()) for bag in bags]

    inside = []  # the features of each fold, chosen without its documents
    for f in range(folds):
        seen = np.flatnonzero(fold != f)
        inside.append(placed(chosen_terms([bags[i] for i in seen], y[seen], features) if len(seen) else []))
    place, rows = placed(chosen_terms(bags, y, features) if len(y) else [])
    earlier, weights = np.empty((len(rows), 0)), []
    for k in range(y.shape[1]):
        dense = np.column_stack([earlier, np.ones(len(rows))])
        outside = np.zeros(len(rows))
        for f, (own, found) in enumerate(inside):
            seen, unseen = fold != f, fold == f
            if unseen.any():
                x = Sparse(found, len(own), dense)
                outside[unseen] = probability(logistic(x.part(seen), y[seen, k]), x.part(unseen))
        weights.append(logistic(Sparse(rows, len(place), dense), y[:, k]))
        earlier = np.column_stack([earlier, outside])
    return {"terms": place, "weights": weights, "threshold": threshold(earlier[:, -1], y[:, -1]) if y.shape[1] else 0.5}


def threshold(scores: np.ndarray, labels: np.ndarray, false: float = FALSE) -> float:
    """The lowest probability, 0.5 at most, that no more than a share of ``false`` of the documents of label 0 reach."""
    clean = np.sort(scores[labels == 0])
    if not len(clean) or not (labels == 1).any():
        return 0.5
    allowed = int(false * len(clean))
    return float(min(0.5, np.nextafter(clean[len(clean) - 1 - allowed], 1)))


def chain_scores(model: dict, texts: list[str], places: Places | None = None) -> np.ndarray:
    place = places or Places(model["terms"])
    rows = place.rows(texts)
    earlier = np.empty((len(rows), 0))
    for w in model["weights"]:
        earlier = np.column_stack([earlier, probability(w, Sparse(rows, len(model["terms"]), np.column_stack([earlier, np.ones(len(rows))])))])
    return earlier


def fit(documents: DataFrame, labels: DataFrame, categories: list[str], sampled: int = SAMPLE) -> dict:
    """The chain of at most ``sampled`` labelled documents, chosen by a hash of the id. A null label counts as 0; several
    labels of a document count as the largest; of documents that share an id the first by text counts."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(
        *[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"y{i}") for i, c in enumerate(categories)])
    chosen = known.orderBy(F.xxhash64("_labelled"), "_labelled").limit(sampled)
    y = [f"y{i}" for i in range(len(categories))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[" ".join(sorted(terms(t))) for t in frame["text"]])

    texts = plain(documents).join(F.broadcast(chosen), F.col("_id") == F.col("_labelled")).select("_id", "text", *y)
    rows = texts.mapInPandas(run, texts.schema).groupBy("_id").agg(F.min(F.struct("text", *y)).alias("r")).select("_id", "r.*").orderBy(F.xxhash64("_id"), "_id").limit(sampled).toLocalIterator()
    found = [(r.text, [r[c] for c in y]) for r in rows]
    return train_chain([t for t, _ in found], np.array([v for _, v in found], float).reshape(-1, len(categories)))


def toxicity(documents: DataFrame, labels: DataFrame, categories: list[str], threshold: float | None = None, sampled: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, one probability per category (named like it), predicted (last category >= threshold,
    by default the one set by out-of-fold probabilities).

    labels(doc_id, the categories as 0/1, in chain order). Null texts count as empty; a category with one label only
    gives its share; without labels every probability is 0.5. Repeated rows give repeated results; other columns are
    ignored.
    """
    model = fit(documents, labels, categories, sampled)
    names = [f"p{i}" for i in range(len(categories))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places(model["terms"])
        for frame in frames:
            yield pd.DataFrame({"_id": frame["_id"], **dict(zip(names, chain_scores(model, list(frame["text"]), places).T, strict=True))})

    scored = plain(documents).mapInPandas(run, "_id long, " + ", ".join(f"{n} double" for n in names))
    return scored.select(restored_id(), *[F.col(n).alias(c) for n, c in zip(names, categories, strict=True)], (F.col(names[-1]) >= (model["threshold"] if threshold is None else threshold)).cast("int").alias("predicted"))
