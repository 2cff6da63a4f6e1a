"""Language identification by known words, with character n-grams for the others.

Words are maximal runs of letters and their marks, in lower case. A known word scores each language by the logarithm of its
smoothed frequency there. An unseen word backs off: its character n-grams of five letters (with ``<`` and ``>`` at the word's
ends) are looked up, and if none of them is known those of four, three, two and one; the known n-grams of the longest such
order score it by their mean log frequency. A text scores as the sum over its words, and the score of the best language is
its share in the softmax of the mean over words, times the square root of their number.

Learning counts words and n-grams per language in Spark over a sample of about ``docs`` documents per language, chosen by
a hash of id and text. The ``words`` most frequent words and the ``grams`` most frequent n-grams of each order are kept, so
the model that tasks receive has a bounded size. Scoring is one scan without a shuffle and reads every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import plain, restored_id, stored

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ORDERS = (5, 4, 3, 2, 1)
DOCS, WORDS, GRAMS, CELLS = 4_000, 120_000, 60_000, 8_000_000
SMOOTHING = 0.5
FEW_LANGUAGES = 10_000
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    """Character n-grams of a word between its end marks; single characters leave the marks out."""
    shown = word if order == 1 else f"<{word}>"
    return [shown[i : i + order] for i in range(len(shown) - order + 1)]


def sample(documents: DataFrame, docs: int = DOCS) -> DataFrame:
    """(lang, text) of about ``docs`` documents of each language, by a hash threshold per language: no language is sorted."""
    known = documents.select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("_at")).filter("lang is not null")
    sizes = stored(known.groupBy("lang").agg(F.count(F.lit(1)).alias("_size")), "languages")
    few = sizes.count() <= FEW_LANGUAGES  # then texts need no exchange
    return known.join(F.broadcast(sizes) if few else sizes, "lang").filter(F.col("_at") < F.lit(float(docs << 40)) / F.col("_size")).select("lang", "text")


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lang, texts in frame.groupby("lang", sort=False)["text"]:
            counts: Counter[str] = Counter()
            for text in texts:
                counts.update(words_of(text))
            yield pd.DataFrame({"lang": np.full(len(counts), lang, object), "word": np.array([*counts, None], object)[:-1], "n": np.fromiter(counts.values(), np.int64, len(counts))})


def _split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for order in ORDERS:
            totals: Counter[tuple] = Counter()
            for lang, word, n in zip(frame["lang"], frame["word"], frame["n"], strict=True):
                for gram in grams_of(word, order):
                    totals[lang, gram] += n
            langs, grams = zip(*totals, strict=True) if totals else ((), ())
            yield pd.DataFrame({"kind": order, "lang": np.array([*langs, None], object)[:-1], "gram": np.array([*grams, None], object)[:-1], "n": np.fromiter(totals.values(), np.int64, len(totals))})


def _table(counts: list, langs: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
    """(row of each key, log frequencies per language): additive smoothing over the keys kept."""
    rows: dict[str, int] = {}
    at = [(rows.setdefault(key, len(rows)), langs[lang], n) for key, lang, n in counts]
    table = np.full((len(rows), len(langs)), SMOOTHING)
    for row, lang, n in at:
        table[row, lang] += n
    return rows, (np.log(table / table.sum(0)) if len(rows) else table).astype(np.float32)


def fit(documents: DataFrame, docs: int = DOCS, words: int = WORDS, grams: int = GRAMS, cells: int = CELLS) -> dict:
    """The model of documents(doc_id, text, lang): languages, words and n-grams with their log frequencies.

    ``docs``: documents to learn from per language (about: a hash decides). ``words``, ``grams``: (language, word) and
    (language, n-gram of one order) pairs kept, by count; with very many languages ``cells`` / languages, so no table grows
    over ``cells`` numbers. These bound what reaches the driver and the tasks.
    """
    counted = stored(sample(documents, docs).mapInPandas(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    split = stored(counted.mapInPandas(_split, "kind int, lang string, gram string, n long").groupBy("kind", "lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = {r.lang: i for i, r in enumerate(sorted(counted.select("lang").distinct().collect()))}
    bound = max(1000, cells // max(1, len(langs)))
    first = lambda df, key, k: [(r[key], r.lang, r.n) for r in df.orderBy(F.desc("n"), key, "lang").limit(min(k, bound)).collect()]
    tables = {order: _table(first(split.filter(F.col("kind") == order), "gram", grams), langs) for order in ORDERS}
    return {"langs": list(langs), "words": _table(first(counted, "word", words), langs), "grams": tables}


class Scorer:
    """Scores of words per language; unseen words are backed off once and remembered, within a bound."""

    def __init__(self, model: dict, remembered: int = 200_000):
        self.model, self.known, self.most = model, model["words"][0], min(remembered, max(1000, CELLS // max(1, len(model["langs"]))))
        self.base = len(self.known)
        self.scores = np.concatenate([model["words"][1], np.zeros((self.most, len(model["langs"])), np.float32)])
        self.unseen: dict[str, int] = {}

    def backed_off(self, word: str) -> np.ndarray:
        for order in ORDERS:
            rows, table = self.model["grams"][order]
            hits = [rows[g] for g in grams_of(word, order) if g in rows]
            if hits:
                return table[hits].mean(0)
        return np.zeros(len(self.model["langs"]))

    def row(self, word: str) -> int:
        """The row of a word: known words first, then remembered ones."""
        at = self.known.get(word)
        if at is None:
            at = self.unseen.get(word)
            if at is None:
                at = self.unseen[word] = self.base + len(self.unseen)
                self.scores[at] = self.backed_off(word)
        return at

    def sums(self, words: list[str]) -> np.ndarray:
        total, step = np.zeros(len(self.model["langs"])), max(1, self.most // 2)
        for i in range(0, len(words), step):
            part = words[i : i + step]
            if len(self.unseen) + len(part) > self.most:
                self.unseen.clear()
            total += self.scores[np.fromiter(map(self.row, part), np.int64, len(part))].sum(0, dtype=float)
        return total

    def predict(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model["langs"]:
            return UNKNOWN, 0.0
        mean = self.sums(words) / len(words)
        share = np.exp((mean - mean.max()) * np.sqrt(len(words)))
        best = int(mean.argmax())
        return self.model["langs"][best], float(share[best] / share.sum())


def languages(documents: DataFrame, model: dict) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1).

    The text alone decides. Null texts and texts without a letter are ``und`` with score 0, and so is everything when
    nothing was learned. A tie goes to the first language by code point. Repeated rows give repeated results, null ids
    stay null, other columns are ignored.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for frame in frames:
            made = [scorer.predict(t) for t in frame["text"]]
            yield pd.DataFrame({"_id": frame["_id"], "lang_pred": [m[0] for m in made], "score": [m[1] for m in made]})

    return plain(documents).mapInPandas(run, "_id long, lang_pred string, score double").select(restored_id(), "lang_pred", "score")
