"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

An item is contained in a document when the document holds at least 80 % of the item's distinct shingles of five
normalised words. Items are partitioned by size (number of shingles, powers of two). A partition whose largest item has
n shingles keeps the floor(0.2 n) + 1 smallest hashes of each item as its MinHash sketch: a document holding 80 % of an
item misses at most floor(0.2 n) shingles, so it holds at least one sketch entry, and the search loses nothing however
long the document is. Candidates are verified by counting all their shingles exactly.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import WORD, ascii_lower, hash_words, mix, plain, restored_id, rolling

WIDTH = 5
EDGE = re.compile(r"^\W+|\W+$")
HITS = "_id long, item_id long, n_item long, n_common long, containment double"


def normal_words(text: str) -> list[str]:
    """Lower-case words without punctuation at their ends; words of punctuation alone vanish."""
    words = WORD.findall(ascii_lower(text))
    return [w for w in (w if w.isalnum() else EDGE.sub("", w) for w in words) if w]


def item_shingles(text: str, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """(words per shingle, distinct shingle hashes); an item of fewer words is one shingle of all of them."""
    words = normal_words(text)
    n = min(width, len(words))
    return n, np.unique(rolling(hash_words(words), n)) if n else np.empty(0, np.uint64)


def sketches(items: list[tuple[int, str]], threshold: float, width: int) -> dict:
    """words per shingle -> (sorted shingle hashes, item lists, sketch flags) over all items of a block."""
    tables = {}
    sized = [(key, *item_shingles(text, width)) for key, text in items]
    for n in sorted({n for _, n, s in sized if len(s)}):
        owners, sketched, wanted = defaultdict(list), set(), {}
        for key, m, shingles in sized:
            if m != n or not len(shingles):
                continue
            wanted[key] = len(shingles)
            largest = 2 ** int(len(shingles)).bit_length() - 1
            keep = min(len(shingles), int((1 - threshold) * largest + 1e-9) + 1)
            sketched.update((key, h) for h in shingles[np.argsort(mix(shingles), kind="stable")][:keep].tolist())
            for h in shingles.tolist():
                owners[h].append(key)
        hashes = np.array(sorted(owners), np.uint64)
        tables[n] = hashes, [owners[h] for h in hashes.tolist()], [[(k, h) in sketched for k in owners[h]] for h in hashes.tolist()], wanted
    return tables


def _matcher(tables: dict, threshold: float):
    """text -> [(item key, item shingles, common shingles)] over one block of items."""
    masks = {n: np.zeros(1 << 20, bool) for n in tables}
    for n, (hashes, *_) in tables.items():
        masks[n][(hashes >> np.uint64(44)).astype(np.int64)] = True

    def one(text: str | None) -> list[tuple[int, int, int]]:
        found = []
        words = hash_words(normal_words(text or ""))
        for n, (hashes, owners, sketched, wanted) in tables.items():
            shingles = rolling(words, n)
            shingles = np.unique(shingles[masks[n][(shingles >> np.uint64(44)).astype(np.int64)]])
            at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
            common, candidates = defaultdict(int), set()
            for i in at[hashes[at] == shingles]:
                for key, in_sketch in zip(owners[i], sketched[i], strict=True):
                    common[key] += 1
                    if in_sketch:
                        candidates.add(key)
            found += [(key, wanted[key], common[key]) for key in sorted(candidates) if common[key] >= threshold * wanted[key] - 1e-9]
        return found

    return one


def _blocks(items: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """Items with an id and a text in blocks of at most ``block`` rows, by id and text."""
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and length(text) > 0").distinct()
    rest = wanted
    while rows := [tuple(r) for r in rest.orderBy("item_id", "text").limit(block).collect()]:
        yield rows
        if len(rows) < block:
            return
        key, text = rows[-1]
        rest = wanted.filter((F.col("item_id") > key) | ((F.col("item_id") == key) & (F.col("text") > text)))


def contained_items(documents: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = WIDTH, block: int = 20_000) -> DataFrame:
    """One row per (document, item) with containment >= threshold: doc_id, item_id, n_item, n_common, containment.

    documents(doc_id, text), items(item_id, text); other columns are ignored. Items are the stated query set, taken in
    blocks of ``block`` rows ordered by id, so what a task holds has a fixed bound; every block meets all documents.
    Null or empty texts on either side, texts without a word, and items with a null id match nothing. An item id with
    several texts is searched once per text; repeated document rows give repeated result rows.
    """
    docs = plain(documents).filter("text != ''")
    result = documents.sparkSession.createDataFrame([], HITS)
    for rows in _blocks(items, block):
        ids = [key for key, _ in rows]
        match = _matcher(sketches([(i, text) for i, (_, text) in enumerate(rows)], threshold, width), threshold)

        def search(frames: Iterator[pd.DataFrame], ids=ids, match=match) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = [(doc, ids[i], n, c, c / n) for doc, text in zip(frame["_id"], frame["text"], strict=True) for i, n, c in match(text)]
                yield pd.DataFrame(out, columns=["_id", "item_id", "n_item", "n_common", "containment"])

        result = result.unionByName(docs.mapInPandas(search, HITS))
    return result.select(restored_id(), "item_id", "n_item", "n_common", "containment")


def _clean(match):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not match(text) for text in texts], dtype=bool)

    return clean


def decontaminated(documents: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = WIDTH, block: int = 20_000) -> DataFrame:
    """The documents that contain no item, all columns unchanged; judged by the text alone, without a shuffle."""
    for rows in _blocks(items, block):
        match = _matcher(sketches(list(enumerate(text for _, text in rows)), threshold, width), threshold)
        documents = documents.filter(_clean(match)(F.col("text")))
    return documents
