"""Words, word hashes and the two-way batch/shard exchange shared by the operators of this package.

Words are maximal runs outside of space and \\t..\\r, unchanged. Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliospark.session import work_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST_ID = 2**63 - 1


class _Hashes(dict):
    """word -> 64-bit hash; emptied when it holds half a million words, so a worker's memory stays bounded."""

    def __missing__(self, word):
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _Hashes()


def ascii_lower(text: str) -> str:
    """A-Z to a-z, everything else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes have ASCII case only


def hash_words(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """One scrambled 64-bit hash per ``n`` consecutive words; empty for shorter input."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(size, np.uint64)
    for i in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + size]
    return mix(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    ordered = np.sort(values)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null ids give null."""
    return F.crc32(F.col(column).cast("string")) % 5


def slices(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``chars`` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def plain(documents: DataFrame, *more: Column) -> DataFrame:
    """(_id, text): a null id becomes the largest long (see ``restored_id``), a null text the empty one."""
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def batched(documents: DataFrame, chars: int) -> tuple[DataFrame, int]:
    """(_id, text, _batch) and the number of bytes of all texts: documents dealt at random into batches of about ``chars`` bytes.

    The batch follows from the row alone, so a recomputed
    task deals the same rows; both sides of a later cogroup can reuse one exchange of the texts.
    """
    docs = plain(documents)
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    count = max(1, math.ceil(total / chars))
    return docs.withColumn("_batch", F.pmod(F.xxhash64("_id", "text"), F.lit(count)).cast("int")), total


def restored_id() -> Column:
    return F.when(F.col("_id") != LAST_ID, F.col("_id")).alias("doc_id")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
