"""Similar pairs inside buckets, evaluated block against block.

Rows of a bucket are packed into blocks of about ``block`` texts; blocks of the same bucket meet in an equi-join and
each meeting emits only the pairs that reach the threshold. A bucket with a third of all rows becomes many blocks over
many tasks, and no task or shuffle ever holds all pairs of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.functions.similarity import Blocks, Subsequence, ratio

LETTERS, ROWS, PIECE = 64, 50_000, 16


def _histogram(texts) -> np.ndarray:
    counts = np.zeros((len(texts), LETTERS), dtype=np.int32)
    for row, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) % LETTERS
        counts[row] = np.bincount(codes, minlength=LETTERS)
    return counts


def _alike(short: str, long: str) -> bool:
    """Whether most of eight pieces of one text stand in the other."""
    starts = range(0, len(short) - PIECE + 1, max(PIECE, len(short) // 8))
    return 2 * sum(short[i : i + PIECE] in long for i in starts) > len(starts)


def _score(scorer: str, a: str, b: str, common: _Prepared, least: float) -> float:
    """The score of two texts, or 0 where it is not above ``least``."""
    total = len(a) + len(b)
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if scorer == "indel" or not _alike(short, long):  # matching blocks of texts full of common pieces are sought at once
        if not common[short].at_least(long, least * total / 200.0):  # matching blocks form a common subsequence
            return 0.0
    return ratio(a, b) if scorer == "indel" else 200.0 * Blocks(a, b).total(least * total / 200.0) / total


class _Prepared(dict):
    """text -> its letter masks, made once in a meeting of blocks."""

    def __missing__(self, text: str) -> Subsequence:
        made = self[text] = Subsequence(text)
        return made


def _evaluate(scorer: str, least: float, length_gap: float | None, apart: int | None):
    def evaluate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for lids, lplaces, ltexts, rids, rplaces, rtexts in zip(*[frame[f"{side}{c}"] for side in "lr" for c in ("ids", "places", "texts")], strict=True):
                left, right = _histogram(ltexts), _histogram(rtexts)
                right_size = right.sum(axis=1)
                common = _Prepared()
                for i, text in enumerate(ltexts):
                    # Shared letters bound every ratio of the two texts.
                    size = left[i].sum()
                    bound = 200.0 * np.minimum(left[i], right).sum(axis=1) / np.maximum(size + right_size, 1)
                    keep = bound > least
                    if length_gap is not None:
                        keep &= np.abs(size - right_size) <= length_gap * np.maximum(size, right_size)
                    if apart is not None:
                        steps = rplaces - lplaces[i]
                        keep &= (steps <= apart) & ((steps > 0) | ((steps == 0) & (rids >= lids[i])))
                    for j in np.nonzero(keep)[0]:
                        score = _score(scorer, text, rtexts[j], common, least)
                        if score > least:
                            rows.append((lids[i], rids[j], score))
                if len(rows) > ROWS:
                    yield pd.DataFrame(rows, columns=["left_id", "right_id", "score"])
                    rows = []
            yield pd.DataFrame(rows, columns=["left_id", "right_id", "score"])

    return evaluate


def _pack(rows: DataFrame, keys: list[str], block: int, prefix: str) -> DataFrame:
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    placed = rows.join(sizes, keys).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    packed = placed.groupBy(*keys, "_part").agg(F.collect_list(F.struct("id", "place", "text")).alias("_rows"))
    return packed.select(*keys, *[F.col(f"_rows.{c}").alias(f"{prefix}{c}s") for c in ("id", "place", "text")])


def matching_pairs(left: DataFrame, right: DataFrame, keys: list[str], scorer: str, least: float, length_gap: float | None = None,
                   block: int = 256, apart: int | None = None) -> DataFrame:
    """(left_id, right_id, score) of pairs in a common bucket scoring above ``least``: left/right(id, text, keys).

    ``scorer`` is "sequence" (order of arguments matters) or "indel". A left row has one bucket, so pairs come once.
    With ``apart``, rows have a whole number ``place`` too, and only right rows that follow the left one by (place, id), at most
    that many places later, are compared; a right row of the same place and id is left to the caller.
    """
    if apart is None:
        left, right = (side.withColumn("place", F.lit(0)) for side in (left, right))
    meet = _pack(left, keys, block, "l").join(_pack(right, keys, block, "r"), keys)
    columns = meet.drop(*keys, "_part")
    spread = columns.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInPandas(_evaluate(scorer, least, length_gap, apart), "left_id bigint, right_id bigint, score double")
