"""Candidate generation by equi-joins on rare keys, exact for the predicates it serves."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliospark.functions import text as tx
from bibliospark.session import cut_lineage

FEW, FEW_LETTERS, ROWS = 2_000, 1_000_000, 100_000
GRAM, CELL_BITS, KEPT = 4, 18, 8


def substring_keys(needle: str | Column) -> Column:
    """Keys every text containing ``needle`` must hold: its trigrams, or the needle itself when shorter."""
    needle = tx.column(needle)
    return F.when(F.length(needle) >= 3, tx.grams(needle, 3)).when(F.length(needle) > 0, F.array(needle))


def text_keys(text: str | Column) -> Column:
    """All trigrams plus the shorter grams that serve needles of one or two characters."""
    return F.concat(tx.grams(text, 3), tx.grams(text, 2), tx.grams(text, 1))


def inner_words(needle: str | Column) -> Column:
    """Words of a passage except the first and last, which may continue outside of it."""
    words = tx.tokens(needle)
    return F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))


def rare_key_pairs(needles: DataFrame, texts: DataFrame, needle_keys: Column, keys_of_text: Column) -> DataFrame:
    """Pairs (needle_id, text_id) whose text holds the rarest key of the needle.

    A text that satisfies the predicate holds every key of the needle, so looking only under the rarest one loses
    nothing and keeps common keys out of the join. needles(needle_id, needle), texts(text_id, text).
    """
    wanted = needles.select("needle_id", F.size(needle_keys).alias("_size"), F.explode(needle_keys).alias("_key"))
    # Read for the counts and for the join; texts are expanded once.
    held = cut_lineage(texts.select("text_id", F.explode(keys_of_text).alias("_key")).join(wanted.select("_key").distinct(), "_key", "left_semi"))
    counts = held.groupBy("_key").agg(F.count(F.lit(1)).alias("_count"))
    rarest = (
        wanted.join(counts, "_key").groupBy("needle_id", "_size")
        .agg(F.min_by("_key", F.struct("_count", "_key")).alias("_key"), F.count(F.lit(1)).alias("_found"))
        .filter(F.col("_found") == F.col("_size")).select("needle_id", "_key")
    )
    return held.join(rarest, "_key").select("needle_id", "text_id")


WORD = r"[\p{L}\p{N}]+"


def whole_words(text: str | Column) -> Column:
    """Runs of letters and digits as they are written."""
    return F.regexp_extract_all(tx.column(text), F.lit(WORD), F.lit(0))


def vocabulary_pairs(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (needle_id, text_id) whose text holds a word that contains a piece of the needle, for its rarest piece.

    The pieces of a needle are its runs of letters and digits. Where a text holds the needle, each piece lies inside one
    word of the text. So grams are taken of the distinct words only, a needle's pieces are matched with words, and the
    piece whose words stand in the fewest texts leads to the texts. Needles without a letter or digit have no pairs here.
    """
    held = texts.select("text_id", F.explode(F.array_distinct(whole_words("text"))).alias("_word"))
    vocabulary = cut_lineage(held.groupBy("_word").agg(F.count(F.lit(1)).alias("_held")))
    asked = needles.select("needle_id", F.explode(F.array_distinct(whole_words("needle"))).alias("_piece"))
    pieces, words = asked.select("_piece").distinct().select(F.col("_piece").alias("needle_id"), F.col("_piece").alias("needle")), vocabulary.select(F.col("_word").alias("text_id"), F.col("_word").alias("text"))
    close = rare_key_pairs(pieces, words, substring_keys("needle"), text_keys("text"))
    inside = cut_lineage(close.filter(F.contains("text_id", F.col("needle_id"))).select(F.col("needle_id").alias("_piece"), F.col("text_id").alias("_word")))
    cost = inside.join(vocabulary, "_word").groupBy("_piece").agg(F.sum("_held").alias("_cost"))
    rarest = asked.join(cost, "_piece", "left").groupBy("needle_id").agg(F.min_by("_piece", F.struct(F.coalesce("_cost", F.lit(0)), "_piece")).alias("_piece"))
    wanted = rarest.join(inside, "_piece").select("needle_id", "_word")
    return held.join(wanted, "_word").select("needle_id", "text_id").distinct()


def positions(pairs: DataFrame, needles: DataFrame, texts: DataFrame, block: int = 1_000) -> DataFrame:
    """(needle_id, text_id, position from 1) of the candidate pairs whose text holds the needle.

    The needles of a text travel to it in blocks of about ``block`` and are looked up in place, so a text moves once per
    block and not once per pair.
    """
    blocks = pairs.groupBy("text_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    placed = pairs.join(needles, "needle_id").join(blocks, "text_id").withColumn("_block", F.pmod(F.xxhash64("needle_id"), "_blocks"))
    packed = placed.groupBy("text_id", "_block").agg(F.collect_list(F.struct("needle_id", "needle")).alias("_needles"))
    looked = packed.join(texts, "text_id").select("text_id", F.explode(F.filter(F.transform("_needles", lambda n: F.struct(
        n.needle_id.alias("needle_id"), F.instr(F.col("text"), n.needle).alias("position"))), lambda h: h.position > 0)).alias("_h"))
    return looked.select("_h.needle_id", "text_id", "_h.position")


def gram_cells(text: str) -> np.ndarray:
    """A cell number for every ``GRAM`` letters of a text; none for shorter ones."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = max(0, len(codes) - GRAM + 1)
    cells = np.zeros(size, np.uint32)
    for i in range(GRAM):
        cells = cells * np.uint32(0x9E3779B1) + codes[i : i + size]
    return (cells * np.uint32(0x85EBCA6B)) >> np.uint32(32 - CELL_BITS)


def _found(batches: Iterator[pa.RecordBatch], ids: pa.Array, needles: list[str]) -> Iterator[pa.RecordBatch]:
    """(needle_id, text_id, position) of the needles that each text holds.

    Up to ``KEPT`` grams of a needle must have their cells marked by the text before the needle is looked up in it.
    """
    marked = np.zeros((1 << CELL_BITS) + 1, bool)  # the last cell stands for needles with fewer grams
    wanted = np.full((len(needles), KEPT), 1 << CELL_BITS, np.int64)
    for row, needle in zip(wanted, needles, strict=True):
        cells = gram_cells(needle)
        row[: min(KEPT, len(cells))] = cells[np.linspace(0, len(cells) - 1, min(KEPT, len(cells))).astype(np.int64)]

    def rows(batch: pa.RecordBatch, found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        needle, text, at = (pa.array(x, pa.int32()) for x in (zip(*found, strict=True) if found else ((), (), ())))
        return pa.RecordBatch.from_arrays([ids.take(needle), batch.column("text_id").take(text), at], names=["needle_id", "text_id", "position"])

    for batch in batches:
        found = []
        for row, text in enumerate(batch.column("text").to_pylist()):
            if text and needles:
                marked[:] = False
                marked[gram_cells(text)] = marked[-1] = True
                possible = np.flatnonzero(marked[wanted].all(axis=1)).tolist()
                found += [(k, row, at + 1) for k in possible if (at := text.find(needles[k])) >= 0]
            if len(found) > ROWS:
                yield rows(batch, found)
                found = []
        yield rows(batch, found)


def positions_of_few(needles: DataFrame, texts: DataFrame) -> DataFrame | None:
    """``containment_join`` for at most ``FEW`` needles, which all texts meet where they are read; None if there are more."""
    needles = needles.filter("needle <> ''").select("needle_id", "needle")
    count, letters = needles.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()
    if count > FEW or letters > FEW_LETTERS:
        return None
    asked = needles.toArrow().combine_chunks()
    schema = needles.select("needle_id").schema.add(texts.schema["text_id"]).add("position", T.IntegerType())
    ids = pa.concat_arrays(asked.column("needle_id").chunks) if count else pa.array([], asked.schema.field("needle_id").type)
    return texts.select("text_id", "text").mapInArrow(partial(_found, ids=ids, needles=asked.column("needle").to_pylist()), schema)


def containment_join(needles: DataFrame, texts: DataFrame, passages: bool = False) -> DataFrame:
    """Exact "text contains needle" join: (needle_id, text_id, position from 1) with needles(needle_id, needle), texts(text_id, text).

    ``passages`` is for long texts: a bounded number of needles is looked up in one scan of the texts. Of more needles, those with an inner word (three words or more) are blocked on those, shorter ones on
    the words that hold their pieces, and those without a letter or digit on trigrams of the texts.
    """
    if passages:
        if (hits := positions_of_few(needles, texts)) is not None:
            return hits
        inner, worded = F.size(inner_words("needle")) > 0, F.size(whole_words("needle")) > 0
        pairs = rare_key_pairs(needles.filter(inner), texts, inner_words("needle"), F.array_distinct(tx.tokens("text"))).unionByName(
            vocabulary_pairs(needles.filter(~inner & worded), texts))
        signs = needles.filter(~inner & ~worded & (F.col("needle") != ""))
        if not signs.isEmpty():
            pairs = pairs.unionByName(rare_key_pairs(signs, texts, substring_keys("needle"), text_keys("text")))
    else:
        pairs = rare_key_pairs(needles, texts, substring_keys("needle"), text_keys("text"))
    return positions(pairs, needles, texts)
