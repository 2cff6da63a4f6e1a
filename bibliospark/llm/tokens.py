"""Token ids as Parquet list columns: dictionary-coded ids, delta-coded metadata, small pages with indexes.

A written folder holds files in ascending document order, each sorted by id: doc_id, n_tokens (delta coded) and ids
(list<int>, dictionary coded; 16 bits for a vocabulary below 65,536 ids). Row groups and pages are kept small and
carry column indexes, so readers can fetch the metadata of all documents or the tokens of an id range alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibliospark.llm.common import slices

END = 2
PARQUET = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "5000",
}
_encoders: dict[str, Encoder] = {}
LETTERS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([.,;:!?&$%#*|]*)")


class Encoder:
    """Encodes texts with a byte-level BPE tokenizer that drops white space, calling the library once per word not met before.

    Equal words give equal ids, so a table of words met (emptied beyond ``limit`` words) replaces repeated calls. Space
    and line feed part the pieces; other white space stays inside a piece. A piece of Latin letters and closing
    punctuation is two pre-tokens at least, so its lower-cased letters go to the library's model alone; any other piece
    goes through the library whole.
    """

    def __init__(self, path: str, limit: int = 1_200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.limit = Tokenizer.from_file(path), limit
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

        class Bytes(dict):
            def __missing__(self, code):
                value = self[code] = level.pre_tokenize_str(chr(code))[0][0]
                return value

        self.bytes = Bytes()
        self.reset()

    def reset(self):
        """Only the empty piece (no ids) and the end of a text (one id) are known."""
        self.place, self.tails = {"": 0, None: 1}, {"": []}
        self.flat, self.starts, self.sizes = np.zeros(1, np.int32), np.zeros(2, np.int64), np.array([0, 1])

    def _whole(self, piece: str) -> list[int]:
        return self.library.encode(piece, add_special_tokens=False).ids

    def _piece(self, piece: str) -> list[int]:
        m = LETTERS.fullmatch(piece)
        known = m and m[1].lower()  # letters of this range are composed already
        if not m or not known.isalpha():  # the lower case of a letter may hold a mark
            return self._whole(piece)
        ids, tail = [t.id for t in self.library.model.tokenize(known if known.isascii() else known.translate(self.bytes))], m[2]
        if tail not in self.tails:
            self.tails[tail] = self._whole(tail)
        return ids + self.tails[tail]

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with ``end`` after each, number of ids per text)."""
        if len(self.place) > self.limit:
            self.reset()
        self.flat[0] = end
        pieces = [text.replace("\n", " ").split(" ") for text in texts]
        for piece in pieces:
            piece.append(None)
        new = list(set().union(*pieces) - self.place.keys())
        if new:
            ids = list(map(self._piece, new))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            first = len(self.place)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))])
            self.place.update(zip(new, range(first, first + len(new)), strict=True))
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        place = np.fromiter(map(self.place.__getitem__, chain.from_iterable(pieces)), np.int64, int(counts.sum()))
        lengths = self.sizes[place]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(self.starts[place] - total[:-1], lengths) + np.arange(total[-1])]
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end: int = END, options: dict[str, str] | None = None) -> None:
    """Encode every text and write the files: doc_id, n_tokens, ids, in ascending order of (doc_id, text), null ids last.

    A null or empty text becomes the end id alone. Repeated rows stay repeated and adjacent. Other columns are ignored.
    The order comes from a range exchange of the texts; ids are made after it, so they are never shuffled.
    """
    shape = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encoder(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                ids, sizes = make.encode(texts[a:b], end)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], schema=shape)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.asc_nulls_last("doc_id"), F.asc("text")]
    rows = docs.repartitionByRange(order[0]).sortWithinPartitions(*order).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")
    rows.write.options(**{**PARQUET, **(options or {})}).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and start (ids of all documents before) from the metadata columns; the ids are not read.

    Files are in order and each is sorted, so a running sum inside a file plus the total of the files before gives the
    start; the totals are one row per file. ``_file`` and ``_row`` address a document's row.
    """
    meta = spark.read.schema("doc_id long, n_tokens long").parquet(path).select(
        "doc_id", "n_tokens", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    totals = meta.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("_file").orderBy("_row")) - F.col("n_tokens")
    return meta.withColumn("_inside", inside).join(before, "_file").select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "_file", "_row")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids of the documents with first <= doc_id <= last; the bounds reach the column indexes."""
    docs = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    if first is not None:
        docs = docs.filter(F.col("doc_id") >= first)
    if last is not None:
        docs = docs.filter(F.col("doc_id") <= last)
    return docs


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    shape = pa.schema([("_file", pa.string()), ("_row", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_file"), batch.column("_row"), pa.array(sums, pa.int64())], schema=shape)

    sums = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path).select(
        F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"), "ids").mapInArrow(run, "_file string, _row long, ids_crc32 long")
    return read_metadata(spark, path).join(sums, ["_file", "_row"]).select("doc_id", "start", "n_tokens", "ids_crc32")
