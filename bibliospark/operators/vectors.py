"""Nearest neighbours: exact as block products, or by inverted lists with exact cosines inside the lists probed.

A small side travels as one block, which Spark broadcasts, and the other is packed batch by batch where it lies. Two large
sides are dealt into a grid: a task multiplies some 30,000 corpus rows with as many queries, so rows are copied once per 30,000
rows of the other side. Either way a task emits exactly the best k of every query (equal cosines by id), so neither a row-by-row
product nor a whole side is ever materialised.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliospark.partitioning import full_ranks, top_per_key


def _pack(block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(ends, part.column(0)), pa.ListArray.from_arrays(ends, part.column(1))],
                    names=["ids", "vecs"])

    return pack


def unit_rows(rows) -> np.ndarray:
    """Rows over their lengths; not a number where a row has none."""
    matrix = rows.astype(np.float64) if isinstance(rows, np.ndarray) and rows.ndim == 2 else np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)


def _usable(ids, vecs) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and unit vectors of the rows that have a direction."""
    units = unit_rows(vecs)
    real = np.flatnonzero(np.isfinite(units).all(axis=1))
    real = real[np.argsort(ids[real], kind="stable")]
    return ids[real], units[real]


def _nearest(query_ids, query_vecs, ids, vecs, k: int, rows: int = 1024, columns: int = 1024):
    """(query ids, ids, cosines) of the k nearest rows of every query, equal cosines by id.

    Products are made in single precision; only pairs that come within its error of a query's k-th best so far are scored in
    double precision. Later columns have higher ids, so an equal cosine never displaces one that is held.
    """
    (query_ids, queries), (ids, units) = _usable(query_ids, query_vecs), _usable(ids, vecs)
    if not len(queries) or not len(units):
        return query_ids[:0], ids[:0], np.zeros(0)
    error = 1e-6 + 1.2e-7 * units.shape[1]
    light, out = units.astype(np.float32), []
    for start in range(0, len(queries), rows):
        own = queries[start : start + rows]
        own_light = own.astype(np.float32)

        def first_columns(scores: np.ndarray, shift: int):
            cols = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            return np.repeat(np.arange(len(own)), cols.shape[1]), cols.ravel() + shift, np.take_along_axis(scores, cols, 1).ravel()

        lo = max(128, k)
        held = first_columns(np.round(own @ units[:lo].T, 6), 0)
        while lo < len(units):
            hi = min(len(units), lo + min(lo, columns))
            least = held[2].reshape(len(own), k)[:, -1]
            close, bound = own_light @ light[lo:hi].T, (least - error).astype(np.float32)
            some = np.flatnonzero(close.max(axis=1) >= bound)
            if not len(some):
                lo = hi
                continue
            at, col = np.divmod(np.flatnonzero(close[some] >= bound[some, None]), hi - lo)
            at = some[at]
            if len(at) > (32 + 2 * k) * rows:  # many equal vectors
                scores = np.round(own @ units[lo:hi].T, 6)
                more = (scores > least[:, None]).any()
                at, col, score = first_columns(scores, lo) if more else (at[:0], col[:0], held[2][:0])
            else:
                col += lo
                score = np.zeros(len(at))
                for i in range(0, len(at), 1 << 16):
                    score[i : i + (1 << 16)] = np.einsum("ij,ij->i", own[at[i : i + (1 << 16)]], units[col[i : i + (1 << 16)]])
                score = np.round(score, 6)
            lo, better = hi, score > least[at]
            if better.any():
                at, col, score = (np.concatenate([h, n[better]]) for h, n in zip(held, (at, col, score)))
                order = np.lexsort((col, -score, at))
                at, col, score = at[order], col[order], score[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                held = tuple(x[place < k] for x in (at, col, score))
        out.append((query_ids[start + held[0]], ids[held[1]], held[2]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _best(k: int | None):
    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids, vecs, queries, query_vecs in zip(frame["ids"], frame["vecs"], frame["qids"], frame["qvecs"]):
                found = _nearest(np.asarray(queries), query_vecs, np.asarray(ids), vecs, k or len(ids))
                yield pd.DataFrame(dict(zip(("query_id", "id", "cosine"), found)))

    return best


def _cell(k: int, dim: int):
    def side(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        vecs = rows.column("vec").combine_chunks()
        return rows.column("id").to_numpy(), vecs.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def cell(corpus: pa.Table, queries: pa.Table) -> pa.Table:
        found = _nearest(*side(queries), *side(corpus), k) if corpus.num_rows and queries.num_rows else ([], [], [])
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("query_id", "id", "cosine"), found, (pa.int64(), pa.int64(), pa.float64()))})

    return cell


def cosine(a: str, b: str) -> Column:
    """Cosine of two vector columns, rounded to 6 digits; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(F.when(norms > 0, dot(a, b) / norms), 6)


def knn(corpus: DataFrame, queries: DataFrame, k: int | None, dim: int, block: int = 1024, in_place: str = "corpus", cell: int = 1 << 30) -> DataFrame:
    """(query_id, id, cosine, rank): the k nearest rows of corpus(id, vec) to each of queries(query_id, vec).

    Without ``k`` every row is ranked for every query, a result of queries times rows.

    ``in_place`` names the large side, which is scanned where it lies when the other has at most ``block`` rows (or without
    ``k``, then in blocks). Otherwise both are dealt into a grid of at most about ``cell`` pairs a task. Vectors of another
    length than ``dim`` or of zero length are skipped. Cosines are rounded to 6 digits before ranking, equal ones rank by id.
    """
    sides = {"corpus": corpus.select(F.col("id").cast("long").alias("id"), "vec"),
             "queries": queries.select(F.col("query_id").cast("long").alias("id"), "vec")}
    sides = {n: d.filter(F.size("vec") == dim).withColumn("vec", F.col("vec").cast("array<float>")) for n, d in sides.items()}
    result, order = "query_id bigint, id bigint, cosine double", [F.col("cosine").desc(), F.col("id")]
    moving_side = next(n for n in sides if n != in_place)
    if k is not None and not sides[moving_side].select("id").offset(block).isEmpty():
        scored = _grid(sides, cell).applyInArrow(_cell(k, dim), result)
        return top_per_key(scored.withColumn("cosine", F.round("cosine", 6)), ["query_id"], k, *order)
    still, moving = sides[in_place], sides[moving_side]
    count = moving.agg(F.count(F.lit(1)).alias("n")).scalar()
    blocks = F.greatest(F.lit(1), F.ceil(count / block)).cast("int")
    moved = (
        moving.withColumn("_b", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        .groupBy("_b").agg(F.collect_list(F.struct("id", "vec")).alias("_m"))
        .select("_b", F.col("_m.id").alias("moved_ids"), F.col("_m.vec").alias("moved_vecs"))
    )
    packed = still.mapInArrow(_pack(block), "ids array<bigint>, vecs array<array<float>>")
    meet = packed.withColumn("_b", F.explode(F.sequence(F.lit(0), blocks - 1))).join(moved, "_b")
    names = ["ids", "vecs", "moved_ids", "moved_vecs"]
    corpus_first = names if in_place == "corpus" else names[2:] + names[:2]
    pairs = meet.select(*[F.col(a).alias(b) for a, b in zip(corpus_first, ("ids", "vecs", "qids", "qvecs"))])
    scored = pairs.mapInPandas(_best(k), result).withColumn("cosine", F.round("cosine", 6))
    if k is None:
        return full_ranks(scored, ["query_id"], *order)
    return top_per_key(scored, ["query_id"], k, *order)


def _grid(sides: dict[str, DataFrame], cell: int):
    """Corpus and queries in groups (_r, _c): every pair of rows meets in one group, which has at most about ``cell`` pairs,
    fewer where that leaves shuffle partitions idle."""
    partitions = int(sides["corpus"].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = {n: d.agg(F.count(F.lit(1)).alias("n")).scalar() for n, d in sides.items()}
    pairs = sizes["corpus"].cast("double") * sizes["queries"]
    edge = F.sqrt(F.least(F.lit(float(cell)), F.greatest(F.lit(float(1 << 20)), pairs / (2 * partitions))))
    parts = {n: F.greatest(F.lit(1), F.ceil(size / edge)).cast("int") for n, size in sizes.items()}
    names = {"corpus": ("_c", "_r", "queries"), "queries": ("_r", "_c", "corpus")}
    dealt = {n: d.withColumn(names[n][0], F.pmod(F.xxhash64("id"), parts[n]).cast("int")).withColumn(names[n][1], F.explode(F.sequence(F.lit(0), parts[names[n][2]] - 1)))
             for n, d in sides.items()}
    return dealt["corpus"].groupBy("_r", "_c").cogroup(dealt["queries"].groupBy("_r", "_c"))


class Lists(NamedTuple):
    """Inverted lists: how many, how many of them a query probes, and how many rows at most the centres are fitted on."""

    count: int
    probes: int
    sample: int = 20_000


def centres(corpus: DataFrame, dim: int, lists: Lists, rounds: int = 12) -> np.ndarray:
    """Unit centres of ``lists.count`` groups, by spherical k-means over a sample of at most ``lists.sample`` rows chosen by
    a hash of the id. Each further starting centre is the sampled row that is least like those before it."""
    usable = corpus.filter((F.size("vec") == dim) & F.exists("vec", lambda x: x != 0))
    rows = usable.select("id", F.col("vec").cast("array<float>").alias("vec")).orderBy(F.xxhash64("id"), "id").limit(lists.sample).collect()
    if not rows:
        return np.zeros((0, dim))
    units = unit_rows([r.vec for r in rows])
    chosen, closest = [0], units @ units[0]
    while len(chosen) < min(lists.count, len(units)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, units @ units[chosen[-1]])
    middle = units[chosen]
    for _ in range(rounds):
        nearest = (units @ middle.T).argmax(1)
        sums = np.zeros_like(middle)
        np.add.at(sums, nearest, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        middle = np.where(norms > 0, sums / np.maximum(norms, 1e-12), middle)
    return middle


def _listed(middle: np.ndarray, probes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                near = np.argsort(-np.nan_to_num(unit_rows(frame["vec"]) @ middle.T, nan=-2.0), axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(frame)), near.shape[1])
                yield pd.DataFrame({"list": near.ravel().astype(np.int32), "id": frame["id"].to_numpy()[at], "vec": [frame["vec"].iloc[i] for i in at]})

    return run


def in_lists(rows: DataFrame, dim: int, middle: np.ndarray, probes: int = 1) -> DataFrame:
    """(list, id, vec): every row of the right length in its ``probes`` nearest lists."""
    usable = rows.filter(F.size("vec") == dim).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
    return usable.mapInPandas(_listed(middle, probes), "list int, id bigint, vec array<float>")


def _blocks(listed: DataFrame, block: int, ids: str, vecs: str) -> DataFrame:
    """A list's rows in blocks of about ``block``, so a list that holds most rows becomes many rows."""
    sizes = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    placed = listed.join(sizes, "list").withColumn("_b", F.pmod(F.xxhash64("id"), "_blocks"))
    packed = placed.groupBy("list", "_b").agg(F.collect_list(F.struct("id", "vec")).alias("_m"))
    return packed.select("list", F.col("_m.id").alias(ids), F.col("_m.vec").alias(vecs))


def knn_in_lists(corpus: DataFrame, queries: DataFrame, k: int, dim: int, lists: Lists, block: int = 1024) -> DataFrame:
    """(query_id, id, cosine, rank) like ``knn``, among the rows of the lists that a query probes.

    Every row is in the list of its nearest centre. Blocks of a list meet blocks of the queries that probe it; cosines are
    exact, so only rows of other lists can be missed. Work falls to about probes / count of the exact one.
    """
    middle = centres(corpus, dim, lists)
    if not len(middle):
        return knn(corpus, queries, k, dim)
    own = _blocks(in_lists(corpus, dim, middle), block, "ids", "vecs")
    asked = _blocks(in_lists(queries.withColumnRenamed("query_id", "id"), dim, middle, lists.probes), block, "qids", "qvecs")
    scored = own.join(asked, "list").select("ids", "vecs", "qids", "qvecs").mapInPandas(_best(k), "query_id bigint, id bigint, cosine double")
    return top_per_key(scored.withColumn("cosine", F.round("cosine", 6)), ["query_id"], k, F.col("cosine").desc(), "id")


def similar_items(corpus: DataFrame, k: int, dim: int, lists: Lists | None = None) -> DataFrame:
    """The k nearest other rows of every row: k + 1 neighbours minus the row itself, in order; exact unless ``lists`` are given."""
    asked = corpus.select(F.col("id").alias("query_id"), "vec")
    hits = knn(corpus, asked, k + 1, dim) if lists is None else knn_in_lists(corpus, asked, k + 1, dim, lists)
    return top_per_key(hits.filter("id <> query_id").drop("rank"), ["query_id"], k, F.col("cosine").desc(), "id")


def recommend_by_vector(corpus: DataFrame, queries: DataFrame, dim: int, limit: int = 3, least: float = 0.4) -> DataFrame:
    return knn(corpus, queries, limit, dim).filter(F.col("cosine") > least)
