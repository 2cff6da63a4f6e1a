"""Shuffle-shaping helpers shared by the operators.

The rule behind all of them: one key may hold a third of all rows. So a per-key winner is an aggregate
(combined before the shuffle) instead of a sort of the whole group, a per-key top-k is a rank filter that
Spark prunes before the shuffle, a page window runs over page buckets with a halo instead of whole books,
and a running count over a global order goes through bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliospark.session import cut_lineage


def descending(column: str | Column) -> Column:
    """Sort key for use inside a struct: numeric columns only."""
    return -(F.col(column) if isinstance(column, str) else column)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions ahead of a Python step whose cost is per row, not per byte."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def input_parts(df: DataFrame, part: int = 8 << 20) -> int:
    """Partitions for a step whose memory follows its rows: those of a shuffle, and one for every ``part`` bytes that the rows
    are read from where those are more. Sizes that Spark only guesses are left out."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, sum(n for n in sizes if n < 1 << 50) // part))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct rows where nearly all differ: dealt by all columns before they are told apart, as a task that only reads them
    would hold all of its rows to drop few, and into parts that do not grow with the input."""
    return df.repartition(input_parts(df), *df.columns).distinct()


def first_per_key(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """One row per key: the row with the smallest ``order`` values. Partial aggregation, no group sort."""
    rest = [c for c in df.columns if c not in keys]
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*columns)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], k: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key, ranked from 1; rows past ``k`` are dropped before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def with_key_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Group size on every row, as a counted aggregate joined back (the join side that is skewed stays splittable)."""
    counts = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias(name))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(counts, same).select(*df.columns, name)


def halo_buckets(df: DataFrame, position: str, before: int, after: int, width: int = 256) -> DataFrame:
    """Give every row its bucket along ``position`` plus copies in the neighbour buckets whose windows need it.

    A row at p is needed by target rows in [p - after, p + before]. ``_bucket`` is the bucket, ``_own`` tells the
    row from its copies: window by (key, _bucket), then keep ``_own``. No task ever holds a whole hot book.
    """
    p = F.col(position)
    lo = F.floor((p - after) / width).cast("long")
    hi = F.floor((p + before) / width).cast("long")
    home = F.floor(p / width).cast("long")
    return (
        df.withColumn("_home", home)
        .withColumn("_bucket", F.explode(F.sequence(lo, hi)))
        .withColumn("_own", F.col("_bucket") == F.col("_home"))
        .drop("_home")
    )


def runs(df: DataFrame, keys: Sequence[str], position: str, width: int = 4096) -> DataFrame:
    """Maximal runs of consecutive integer positions per key: columns keys, run_start, run_end.

    Islands are built inside buckets of ``width`` positions; only the at most two islands per bucket that touch a
    bucket edge take part in the second pass that glues them, so a hot key is never sorted in one task.
    """
    rows = df.select(*keys, F.col(position).cast("long").alias("_p")).distinct()
    rows = rows.withColumn("_b", F.floor(F.col("_p") / width).cast("long"))
    inner = Window.partitionBy(*keys, "_b").orderBy("_p")
    pieces = (
        rows.withColumn("_island", F.col("_p") - F.row_number().over(inner))
        .groupBy(*keys, "_b", "_island")
        .agg(F.min("_p").alias("run_start"), F.max("_p").alias("run_end"))
        .withColumn("_head", F.col("run_start") == F.col("_b") * width)
        .withColumn("_tail", F.col("run_end") == (F.col("_b") + 1) * width - 1)
    )
    closed = pieces.filter(~F.col("_head") & ~F.col("_tail")).select(*keys, "run_start", "run_end")
    across = Window.partitionBy(*keys).orderBy("run_start")
    glued = (
        pieces.filter(F.col("_head") | F.col("_tail"))
        .withColumn("_new", (F.coalesce(F.lag("run_end").over(across), F.lit(-2)) + 1 != F.col("run_start")).cast("int"))
        .withColumn("_run", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"))
        .select(*keys, "run_start", "run_end")
    )
    return closed.unionByName(glued)


def rows_before(df: DataFrame, position: str, bucket: Column, name: str) -> DataFrame:
    """Distinct ``position`` values with the number of rows strictly before each, without a global sort.

    Equal positions are counted together first; a running total over the (small) bucket table gives the offset of a
    bucket, a window inside the bucket gives the rest.
    """
    ties = df.groupBy(position).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", bucket)
    totals = ties.groupBy("_bucket").agg(F.sum("_n").alias("_total"))
    strictly = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_total").over(strictly), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ties.join(offsets, "_bucket")
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .select(position, name)
    )


def rank_in_key(df: DataFrame, keys: Sequence[str], position: str, name: str, width: int = 4096) -> DataFrame:
    """Zero-based rank of the distinct integer positions of a key, plus ``<name>_of``, the size of the key.

    Buckets of ``width`` positions are ranked on their own and shifted by the rows in earlier buckets of the key.
    """
    rows = df.withColumn("_b", F.floor(F.col(position) / width).cast("long"))
    sizes = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(
        *keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(f"{name}_of"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(position)) - 1
    return rows.withColumn("_r", inside).join(shift, [*keys, "_b"]).withColumn(name, F.col("_shift") + F.col("_r")).drop("_b", "_r", "_shift")


def full_ranks(df: DataFrame, keys: Sequence[str], *order: Column, rank: str = "rank") -> DataFrame:
    """Every row with its rank in its key, from 1, also where a key holds most rows: rows are dealt by range, ranked inside
    their part of a key and shifted by the rows in its earlier parts. ``order`` must leave no ties."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(df)  # read for the bounds of the ranges and for the rows
    dealt = cut_lineage(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return dealt.withColumn("_r", inside).join(shift, [*keys, "_part"]).withColumn(rank, (F.col("_shift") + F.col("_r")).cast("int")).drop("_part", "_r", "_shift")
