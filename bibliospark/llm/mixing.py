"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

1. Targets. Sources share all words by weight; a target stops at three times its source, the rest is shared again.
2. Blocks. A hash deals the documents of every source into at most 4096 blocks. Whole passes over all blocks, then blocks in
   a hashed order as long as they fit under the target, give the draws of the source; a last block that would pass the
   target is drawn when that comes nearer.
3. Tree. The draws of all sources are a population of block quotas. A node splits its quotas in two halves of equal
   size by a multivariate-hypergeometric draw (source after source, each a hypergeometric draw by inversion given what
   the earlier ones took), down to one quota vector per output shard. The quotas of the shards add up exactly.
4. Deal. The draws of a source, permuted by hash, go to the shards in runs of their quotas: disjoint by construction.
   Inside a shard the documents follow a hash.

Every random number is a hash of the seed and of what it is for, so reruns agree. Steps 1, 3 and 4 work on tables of
blocks and sources; documents take part in one aggregation and one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliospark.functions.text import let
from bibliospark.llm.common import stored

WEIGHTS, CAP = (5, 2, 1), 3
BLOCKS, LEVELS, SEED = 4096, 4, 17
SPACES = r"[\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    """Words of a text; null has none."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def source_key(source: str) -> Column:
    """A key that tells a null source from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(2**53))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(_source, source_size, target, _rank) per source, from (_source, size).

    Sources by code point, null last, take the weights in turn. A source is capped when its share of what the capped
    ones before it (by cap per weight) leave exceeds its cap; the others share by weight. One row per source here, so
    the windows over all of them are small.
    """
    per = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    named = per.withColumn("_rank", F.row_number().over(Window.orderBy((F.col("_source") == "").cast("int"), "_source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    limited = named.withColumn("_weight", weight).withColumn("_cap", F.col("source_size").cast("double") * cap)
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("_weight").over(later)
    levelled = limited.withColumn("_level", level).withColumn("_n", F.row_number().over(order))
    free = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct("_n", "_level"))
    shared = levelled.withColumn("_free", F.min(free).over(everything))
    share = F.least(F.col("_cap"), F.coalesce(F.col("_free._level"), F.lit(0.0)) * F.col("_weight"))
    return shared.select("_source", "source_size", share.alias("target"), "_rank")


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked balls among ``drawn`` of ``total`` balls, by inversion of the distribution within 12 deviations of its mean.

    Weights follow from the ratio of neighbouring terms and are added in logarithms, first for the whole, then up to u.
    """
    whole = F.greatest(total, F.lit(1)).cast("double")
    mean = drawn * marked / whole
    spread = F.ceil(12 * F.sqrt(mean * (1 - marked / whole) * (1 - drawn / whole) * whole / F.greatest(whole - 1, F.lit(1.0)) + 1)).cast("long")
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked), F.floor(mean) - spread)
    high = F.greatest(low, F.least(marked, drawn, F.ceil(mean) + spread))

    def step(x: Column) -> Column:  # log of P(x) / P(x - 1)
        return F.log(((marked - x + 1) * (drawn - x + 1)).cast("double") / (x * (total - marked - drawn + x)).cast("double"))

    def add(a: Column, b: Column) -> Column:
        return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))

    def walk(bounds: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
        rest = F.when(bounds["high"] > bounds["low"], F.sequence(bounds["low"] + 1, bounds["high"])).otherwise(F.array().cast("array<long>"))
        after = lambda acc, x: let(acc["log"] + step(x), lambda log: F.struct(log.alias("log"), add(acc["sum"], log).alias("sum")))
        whole_sum = F.aggregate(rest, start, after)["sum"]

        def pick(goal: Column) -> Column:
            first = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"), bounds["low"].alias("at"))
            move = lambda acc, x: F.when(acc["sum"] >= goal, acc).otherwise(let(
                acc["log"] + step(x), lambda log: F.struct(log.alias("log"), add(acc["sum"], log).alias("sum"), x.alias("at"))))
            return F.aggregate(rest, first, move)["at"]

        return let(whole_sum + F.log(u), pick)

    return let(F.struct(low.alias("low"), high.alias("high")), walk)


def left_half(quotas: Column, seed: int, node: Column) -> Column:
    """The quotas of the left child: a multivariate-hypergeometric draw of half of all."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    numbered = F.transform(quotas, lambda q, i: F.struct(q.alias("q"), i.alias("i")))

    def take(acc: Column, x: Column) -> Column:
        drawn = hypergeometric(acc["total"], x["q"], acc["room"], uniform(F.lit(seed), F.lit("tree"), node, x["i"]))
        return let(drawn, lambda d: F.struct((acc["total"] - x["q"]).alias("total"), (acc["room"] - d).alias("room"), F.concat(acc["out"], F.array(d)).alias("out")))

    def start(n: Column) -> Column:
        return F.struct(n.alias("total"), F.ceil(n / 2).cast("long").alias("room"), F.array().cast("array<long>").alias("out"))

    return let(total, lambda n: F.aggregate(numbered, start(n), take)["out"])


def shard_quotas(draws: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(_rank, _bounds): per source the first draw of every shard, from draws(_rank, _blocks)."""
    per = draws.groupBy("_rank").agg(F.count(F.lit(1)).alias("q"))
    nodes = per.agg(F.array_sort(F.collect_list(F.struct("_rank", "q"))).alias("x")).select(
        F.lit(1).cast("long").alias("_node"), F.col("x._rank").alias("_ranks"), F.col("x.q").alias("_quotas"))
    for _ in range(levels):
        pair = let(left_half(F.col("_quotas"), seed, F.col("_node")), lambda left: F.array(
            F.struct((F.col("_node") * 2).alias("_node"), left.alias("_quotas")),
            F.struct((F.col("_node") * 2 + 1).alias("_node"), F.zip_with("_quotas", left, lambda a, b: a - b).alias("_quotas"))))
        nodes = nodes.select("_ranks", F.explode(pair).alias("_child")).select("_child._node", "_ranks", "_child._quotas")
    shards = nodes.select((F.col("_node") - 2**levels).alias("_shard"), F.explode(F.arrays_zip("_ranks", "_quotas")).alias("_x")).select(
        "_shard", F.col("_x._ranks").alias("_rank"), F.col("_x._quotas").alias("_quota"))
    before = Window.partitionBy("_rank").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("_first", F.coalesce(F.sum("_quota").over(before), F.lit(0))).groupBy("_rank").agg(F.array_sort(F.collect_list("_first")).alias("_bounds"))


def more_blocks(blocks: Column, rest: Column) -> Column:
    """Blocks (b, w words) that fill ``rest`` words in the given order; blocks without words are not drawn."""

    def move(acc: Column, x: Column) -> Column:
        return F.when((x["w"] > 0) & (x["w"] <= acc["gap"]), F.struct((acc["gap"] - x["w"]).alias("gap"), F.concat(acc["out"], F.array(x["b"])).alias("out"))).otherwise(acc)

    def finish(done: Column) -> Column:
        over = F.array_min(F.transform(F.filter(blocks, lambda x: (x["w"] > 0) & (x["w"] < 2 * done["gap"]) & ~F.array_contains(done["out"], x["b"])), lambda x: F.struct(x["w"], x["b"].alias("b"))))
        return F.when(over.isNull(), done["out"]).otherwise(F.concat(done["out"], F.array(over["b"])))

    start = F.struct(rest.cast("double").alias("gap"), F.array().cast("array<bigint>").alias("out"))
    return let(F.aggregate(blocks, start, move), finish)


def mixture(documents: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, levels: int = LEVELS, seed: int = SEED, blocks: int = BLOCKS) -> DataFrame:
    """The documents with _size (words), _source_size, _target and _takes: array of (copy, shard), empty if not drawn.

    A document without words follows its block; a block without words is not drawn. A null source is a source of its own, the
    last. A source without words has target 0 and is not drawn. Copies number 0..cap-1. Repeated rows share a block.
    Columns of these four names are replaced.
    """
    kept = [c for c in documents.columns if c not in ("_size", "_source_size", "_target", "_takes")]
    identity = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    sized = documents.select(*kept, n_words("text").alias("_size"), source_key("source").alias("_key_"), F.pmod(identity, F.lit(blocks).cast("long")).alias("_block_"))
    per_block = stored(sized.groupBy("_key_", "_block_").agg(F.sum("_size").alias("_words")), "blocks")
    want = targets(per_block.select(F.col("_key_").alias("_source"), F.col("_words").alias("size")), weights, cap).withColumnRenamed("_source", "_key_")
    entry = F.struct(F.xxhash64(F.lit(seed), F.lit("order"), "_key_", "_block_").alias("h"), F.col("_block_").alias("b"), F.col("_words").alias("w"))
    listed = per_block.groupBy("_key_").agg(F.array_sort(F.collect_list(entry)).alias("_all")).join(want, "_key_")  # at most ``blocks`` entries
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    more = listed.withColumn("_passes", passes).withColumn("_more", more_blocks(F.col("_all"), F.col("target") - F.col("_passes") * F.col("source_size")))
    each = more.select("_key_", "_rank", "source_size", "target", "_passes", "_more", F.explode("_all").alias("_one"))
    taken = each.select("_key_", "_rank", "source_size", "target", F.col("_one.b").alias("_block_"), F.when(
        F.col("_one.w") > 0, F.col("_passes") + F.array_contains("_more", F.col("_one.b")).cast("long")).otherwise(F.lit(0)).alias("_n"))
    taken = stored(taken, "drawn")
    draws = taken.filter("_n > 0").select("_key_", "_block_", "_rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("copy"))
    deal = Window.partitionBy("_rank").orderBy(F.xxhash64(F.lit(seed), F.lit("deal"), "_key_", "_block_", "copy"), "_block_", "copy")
    numbered = draws.withColumn("_draw", F.row_number().over(deal) - 1)
    placed = numbered.join(shard_quotas(draws, levels, seed), "_rank").withColumn(
        "shard", F.size(F.filter("_bounds", lambda b: b <= F.col("_draw"))) - 1)
    takes = placed.groupBy("_key_", "_block_").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("_takes"))
    told = taken.select("_key_", "_block_", "source_size", "target").join(takes, ["_key_", "_block_"], "left")
    return sized.join(told, ["_key_", "_block_"]).select(
        *kept, "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        F.coalesce("_takes", F.array().cast("array<struct<copy:long,shard:int>>")).alias("_takes"))


def mixed(documents: DataFrame, levels: int = LEVELS, seed: int = SEED, **options) -> DataFrame:
    """The mix: every drawn copy of a document as a row, the columns of ``documents`` unchanged, dealt to 2^levels shards
    and shuffled inside each. A hot shard is no larger than the others: they hold equal numbers of block draws."""
    drawn = mixture(documents, levels=levels, seed=seed, **options).select(*documents.columns, F.explode("_takes").alias("_take_"))
    shuffled = drawn.repartition(2**levels, F.col("_take_.shard")).sortWithinPartitions(
        "_take_.shard", F.xxhash64(F.lit(seed), F.lit("row"), "doc_id", F.xxhash64("text"), "_take_.copy"))
    return shuffled.drop("_take_")
