"""N-gram Jaccard join by filters under several global token orders, and the components of its links.

A document's tokens are its distinct shingles of ``width`` lower-case words (three unless told otherwise); two documents
link when 100 * intersection >= ``percent`` * union (90). In any global order of tokens, two linked documents share a
token among the first n - ceil(percent / 100 * n) + 1 of each. Candidates must pass that filter under three orders before
their sets are compared: all put the corpus' most frequent tokens last, and shuffle the rest by different hashes. The
first order's tokens form the buckets; a candidate's other two prefixes are drawn up where its texts meet. Before texts
move, 1024 parity bits of a set's tokens tell most unlike sets: sets differ in at least as many tokens as bits. Sets of
over 2048 tokens have as many bits again as tokens, which only meet for the pairs that are left.

Documents with equal sets form one class and take part once. Classes that meet under a token of the first order are not
paired with each other at once: each meets the bucket's leader of its length first (a star), verified links are merged
into components, and only classes of different components that still meet are compared after that, block against block,
under one token of those that the very same classes hold: first every class with one other of each block that may link (a
forest, which joins near copies whose leader was a stranger), then, of what is still apart, all pairs. So a group of n near
copies costs about n comparisons, every pair whose link could matter is verified, and no candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import LAST_ID, WORD, ascii_lower, distinct, hash_words, mix, plain, rolling, stored

WIDTH, PERCENT = 3, 90
FREQUENT, SEEN = 300_000, 4
SHARD_BYTES, BLOCK, BITS, GROUP, FEW_ROWS = 40_000_000, 256, 1_024, 1_000, 4_000_000
SEEDS = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` make one shingle, no word none."""
    words = WORD.findall(ascii_lower(text))
    return distinct(rolling(hash_words(words), min(width, len(words)))) if words else np.empty(0, np.uint64)


def _frequent(frames: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        values = np.sort(np.concatenate([np.empty(0, np.uint64), *map(partial(shingles, width=width), frame["text"])]))
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
        counts = np.diff(np.append(starts, len(values)))
        often = counts >= SEEN
        yield pd.DataFrame({"token": values[starts][often].view(np.int64), "n": counts[often]})


def prefix(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray, seed: np.uint64, percent: int) -> np.ndarray:
    """The first tokens of a set in a global order: frequent ones last by count, the others by a hash."""
    n = len(tokens)
    size = n - -(-percent * n // 100) + 1
    order = mix(tokens ^ seed) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        order = np.where(frequent[at] == tokens, np.uint64(1 << 63) + rank[at], order)
    return tokens[np.argpartition(order, size - 1)[:size]] if n else tokens


def sketch(tokens: np.ndarray, bits: int = BITS) -> bytes:
    """The parity of the tokens in each of ``bits`` cells, as bits."""
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def wide_sketch(tokens: np.ndarray) -> bytes | None:
    """For long sets: as many cells as tokens, up to the next power of two."""
    return sketch(tokens, 1 << (len(tokens) - 1).bit_length()) if len(tokens) > 2 * BITS else None


def near(a: np.ndarray, b: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches allow a link: linked sets of together ``n`` tokens differ in at most
    n * (100 - percent) / (100 + percent), and a token that one of them lacks turns one bit."""
    return (100 + percent) * np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= (100 - percent) * n


def unpacked(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, BITS // 64)


def _can_link(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.loc[near(unpacked(frame["sketch"]), unpacked(frame["_sketch"]), (frame["n"] + frame["_n"]).to_numpy(), percent), ["a", "b"]]


def near_wide(a: bytes | None, b: bytes | None, n: int, percent: int) -> bool:
    """``near`` of two wide sketches; the wider is folded, as a cell's parity is that of its two halves'."""
    if a is None or b is None:
        return True
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) != len(y):
        x, y = (x[: len(x) // 2] ^ x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] ^ y[len(y) // 2 :])
    return bool(near(x[None], y[None], np.array([n]), percent)[0])


def _can_link_wide(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Pairs whose wide sketches allow a link."""
    for frame in frames:
        keep = [near_wide(a, b, n, percent) for a, b, n in zip(frame["wide"], frame["_wide"], frame["n"], strict=True)]
        yield frame.loc[np.array(keep, bool), ["a", "b"]]


def _describe(frames: Iterator[pd.DataFrame], frequent: np.ndarray, rank: np.ndarray, width: int, percent: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        sets = [shingles(t, width) for t in frame["text"]]
        classes = mix(np.array([[np.bitwise_xor.reduce(mix(s ^ SEEDS[0])), mix(s).sum(dtype=np.uint64), len(s)] if len(s) else [0, 0, 0] for s in sets], np.uint64).reshape(-1, 3))
        classes = mix(classes[:, 0] + mix(classes[:, 1] + mix(classes[:, 2])))
        yield pd.DataFrame({
            "_id": frame["_id"], "_row": frame["_row"], "n": [len(s) for s in sets], "c": classes.view(np.int64), "sketch": [sketch(s) for s in sets], "wide": [wide_sketch(s) for s in sets],
            "p1": [prefix(s, frequent, rank, SEEDS[0], percent).view(np.int64) for s in sets]})


def _spread(frames: Iterator[pd.DataFrame], shards: int) -> Iterator[pd.DataFrame]:
    """First-order filter tokens of a frame, packed into one row per shard; equal sets once."""
    for frame in frames:
        frame = frame[~frame["c"].duplicated()]
        sizes = np.fromiter(map(len, frame["p1"]), np.int64, len(frame))
        tokens = np.concatenate([np.empty(0, np.int64), *frame["p1"]])
        c, n = np.repeat(frame["c"].to_numpy(), sizes), np.repeat(frame["n"].to_numpy(), sizes)
        shard = (mix(tokens.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        parts = [(s, order[cuts[s] : cuts[s + 1]]) for s in range(shards) if cuts[s + 1] > cuts[s]]
        yield pd.DataFrame([(s, tokens[o].astype("<i8").tobytes(), c[o].astype("<i8").tobytes(), n[o].astype("<u4").tobytes()) for s, o in parts],
                           columns=["_shard", "tokens", "c", "n"]).astype({"_shard": "int32"})


def _buckets(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(token, c, n, lead) of tokens that several classes hold: lead is the class of the nearest smaller length that can
    link by length, or the class itself where a new leader starts."""
    tokens, c = (np.concatenate([np.frombuffer(x, "<i8") for x in frame[k]]) for k in ("tokens", "c"))
    n = np.concatenate([np.frombuffer(x, "<u4") for x in frame["n"]]).astype(np.int64)
    order = np.lexsort((c, n, tokens))
    tokens, c, n = tokens[order], c[order], n[order]
    once = np.append(True, (tokens[1:] != tokens[:-1]) | (c[1:] != c[:-1]))[: len(tokens)]
    tokens, c, n = tokens[once], c[once], n[once]
    starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.empty(0, np.int64)
    size = np.repeat(np.diff(np.append(starts, len(tokens))), np.diff(np.append(starts, len(tokens))))
    many = size > 1
    tokens, c, n = tokens[many], c[many], n[many]
    lead, token, at = np.empty_like(c), None, 0
    for i, (t, size) in enumerate(zip(tokens.tolist(), n.tolist(), strict=True)):
        if t != token or percent * size > 100 * n[at]:
            token, at = t, i
        lead[i] = c[at]
    return pd.DataFrame({"token": tokens, "c": c, "n": n, "lead": lead})


def _verify(frame: pd.DataFrame, frequent: np.ndarray, rank: np.ndarray, width: int, percent: int) -> pd.DataFrame:
    """Links between leaders and the members of their blocks: a shared token under each further order, then whole sets."""
    made: dict[int, tuple] = {}

    def described(c: int, text: str) -> tuple[np.ndarray, list[np.ndarray]]:
        if c not in made:
            tokens = shingles(text, width)
            made[c] = tokens, [prefix(tokens, frequent, rank, seed, percent) for seed in SEEDS[1:]]
        return made[c]

    out = []
    for (lead, _), rows in frame.groupby(["lead", "block"], sort=False):
        texts = dict(zip(rows["c"], rows["text"], strict=True))
        own, filters = described(lead, texts.pop(lead))
        for c, text in texts.items():
            tokens, others = described(c, text)
            if all(np.isin(a, b).any() for a, b in zip(filters, others, strict=True)):
                common = np.intersect1d(own, tokens, assume_unique=True).size
                if 100 * common >= percent * (len(own) + len(tokens) - common):
                    out.append((c, lead))
    return pd.DataFrame(out, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})


def components(links: DataFrame) -> DataFrame:
    """(node, component = smallest node) of an undirected graph links(a, b), by alternating stars; no node without a link.

    Every round replaces edges by edges to the smallest neighbour and is written to the shared folder; the number of
    rounds grows with the logarithm of the longest chain.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), "links")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def still_open(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """(token, c, n, component) of the tokens under which classes of different components meet.

    Tokens held by the very same classes lead to the same pairs, so one of them stays: 128 bits over the classes and their
    number tell such tokens.
    """
    labelled = buckets.join(components(links).withColumnRenamed("node", "c"), "c", "left").select("token", "c", "n", F.coalesce("component", "c").alias("component"))
    held = [F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("c")).alias("_x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("_y")]
    several = labelled.groupBy("token").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), *held).filter("_a != _b")
    several = several.groupBy("_n", "_x", "_y").agg(F.min("token").alias("token")).select("token")
    return stored(labelled.join(several, "token", "left_semi"), "open")


def _meeting(token: np.ndarray, side: np.ndarray, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs to look at, in chunks: of each token all pairs of its rows (side 0), or left by right."""
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    sizes = np.diff(np.append(starts, len(token)))
    alone = side[starts] == 0
    twos = starts[alone & (sizes == 2)]
    yield twos, twos + 1
    lefts, rights, held = [], [], 0
    for start, size, same in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), alone[sizes > 1].tolist(), strict=True):
        if same and size == 2:
            continue
        if same:
            left, right = np.triu_indices(size, 1)
        else:
            cut = int(np.searchsorted(side[start : start + size], 0))
            left, right = np.repeat(np.arange(cut), size - cut), np.tile(np.arange(cut, size), cut)
        lefts.append(left + start)
        rights.append(right + start)
        held += len(left)
        if held > most:
            yield np.concatenate(lefts), np.concatenate(rights)
            lefts, rights, held = [], [], 0
    if lefts:
        yield np.concatenate(lefts), np.concatenate(rights)


def _meet(frame: pd.DataFrame, percent: int, forest: bool) -> pd.DataFrame:
    """Pairs of a block pair, or of the small tokens of a shard, whose lengths and sketches allow a link; with ``forest``
    each class with the smallest of those only."""
    frame = frame.sort_values(["token", "side", "c"])
    token, side, c, n, component = (frame[k].to_numpy() for k in ("token", "side", "c", "n", "component"))
    marks, wide, out = unpacked(frame["sketch"]), dict(zip(frame["c"], frame["wide"], strict=True)), [np.empty((0, 2), np.int64)]
    size = dict(zip(frame["c"], frame["n"], strict=True))
    for left, right in _meeting(token, side):
        fits = (component[left] != component[right]) & (c[left] != c[right]) & (100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right]))
        left, right = left[fits], right[fits]
        for i in range(0, len(left), 100_000):
            a, b = left[i : i + 100_000], right[i : i + 100_000]
            keep = near(marks[a], marks[b], n[a] + n[b], percent)
            a, b = c[a[keep]], c[b[keep]]
            out.append(np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0))
    pairs = np.unique(np.concatenate(out), axis=0)
    pairs = pairs[np.array([near_wide(wide[a], wide[b], size[a] + size[b], percent) for a, b in pairs.tolist()], bool)]
    if forest:
        pairs = pairs[np.append(True, pairs[1:, 0] != pairs[:-1, 0])[: len(pairs)]]
    return pd.DataFrame(pairs, columns=["a", "b"])


def met_in_blocks(rest: DataFrame, known: DataFrame, long: DataFrame, percent: int, forest: bool = False) -> DataFrame:
    """(a, b): classes of different components that share an open token and may link; every pair of a token is looked at.

    Tokens of nearly the same classes have the same smallest class more often than not and share a shard, so a pair that
    meets under many tokens comes once or a few times. With ``forest`` each class keeps one pair of a group. A token's classes are cut into blocks of about ``BLOCK``; every two blocks meet in a group of their own that emits
    only what passes, and tokens of one block share groups. So no group and no row count grows with the square of a
    bucket, and a hot bucket spreads over many tasks.
    """
    shards = max(16, rest.count() // GROUP)
    counts = rest.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.min("c").alias("first"))
    parts = counts.groupBy("first").agg(F.ceil(F.sum("rows") / (20 * GROUP)).alias("parts"))
    sizes = counts.join(parts, "first").select("token", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"),
        F.pmod(F.xxhash64("first", F.pmod(F.xxhash64("token"), "parts")), F.lit(shards)).cast("int").alias("shard"))
    held = known.select("c", "sketch").join(long.select("c", "wide"), "c", "left")
    placed = rest.join(sizes, "token").join(held, "c").withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    small = placed.filter("blocks = 1").select(F.lit(None).cast("long").alias("key"), F.col("shard").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "token", "c", "n", "component", "sketch", "wide")
    large = placed.filter("blocks > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select(F.col("token").alias("key"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"),
                         F.signum(F.col("block") - F.col("o")).cast("int").alias("side"), "token", "c", "n", "component", "sketch", "wide")
    return small.unionByName(large).groupBy("key", "i", "j").applyInPandas(partial(_meet, percent=percent, forest=forest), "a long, b long").distinct()


def linked_components(documents: DataFrame, percent: int = PERCENT, frequent: int = FREQUENT, shard_bytes: int = SHARD_BYTES, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), _row.

    Null and empty texts have no shingles and link with nothing. Documents with equal sets are linked. A null doc_id
    counts as the largest id and is returned as null, also as component_id. Rows that share an id are documents of their
    own. ``_row`` is a hash of (id, text), for callers that join back to rows. Other columns are ignored.
    """
    docs = plain(documents).withColumn("_row", F.xxhash64("_id", "text"))
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    often = docs.select("text").mapInPandas(partial(_frequent, width=width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(frequent).toArrow()
    tokens = often.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    rank = np.arange(len(tokens), 0, -1).astype(np.uint64)[order]  # the most frequent token is last of all
    described = stored(docs.mapInPandas(
        partial(_describe, frequent=tokens[order], rank=rank, width=width, percent=percent), "_id long, _row long, n long, c long, sketch binary, wide binary, p1 array<long>"), "shingles")
    filled = described.filter("n > 0")
    classes = filled.groupBy("c").agg(F.min("_id").alias("rep"), F.min_by("_row", F.struct("_id", "_row")).alias("rep_row"))
    known = filled.groupBy("c").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    spread = filled.select("c", "n", "p1").mapInPandas(partial(_spread, shards=max(1, -(-total // shard_bytes))), "_shard int, tokens binary, c binary, n binary")
    buckets = stored(spread.groupBy("_shard").applyInPandas(partial(_buckets, percent=percent), "token long, c long, n long, lead long"), "buckets")

    long = stored(filled.filter("wide is not null").groupBy("c").agg(F.first("n").alias("n"), F.first("wide").alias("wide")), "wide")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among (a, b), in blocks of one leader and members."""
        left, right = long.select(F.col("c").alias("a"), "n", "wide"), long.select(F.col("c").alias("b"), F.col("n").alias("_n"), F.col("wide").alias("_wide"))
        both = pairs.join(left, "a", "left").join(right, "b", "left").select("a", "b", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"), "wide", "_wide")
        passed = stored(both.mapInPandas(partial(_can_link_wide, percent=percent), "a long, b long"), "passed")
        blocks = passed.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        members = passed.join(blocks, "b").select(F.col("b").alias("lead"), F.pmod(F.xxhash64("a"), "blocks").alias("block"), F.col("a").alias("c"))
        leaders = blocks.select(F.col("b").alias("lead"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("b").alias("c"))
        wanted = members.unionByName(leaders).join(classes.select("c", F.col("rep_row").alias("_row")), "c")
        rows = stored(wanted, "wanted")
        asked = rows.select("_row").distinct()
        few = asked.count() <= FEW_ROWS  # then only their texts are exchanged
        shards = max(16, rows.count() // GROUP)
        texts = docs.select("_row", "text").join(F.broadcast(asked) if few else asked, "_row", "left_semi").join(rows, "_row")
        texts = texts.select("lead", "block", "c", "text", F.pmod(F.xxhash64("lead", "block"), F.lit(shards)).alias("_shard"))
        return stored(texts.groupBy("_shard").applyInPandas(partial(_verify, frequent=tokens[order], rank=rank, width=width, percent=percent), "a long, b long").distinct(), "verified")

    stars = buckets.filter("c != lead").select(F.col("c").alias("a"), F.col("lead").alias("b")).distinct()
    left, right = known.select(F.col("c").alias("a"), "n", "sketch"), known.select(F.col("c").alias("b"), F.col("n").alias("_n"), F.col("sketch").alias("_sketch"))
    links = verified(stored(stars.join(left, "a").join(right, "b").mapInPandas(partial(_can_link, percent=percent), "a long, b long"), "candidates"))
    rest = still_open(buckets, links)
    links = links.unionByName(verified(stored(met_in_blocks(rest, known, long, percent, forest=True), "candidates")))
    rest = still_open(rest.select("token", "c", "n"), links)
    final = components(links.unionByName(verified(stored(met_in_blocks(rest, known, long, percent), "candidates"))))
    smallest = final.join(classes.select(F.col("c").alias("node"), "rep"), "node")
    smallest = smallest.join(smallest.groupBy("component").agg(F.min("rep").alias("least")), "component").select(F.col("node").alias("c"), "least")
    own = classes.select("c", "rep").join(smallest, "c", "left").select("c", F.coalesce("least", "rep").alias("least"))
    result = described.join(own, (described.c == own.c) & (described.n > 0), "left").select("_id", "_row", "n", F.coalesce("least", "_id").alias("least"))
    known_id = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return result.select(known_id("_id").alias("doc_id"), F.col("n").alias("n_shingles"), known_id("least").alias("component_id"), "_row")


def one_per_component(documents: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The documents without those that link, directly or through others, to one kept: of each component the row with the
    smallest (doc_id, text hash) stays. Rows of equal id and text are one document, of which one row stays. All columns
    unchanged; documents without shingles stay."""
    found = linked_components(documents, percent, width=width)
    best = found.filter("n_shingles > 0").groupBy(F.coalesce("component_id", F.lit(LAST_ID)).alias("_component")).agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)), "_row")).alias("_best"))
    kept = best.select(F.col("_best._row").alias("_kept")).unionByName(found.filter("n_shingles = 0").select(F.col("_row").alias("_kept"))).distinct()
    name = "_kept"
    while name in documents.columns:
        name += "_"
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), F.coalesce("text", F.lit("")))
    return documents.withColumn(name, row).join(kept.withColumnRenamed("_kept", name), name, "left_semi").dropDuplicates([name]).drop(name)
