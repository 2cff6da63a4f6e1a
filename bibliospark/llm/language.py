"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions; the context of a decision is the last 0..4 bytes and the bits of the byte so far. Every
context holds a Krichevsky-Trofimov estimate of its counts in the training texts, and the estimates of all depths are
mixed with the weights of context-tree weighting: a node's evidence is half its own KT evidence and half the product of
its children's, so the share of the node itself follows bottom-up. A context never met in training predicts like its
parent. A text is scored with the trained tree: log10 of its bytes (A-Z lower-cased) and one closing byte 0.

All counts come from all training texts. The probability of a byte after four bytes is a function of those five bytes,
so documents ask shards for the distinct five-byte strings of a batch instead of holding a model: pass 1 counts strings
and words of the training texts per shard and writes the merged shards (shard = hash of the two bytes before the byte,
or of the word); depths 0 and 1, at most 65,280 nodes, are summed and broadcast; pass 2 sends the distinct strings and
words of each batch of documents to the shards and the answers back to the batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import LAST_ID, WORD, batched, hash_words, mix, plain, restored_id, slices, stored

DEPTH = 4
BATCH_CHARS, SHARD_BYTES = 3_000_000, 16_000_000
_HALF, _U8 = np.log(0.5), np.uint64(8)


def lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - sum(np.log(x + i) for i in range(8))


def kt_evidence(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the KT probability of any sequence with these counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(five-byte strings as 40-bit numbers, text of each): every byte and the closing 0, after four bytes (0 before the start)."""
    data = np.frombuffer(b"".join(b"\0\0\0\0" + t + b"\0" for t in texts), np.uint8)
    packed = data[: max(0, len(data) - 4)].astype(np.uint64)
    for i in range(1, 5):
        packed <<= _U8
        packed |= data[i : i + len(packed)]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    inside, ends = np.ones(len(data), bool), np.cumsum(sizes + 4)
    for i in range(1, 5):  # strings that run over into the next text
        inside[ends - i] = False
    return packed[inside[: len(packed)]], np.repeat(np.arange(len(texts)), sizes)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(values)
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, np.int64)
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def shard_of_grams(values: np.ndarray, shards: int) -> np.ndarray:
    return (mix((values >> _U8) & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int64)


def shard_of_words(values: np.ndarray, shards: int) -> np.ndarray:
    return (mix(values) % np.uint64(shards)).astype(np.int64)


def by_shard(values: np.ndarray, shard: np.ndarray, shards: int, *more: np.ndarray) -> list[tuple]:
    """Per shard the values, and what goes with them, in ascending order (``values`` ascend)."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return [tuple(a[order[cuts[s] : cuts[s + 1]]] for a in (values, *more)) for s in range(shards)]


def pack(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpack(data: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, size)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :size] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def trained_on(ids: np.ndarray, folds: int, held: int) -> np.ndarray:
    """Whether a document is for training: crc32 of the id as text modulo ``folds`` is not ``held``; null ids are."""
    return np.fromiter((i == LAST_ID or zlib.crc32(str(i).encode()) % folds != held for i in ids.tolist()), bool, len(ids))


def tokens_and_bytes(texts) -> tuple[list[np.ndarray], list[bytes]]:
    raw = [t.encode("utf-8", "replace").lower() for t in texts]  # bytes have ASCII case only
    return [hash_words(WORD.findall(t.decode("utf-8"))) for t in raw], raw


# Nodes of one depth: key = context bytes * 256 + (1 and the bits so far); n0, n1 counts; evidence; share of the node's own estimate.

def nodes(contexts: np.ndarray, last: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, zeros, ones) of the eight decisions of each counted byte ``last`` after ``contexts``."""
    keys, bits = [], []
    for j in range(8):
        keys.append((contexts << _U8) | ((last | np.uint64(256)) >> np.uint64(8 - j)))
        bits.append((last >> np.uint64(7 - j)) & np.uint64(1))
    keys, bits, weight = np.concatenate(keys), np.concatenate(bits), np.tile(counts, 8).astype(float)
    order = np.argsort(keys)
    keys, bits, weight = keys[order], bits[order], weight[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    ones = np.add.reduceat(weight * bits, starts) if len(starts) else np.empty(0)
    return keys[starts], (np.add.reduceat(weight, starts) if len(starts) else np.empty(0)) - ones, ones


def parent_of(keys: np.ndarray, depth: int) -> np.ndarray:
    """Key of the node with the oldest context byte dropped."""
    context = (keys >> _U8) & np.uint64((1 << (8 * (depth - 1))) - 1)
    return (context << _U8) | (keys & np.uint64(255))


def weighted(keys, zeros, ones, below) -> tuple[np.ndarray, np.ndarray]:
    """(log evidence, share of the own estimate); ``below``: summed evidence of the children, None for leaves."""
    own = kt_evidence(zeros, ones)
    if below is None:
        return own, np.ones(len(own))
    total = np.logaddexp(own + _HALF, below + _HALF)
    return total, np.exp(own + _HALF - total)


def summed(keys: np.ndarray, child_keys: np.ndarray, child_evidence: np.ndarray, depth: int) -> np.ndarray:
    return np.bincount(np.searchsorted(keys, parent_of(child_keys, depth)), child_evidence, len(keys)) if len(keys) else np.empty(0)


def tree(values: np.ndarray, counts: np.ndarray, least: int) -> dict[int, tuple]:
    """depth -> (keys, zeros, ones, share, evidence) for the depths ``least``..4, from counted five-byte strings."""
    found, below = {}, None
    for depth in range(DEPTH, least - 1, -1):
        context = (values >> _U8) & np.uint64((1 << (8 * depth)) - 1)
        keys, zeros, ones = nodes(context, values & np.uint64(255), counts)
        evidence, share = weighted(keys, zeros, ones, None if below is None else summed(keys, *below, depth + 1))
        found[depth] = keys, zeros, ones, share, evidence
        below = keys, evidence
    return found


def log10_probability(levels: dict[int, tuple], values: np.ndarray) -> np.ndarray:
    """log10 P(last byte | four bytes) for each five-byte string, mixing all depths of the tree."""
    last, total = values & np.uint64(255), np.zeros(len(values))
    for j in range(8):
        prefix = (last | np.uint64(256)) >> np.uint64(8 - j)
        mixed, rest, deepest, seen = np.zeros(len(values)), np.ones(len(values)), np.full(len(values), 0.5), np.arange(len(values))
        for depth in range(DEPTH + 1):
            keys, zeros, ones, share, *_ = levels[depth]
            if not len(keys):
                break
            want = (((values[seen] >> _U8) & np.uint64((1 << (8 * depth)) - 1)) << _U8) | prefix[seen]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            same = keys[at] == want
            seen, at = seen[same], at[same]
            estimate = (ones[at] + 0.5) / (zeros[at] + ones[at] + 1)
            mixed[seen] += rest[seen] * share[at] * estimate
            rest[seen] *= 1 - share[at]
            deepest[seen] = estimate
        one = mixed + rest * deepest
        total += np.log10(np.where((last >> np.uint64(7 - j)) & np.uint64(1), one, 1 - one))
    return total


COUNTS = "_shard int, words binary, word_counts binary, grams binary, gram_counts binary"


def _count(frames: Iterator[pd.DataFrame], shards: int, folds: int, held: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = list(frame["text"][trained_on(frame["_id"].to_numpy(), folds, held)])
        parts = []
        for a, b in slices(texts):
            words, raw = tokens_and_bytes(texts[a:b])
            parts.append((*counted(np.concatenate(words)), *counted(grams(raw)[0])))
        if not parts:
            continue
        (w, wn), (g, gn) = _summed(*zip(*[p[:2] for p in parts], strict=True)), _summed(*zip(*[p[2:] for p in parts], strict=True))
        split = zip(by_shard(w, shard_of_words(w, shards), shards, wn), by_shard(g, shard_of_grams(g, shards), shards, gn), strict=True)
        yield pd.DataFrame([(s, pack(a, 8), an.astype("<u4").tobytes(), pack(b, 5), bn.astype("<u4").tobytes()) for s, ((a, an), (b, bn)) in enumerate(split)],
                           columns=["_shard", "words", "word_counts", "grams", "gram_counts"]).astype({"_shard": "int32"})


def _added(parts, size: int, kind: str, counts) -> tuple[np.ndarray, np.ndarray]:
    return _summed([unpack(p, size) for p in parts], [np.frombuffer(c, kind) for c in counts])


def _summed(parts, counts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of all parts with their summed counts."""
    values, weight = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(values, kind="stable")
    values, weight = values[order], weight[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return values[starts], np.add.reduceat(weight.astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard's counts added up, and the depth-1 sums of the evidence of its depth-2 nodes."""
    w, wn = _added(frame["words"], 8, "<u4", frame["word_counts"])
    g, gn = _added(frame["grams"], 5, "<u4", frame["gram_counts"])
    keys, zeros, ones, _, evidence = tree(g, gn, 2)[2]
    upper = np.unique(parent_of(keys, 2))
    at = np.searchsorted(upper, parent_of(keys, 2))
    sums = np.stack([np.bincount(at, x, len(upper)) for x in (zeros, ones, evidence)]) if len(upper) else np.empty((3, 0))
    return pd.DataFrame([(frame["_shard"].iloc[0], pack(w, 8), wn.astype("<i8").tobytes(), pack(g, 5), gn.astype("<i8").tobytes(),
                          upper.astype(np.int64).tolist(), *sums.tolist(), int(wn.sum()), len(w))],
                        columns=["_shard", "words", "word_counts", "grams", "gram_counts", "keys", "zeros", "ones", "evidence", "n", "v"])


def _top(rows: list) -> dict[int, tuple]:
    """Depths 0 and 1 of the tree from the summed rows (key, zeros, ones, evidence of the children), at most 65,280 of them."""
    rows = sorted(rows)
    keys = np.array([r[0] for r in rows], np.uint64)
    zeros, ones, below = (np.array([r[i] for r in rows], float) for i in (1, 2, 3))
    evidence, share = weighted(keys, zeros, ones, below)
    root = np.unique(parent_of(keys, 1)) if len(keys) else keys
    at = np.searchsorted(root, parent_of(keys, 1)) if len(keys) else np.empty(0, np.int64)
    rz, ro, rb = (np.bincount(at, x, len(root)) if len(root) else np.empty(0) for x in (zeros, ones, evidence))
    return {0: (root, rz, ro, weighted(root, rz, ro, rb)[1]), 1: (keys, zeros, ones, share)}


def _ask(frame: pd.DataFrame, shards: int) -> pd.DataFrame:
    words, raw = tokens_and_bytes(frame["text"])
    w, g = counted(np.concatenate(words))[0], counted(grams(raw)[0])[0]
    split = zip(by_shard(w, shard_of_words(w, shards), shards), by_shard(g, shard_of_grams(g, shards), shards), strict=True)
    return pd.DataFrame([(frame["_batch"].iloc[0], s, pack(a, 8), pack(b, 5)) for s, ((a,), (b,)) in enumerate(split)],
                        columns=["_batch", "_shard", "words", "grams"]).astype({"_batch": "int32", "_shard": "int32"})


def _answer(top: dict, asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """For each batch the training count of its words and log10 P of its strings, in the order asked."""
    if not len(asked):
        return pd.DataFrame({"_batch": [], "_shard": [], "counts": [], "logs": []})
    w, wn = (unpack(model["words"].iloc[0], 8), np.frombuffer(model["word_counts"].iloc[0], "<i8")) if len(model) else (np.empty(0, np.uint64), np.empty(0, np.int64))
    g, gn = (unpack(model["grams"].iloc[0], 5), np.frombuffer(model["gram_counts"].iloc[0], "<i8")) if len(model) else (np.empty(0, np.uint64), np.empty(0, np.int64))
    levels = {**tree(g, gn, 2), **top}
    wanted = [unpack(x, 5) for x in asked["grams"]]
    distinct = np.unique(np.concatenate(wanted))
    logs = np.concatenate([log10_probability(levels, distinct[i : i + 200_000]) for i in range(0, len(distinct), 200_000)] or [np.empty(0)]).astype("<f4")
    out = []
    for batch, shard, words, strings in zip(asked["_batch"], asked["_shard"], asked["words"], wanted, strict=True):
        words = unpack(words, 8)
        at = np.minimum(np.searchsorted(w, words), max(0, len(w) - 1))
        counts = np.where(w[at] == words, wn[at], 0) if len(w) else np.zeros(len(words), np.int64)
        out.append((batch, shard, counts.astype("<i8").tobytes(), logs[np.searchsorted(distinct, strings)].tobytes()))
    return pd.DataFrame(out, columns=["_batch", "_shard", "counts", "logs"]).astype({"_batch": "int32", "_shard": "int32"})


def _scored(shards: int, folds: int, held: int, n: int, v: int, ends: int, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    names = ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]
    if not len(frame):
        return pd.DataFrame({c: [] for c in names})
    words, raw = tokens_and_bytes(frame["text"])
    docs = len(raw)
    answers = answers.set_index("_shard")
    w = counted(np.concatenate(words))[0]
    strings, owner_of = grams(raw)
    strings <<= np.uint64(24)
    strings |= owner_of.astype(np.uint64)
    strings.sort()  # by string, then document
    text_of = (strings & np.uint64(0xFFFFFF)).astype(np.int64)
    strings >>= np.uint64(24)
    starts = np.flatnonzero(np.append(True, strings[1:] != strings[:-1]))
    g = strings[starts]

    def gathered(values, shard, column, kind):
        out = np.empty(len(values), kind)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in range(shards):
            if cuts[s + 1] > cuts[s]:
                out[order[cuts[s] : cuts[s + 1]]] = np.frombuffer(answers.at[s, column], kind)
        return out

    counts = gathered(w, shard_of_words(w, shards), "counts", "<i8")
    logs = gathered(g, shard_of_grams(g, shards), "logs", "<f4")
    owner = np.repeat(np.arange(docs), [len(x) for x in words])
    count = counts[np.searchsorted(w, np.concatenate(words))]
    base = np.bincount(owner, np.log10(count + 0.5), docs) + np.log10(ends + 0.5)
    n_tokens = np.array([len(x) + 1 for x in words])
    score = np.bincount(text_of, np.repeat(logs, np.diff(np.append(starts, len(strings)))), docs)
    return pd.DataFrame({
        "_id": frame["_id"].to_numpy(), "held_out": ~trained_on(frame["_id"].to_numpy(), folds, held), "n_tokens": n_tokens,
        "n_known": np.bincount(owner, count > 0, docs).astype(np.int64) + (ends > 0), "train_tokens": n,
        "base_score": base - n_tokens * np.log10(n + 0.5 * (v + 1)), "score": score, "n_bytes": [len(t) + 1 for t in raw]})


def text_scores(documents: DataFrame, folds: int = 5, held: int = 1, batch_chars: int = BATCH_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model learns from documents whose crc32(doc_id as text) mod ``folds`` is not ``held`` (a null id is one of them).
    base_score is the smoothed unigram score of words and one end token, from counts of all training texts; score is
    log10 of the probability of the text's bytes and closing byte; bits_per_byte is its code length. Null texts count as
    empty. Without training texts every decision has probability 1/2. Repeated rows count and are scored as often as
    they occur; other columns are ignored.
    """
    docs, total = batched(documents, batch_chars)
    shards = max(1, -(-total // shard_bytes))
    parts = plain(documents).mapInPandas(partial(_count, shards=shards, folds=folds, held=held), COUNTS)
    model = stored(parts.groupBy("_shard").applyInPandas(
        _merge, COUNTS + ", keys array<long>, zeros array<double>, ones array<double>, evidence array<double>, n long, v long"), "language")
    node = F.explode(F.arrays_zip("keys", "zeros", "ones", "evidence")).alias("x")
    rows = model.select(node).groupBy("x.keys").agg(F.sum("x.zeros"), F.sum("x.ones"), F.sum("x.evidence")).collect()
    top = _top([tuple(r) for r in rows])
    n, v = (int(x or 0) for x in model.agg(F.sum("n"), F.sum("v")).first())
    in_training = (F.col("doc_id").isNull() | (F.crc32(F.col("doc_id").cast("string")) % folds != held)).cast("long")
    ends = int(documents.agg(F.sum(in_training)).first()[0] or 0)
    asked = docs.groupBy("_batch").applyInPandas(partial(_ask, shards=shards), "_batch int, _shard int, words binary, grams binary")
    held_model = model.select("_shard", "words", "word_counts", "grams", "gram_counts")
    answers = asked.groupBy("_shard").cogroup(held_model.groupBy("_shard")).applyInPandas(
        lambda asked, model: _answer(top, asked, model), "_batch int, _shard int, counts binary, logs binary")
    scored = docs.groupBy("_batch").cogroup(answers.groupBy("_batch")).applyInPandas(
        lambda frame, answers: _scored(shards, folds, held, n + ends, v + (ends > 0), ends, frame, answers),
        "_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
    return scored.select(restored_id(), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                         (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
