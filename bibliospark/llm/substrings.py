"""Substring deduplication with automata over recurring passages.

A window is 13 consecutive words of one document; it recurs when its word sequence starts in two documents or more.

1. Find. Documents are dealt into batches. Every window of a batch is reduced to a 55-bit key, its smallest document in
   the batch and a bit that says whether several documents of the batch hold it. Keys travel to shards chosen by the
   window's minimizer (the smallest hash among its phrases of four words), packed into one row per batch and shard.
2. Confirm. A shard sorts its keys and sends back, to each batch that can use it, where a recurring window stands in the
   batch's own texts and which document of all is the smallest that holds it.
3. Compile and stream. A batch's recurring windows are known by one place each. The phrases of four words that their
   minimizers name are compiled into an Aho-Corasick automaton over word numbers, and all documents of the batch are
   streamed through it: every occurrence of a recurring window holds such a phrase. Windows around a hit are compared by
   key, and covered words go when the owner is a smaller document.

A batch's automaton holds what its own documents can contain, so every text is streamed once, whatever the corpus size.
"""

from __future__ import annotations

import hashlib
from functools import partial

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import WORD, batched, hash_words, mix, restored_id, rolling

WINDOW, PHRASE = 13, 4
BATCH_CHARS, SHARD_WINDOWS = 3_000_000, 2_000_000


def windows_of(hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of every window, hash of every phrase, place of every window's minimizer phrase) of one document."""
    phrases = rolling(hashes, phrase)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), phrases, np.empty(0, np.int64)
    least, place = phrases[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, window - phrase + 1):
        here = phrases[i : i + n]
        lower = here < least
        np.copyto(least, here, where=lower)
        place[lower] = i
    return rolling(hashes, window) >> np.uint64(9), phrases, place + np.arange(n)


class Batch:
    """The windows of a batch: one entry per key, ordered by shard and key, with the place of its smallest document."""

    def __init__(self, frame: pd.DataFrame, shards: int, window: int, phrase: int):
        frame = frame.sort_values("_id", kind="stable")
        self.ids = frame["_id"].to_numpy(np.int64)
        self.words = [WORD.findall(t) for t in frame["text"]]
        made = [windows_of(hash_words(w), window, phrase) for w in self.words]
        sizes = np.fromiter((len(m[0]) for m in made), np.int64, len(made))
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.keys = np.concatenate([m[0] for m in made])
        self.phrases, self.places = [m[1] for m in made], np.concatenate([m[2] for m in made])
        doc = np.repeat(np.arange(len(made)), sizes)
        order = np.argsort(self.keys, kind="stable")  # documents ascend by id, so the smallest comes first in a key
        keys = self.keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        at = order[starts]
        last = order[np.append(starts[1:], len(keys)) - 1] if len(keys) else at
        least = np.concatenate([m[1][m[2]] for m in made])[at]
        shard = (mix(least) % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)
        by = np.argsort(shard, kind="stable")
        self.entry_shard, self.entry_at, self.entry_key, self.entry_doc = shard[by].astype(np.int64), at[by], keys[starts][by], doc[at][by]
        self.entry_id, self.entry_many = self.ids[self.entry_doc], self.ids[doc[last]][by] != self.ids[self.entry_doc]


def _pack_keys(keys: np.ndarray, many: np.ndarray) -> bytes:
    packed = (keys << np.uint64(1)) | many.astype(np.uint64)
    return np.ascontiguousarray(packed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 7)
    packed = np.zeros((len(raw), 8), np.uint8)
    packed[:, :7] = raw
    packed = packed.view("<u8").ravel()
    return packed >> np.uint64(1), (packed & np.uint64(1)).astype(bool)


def _find(frame: pd.DataFrame, shards: int, window: int, phrase: int) -> pd.DataFrame:
    batch = Batch(frame, shards, window, phrase)
    cuts = np.searchsorted(batch.entry_shard, np.arange(shards + 1))
    used = np.flatnonzero(np.diff(cuts))
    parts = [slice(cuts[s], cuts[s + 1]) for s in used]
    return pd.DataFrame({
        "_batch": np.full(len(used), frame["_batch"].iloc[0], np.int32), "_shard": used.astype(np.int32),
        "keys": [_pack_keys(batch.entry_key[p], batch.entry_many[p]) for p in parts],
        "ids": [batch.entry_id[p].astype("<i8").tobytes() for p in parts]})


def _confirm(frame: pd.DataFrame) -> pd.DataFrame:
    """Back to each batch: the numbers of its entries that recur and could be removed in it, with the owner of each."""
    parts = [_unpack_keys(k) for k in frame["keys"]]
    sizes = np.fromiter((len(k) for k, _ in parts), np.int64, len(parts))
    keys, many = np.concatenate([k for k, _ in parts]), np.concatenate([m for _, m in parts])
    ids = np.concatenate([np.frombuffer(i, "<i8") for i in frame["ids"]])
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)) if len(keys) else np.empty(0, np.int64)
    owner = np.empty(len(keys), np.int64)
    owner[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.append(starts, len(keys)))) if len(keys) else []
    wanted = many | (ids > owner)
    out, at = [], 0
    for batch, shard, size in zip(frame["_batch"], frame["_shard"], sizes, strict=True):
        entries = np.flatnonzero(wanted[at : at + size])
        if len(entries):
            out.append((batch, shard, np.diff(entries, prepend=0).astype("<u4").tobytes(), owner[at : at + size][entries].astype("<i8").tobytes()))
        at += size
    return pd.DataFrame(out, columns=["_batch", "_shard", "entries", "owners"]).astype({"_batch": "int32", "_shard": "int32"})


def automaton(words: list[list[str]], spots: list[tuple[int, int]], phrase: int):
    """(automaton over word numbers, numbers by word): the phrases that start at the given (document, word) places."""
    numbers: dict[str, int] = {}
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for doc, at in spots:
        found.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in words[doc][at : at + phrase]))
    found.make_automaton()
    return found, numbers


def occurrences(search, numbers: dict, words: list[str], places: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Where compiled phrases start in a document, streaming the stretches of words around ``places``."""
    if not len(places):
        return places
    number, hits = numbers.get, []
    cuts = np.flatnonzero(np.diff(places) > window)
    for a, b in zip(places[np.append(0, cuts + 1)].tolist(), places[np.append(cuts, len(places) - 1)].tolist(), strict=True):
        hits += [a + end - phrase + 1 for end, _ in search.iter(tuple([number(w, 0) for w in words[a : b + phrase]]))]
    return np.array(hits, np.int64)


def _locate(shards: int, window: int, phrase: int, texts: bool, frame: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
    n = len(frame)
    if not n:
        return pd.DataFrame({c: [] for c in ("_id", "n_words", "n_removed", "kept_sha256", "removed", "kept")})
    batch = Batch(frame, shards, window, phrase)
    cuts = np.searchsorted(batch.entry_shard, np.arange(shards + 1))
    entries = [np.cumsum(np.frombuffer(e, "<u4").astype(np.int64)) + cuts[s] for s, e in zip(flags["_shard"], flags["entries"], strict=True)]
    entries = np.concatenate(entries) if entries else np.empty(0, np.int64)
    owners = np.concatenate([np.frombuffer(o, "<i8") for o in flags["owners"]]) if len(flags) else np.empty(0, np.int64)
    order = np.argsort(batch.entry_key[entries])
    keys, owners = batch.entry_key[entries][order], owners[order]
    removed = [np.zeros(len(w), bool) for w in batch.words]
    if len(keys):
        spots = sorted(set(zip(batch.entry_doc[entries].tolist(), batch.places[batch.entry_at[entries]].tolist(), strict=True)))
        search, numbers = automaton(batch.words, spots, phrase)
        possible = np.zeros(1 << 22, bool)  # phrase hashes that no compiled phrase has need no automaton
        possible[(np.array([batch.phrases[d][p] for d, p in spots]) >> np.uint64(42)).astype(np.int64)] = True
        for i, words in enumerate(batch.words):
            count = len(words) - window + 1
            if count <= 0:
                continue
            hits = occurrences(search, numbers, words, np.flatnonzero(possible[(batch.phrases[i] >> np.uint64(42)).astype(np.int64)]), window, phrase)
            if not len(hits):
                continue
            edges = np.zeros(count + 1, np.int32)  # windows that hold a hit whole
            np.add.at(edges, np.maximum(hits - (window - phrase), 0), 1)
            np.add.at(edges, np.minimum(hits + 1, count), -1)
            near = np.flatnonzero(np.cumsum(edges)[:count] > 0)
            own = batch.keys[batch.bounds[i] + near]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            near = near[(keys[at] == own) & (owners[at] < batch.ids[i])]
            edges = np.zeros(len(words) + 1, np.int32)
            np.add.at(edges, near, 1)
            np.add.at(edges, near + window, -1)
            removed[i] = np.cumsum(edges)[:-1] > 0
    kept = [" ".join(w if not gone.any() else [x for x, g in zip(w, gone, strict=True) if not g]) for w, gone in zip(batch.words, removed, strict=True)]
    return pd.DataFrame({
        "_id": batch.ids, "n_words": [len(w) for w in batch.words], "n_removed": [int(g.sum()) for g in removed],
        "kept_sha256": [hashlib.sha256(k.encode("utf-8", "surrogatepass")).hexdigest() for k in kept],
        "removed": [spans(g) for g in removed], "kept": kept if texts else None})


def spans(mask: np.ndarray) -> list[list[int]]:
    """[start, end) of the runs of True."""
    edges = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], 1).tolist()


def without_repeats(documents: DataFrame, window: int = WINDOW, phrase: int = PHRASE, batch_chars: int = BATCH_CHARS, shard_windows: int = SHARD_WINDOWS, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, removed (word spans [start, end)), kept (text; null
    when ``texts`` is off).

    A word goes when a window over it has a word sequence that also starts in a document with a smaller id. Windows are
    judged on the input. Texts of fewer than ``window`` words, empty and null ones lose nothing. Rows that share an id
    are one document and keep each other's words; a null id counts as larger than all others, and two null ids as one
    document. Repeated rows give repeated results; other columns are ignored.
    """
    docs, total = batched(documents, batch_chars)
    shards = max(1, -(-total // (6 * shard_windows)))
    found = docs.groupBy("_batch").applyInPandas(partial(_find, shards=shards, window=window, phrase=phrase), "_batch int, _shard int, keys binary, ids binary")
    flags = found.groupBy("_shard").applyInPandas(_confirm, "_batch int, _shard int, entries binary, owners binary")
    located = docs.groupBy("_batch").cogroup(flags.groupBy("_batch")).applyInPandas(
        lambda frame, flags: _locate(shards, window, phrase, texts, frame, flags),
        "_id long, n_words long, n_removed long, kept_sha256 string, removed array<array<int>>, kept string")
    return located.select(restored_id(), "n_words", "n_removed", "kept_sha256", "removed", "kept")
