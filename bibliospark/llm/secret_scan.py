"""Secret scan: three fixed patterns, plus a character convolutional network over every candidate and its context.

A candidate is a maximal run of at least 12 of A-Za-z0-9+/_.=-, with or without a digit. The network reads
windows of 40 characters of the candidate (all of them, 20 apart) with 12 characters of context on either side. It is
trained in numpy on labelled findings, its logits are calibrated on findings kept aside, and the threshold is the
largest calibrated probability that keeps the wanted recall on them. Spans of the patterns always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import plain, restored_id

# The patterns of the three kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "cnn")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
MARKED = re.compile(r"[0-9+/=]")
BODY, STEP, CONTEXT = 40, 20, 12
LENGTH = BODY + 2 * CONTEXT
SHAPE = {"embed": (128, 8), "conv": (5 * 8, 16), "bias": (16,), "dense": (32,), "out": (1,)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns; matches that are too short are dropped after matching."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate in pieces with their context, padded with NUL to one length."""
    out = []
    for a in range(start, max(start + 1, end - STEP), STEP):
        b = min(a + BODY, end)
        before = text[max(0, a - CONTEXT) : a].rjust(CONTEXT, "\0")
        out.append(before + text[a:b].ljust(BODY, "\0") + text[b : b + CONTEXT].ljust(CONTEXT, "\0"))
    return out


def codes(pieces: list[str]) -> np.ndarray:
    raw = "".join(pieces).encode("ascii", "replace").replace(b"\x7f", b"?")
    return np.frombuffer(raw, np.uint8).reshape(len(pieces), LENGTH).astype(np.int64)


def forward(weights: dict, x: np.ndarray) -> tuple:
    e = weights["embed"][x]
    view = np.lib.stride_tricks.sliding_window_view(e, 5, axis=1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - 4, -1)
    z = view @ weights["conv"] + weights["bias"]
    h = np.maximum(z, 0)
    top = h.argmax(1)
    pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], 1)
    return view, z, top, pooled, pooled @ weights["dense"] + weights["out"]


def gradients(weights: dict, x: np.ndarray, y: np.ndarray) -> dict:
    view, z, top, pooled, logit = forward(weights, x)
    d = (1 / (1 + np.exp(-logit)) - y) / len(y)
    dp = d[:, None] * weights["dense"]
    filters = z.shape[2]
    dh = np.repeat(dp[:, None, filters:] / z.shape[1], z.shape[1], 1)
    rows, cols = np.indices(top.shape)
    dh[rows, top, cols] += dp[:, :filters]
    dz = dh * (z > 0)
    dv = (dz @ weights["conv"].T).reshape(len(x), z.shape[1], 5, -1)
    de = np.zeros(weights["embed"].shape)
    for k in range(5):
        np.add.at(de, x[:, k : k + z.shape[1]], dv[:, :, k])
    return {"embed": de, "conv": np.tensordot(view, dz, ([0, 1], [0, 1])), "bias": dz.sum((0, 1)), "dense": pooled.T @ d, "out": d.sum(keepdims=True)}


def train(pieces: list[str], labels: list[int], recall: float, epochs: int = 12, seed: int = 7) -> dict | None:
    """Weights, calibration (slope, offset) and threshold; None when either label is rarer than 8 findings.

    Half of the training windows lose their context, so a secret is known by its own characters too. Every fourth
    finding (in the given order) is kept aside for calibration and threshold.
    """
    y = np.array(labels, float)
    if min(y.sum(), len(y) - y.sum()) < 8:
        return None
    rng = np.random.default_rng(seed)
    x = codes(pieces)
    aside = np.zeros(len(y), bool)
    for value in (0.0, 1.0):  # both labels on both sides
        aside[np.flatnonzero(y == value)[::4]] = True
    weights = {k: rng.normal(0, 0.5 if k == "embed" else np.prod(s[:1]) ** -0.5, s) if k not in ("bias", "out") else np.zeros(s) for k, s in SHAPE.items()}
    first = {k: np.zeros(s) for k, s in SHAPE.items()}
    second = {k: np.zeros(s) for k, s in SHAPE.items()}
    tx, ty = x[~aside], y[~aside]
    step = 0
    for _ in range(max(epochs, 600 // max(1, len(ty) // 64))):
        order = rng.permutation(len(ty))
        for part in np.array_split(order, max(1, len(ty) // 64)):
            batch = tx[part].copy()
            bare = rng.random(len(part)) < 0.5
            batch[np.ix_(bare, np.r_[0:CONTEXT, CONTEXT + BODY : LENGTH])] = 0
            grads, step = gradients(weights, batch, ty[part]), step + 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    logit, ay = forward(weights, x[aside])[-1], y[aside]
    slope, offset = 1.0, 0.0
    target = np.where(ay == 1, (ay.sum() + 1) / (ay.sum() + 2), 1 / (len(ay) - ay.sum() + 2))
    for _ in range(50):  # Newton steps of logistic calibration
        p = 1 / (1 + np.exp(-np.clip(slope * logit + offset, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[np.sum(w * logit**2) + 1e-3, np.sum(w * logit)], [np.sum(w * logit), np.sum(w) + 1e-3]])
        move = np.linalg.solve(hessian, [np.sum((p - target) * logit) + 1e-3 * (slope - 1), np.sum(p - target) + 1e-3 * offset])
        slope, offset = slope - move[0], offset - move[1]
    model = {"weights": weights, "slope": slope, "offset": offset, "threshold": 0.0}
    scores = np.sort(probability(model, pieces)[aside][ay == 1])
    return model | {"threshold": float(scores[int((1 - recall) * len(scores))])}


def probability(model: dict, pieces: list[str]) -> np.ndarray:
    out = [forward(model["weights"], codes(pieces[i : i + 2048]))[-1] for i in range(0, len(pieces), 2048)]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * np.concatenate(out) + model["offset"], -35, 35))) if out else np.empty(0)


def labelled_by_patterns(documents: DataFrame, sampled: int = 20_000, findings: int = 4_096) -> DataFrame:
    """(piece, label) findings to train on, from at most ``sampled`` documents and at most ``findings`` rows.

    A candidate that the fixed patterns touch is labelled 1, any other 0. Half of the findings may have label 1, a quarter
    each may be other candidates with and without a digit or one of +/=, so plain words do not crowd out the rest. All
    bounds choose by a hash, so the sample is the same in every run. Only the first window of a candidate is a finding;
    scans read all of them.
    """
    ids = documents.select(F.col("doc_id").alias("_sampled")).filter("doc_id is not null").distinct().orderBy(F.xxhash64("_sampled"), "_sampled").limit(sampled)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame["text"]:
                spans = base_spans(text)
                out += [(windows(text, a, b)[0], int(any(s < b and a < e for s, e, _ in spans)), MARKED.search(text, a, b) is not None) for a, b in candidates(text)]
            yield pd.DataFrame(out, columns=["piece", "label", "marked"])

    docs = documents.filter(F.length("text") > 0).select("doc_id", "text")
    found = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_sampled"), "left_semi").select("text").mapInPandas(run, "piece string, label int, marked boolean")
    parts = [("label = 1", findings // 2), ("label = 0 and marked", findings // 4), ("label = 0 and not marked", findings // 4)]
    chosen = [found.filter(which).select("piece", "label").orderBy(F.xxhash64("piece"), "piece").limit(most) for which, most in parts]
    return chosen[0].unionByName(chosen[1]).unionByName(chosen[2])


def secret_spans(documents: DataFrame, findings: DataFrame, recall: float = 0.99) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_cnn, base_sha256, spans (kind:start:end, comma-joined).

    findings(piece, label): labelled windows, a bounded sample (see ``labelled_by_patterns``). The network adds
    candidates that no pattern touches and whose best window reaches the threshold; with too few findings of either
    label it adds none. Null texts count as empty. Repeated rows give repeated results; other columns are ignored.
    """
    rows = findings.select("piece", "label").collect()
    model = train([r.piece for r in rows], [r.label for r in rows], recall)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            based, pieces, places = [], [], []
            for i, text in enumerate(frame["text"]):
                spans = base_spans(text)
                based.append(spans)
                for a, b in candidates(text) if model else ():
                    if not any(s < b and a < e for s, e, _ in spans):
                        cut = windows(text, a, b)
                        pieces += cut
                        places += [(i, a, b)] * len(cut)
            once = {piece: k for k, piece in enumerate(dict.fromkeys(pieces))}
            scores = probability(model, list(once)) if model else []
            added = {p for p, piece in zip(places, pieces, strict=True) if scores[once[piece]] >= model["threshold"]}
            both = [list(s) for s in based]
            for i, a, b in added:
                both[i].append((a, b, 3))
            say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))
            count = lambda kind: [sum(k == kind for _, _, k in spans) for spans in both]
            yield pd.DataFrame({
                "_id": frame["_id"], "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "n_cnn": count(3),
                "base_sha256": [hashlib.sha256(say(s).encode()).hexdigest() for s in based], "spans": [say(s) for s in both]})

    scanned = plain(documents).mapInPandas(run, "_id long, n_assign long, n_access long, n_hex long, n_cnn long, base_sha256 string, spans string")
    return scanned.select(restored_id(), "n_assign", "n_access", "n_hex", "n_cnn", "base_sha256", "spans")
