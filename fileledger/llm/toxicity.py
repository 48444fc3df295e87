"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is a row of words (ASCII punctuation and space separate them).  A word's
input is a hashed word embedding beside the mean of hashed character trigram
embeddings.  Windows of WINDOW words that overlap by half (one each STRIDE words) are read
in both directions, pooled by attention and scored; a document's score is a calibrated
function of its highest window.  A window at every word would cost WINDOW states a word and
direction in place of two.

Labels come from rows outside the held-out fold only, and are a bounded sample (BOUNDS).
An id with several labels is toxic if one says so.  Label, language, source and id are no inputs of a score.

Rules.  Null text counts as empty; texts without a word get the share of toxic
rows in the sample, at most 0.29; whole texts are scored whatever their length;
equal texts get equal scores; without labelled rows of both kinds every score is
0.  An empty table gives an empty table; extra columns are not read.  A null id is outside
the held-out fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.llm.kernel import Slice, ragged, slices, split_words
from fileledger.llm.labelled import SampleBounds, held_out, labelled_sample

WINDOW, STRIDE = 32, 16
WORDS, WORD_DIM, TRIGRAMS, CHAR_DIM = 1 << 15, 12, 1 << 12, 8
HIDDEN, ATTENTION = 8, 8
EPOCHS, LEAST_STEPS, BATCH, RATE = 3, 150, 128, 0.02
BOUNDS = SampleBounds(positive=1500, negative=3000, text_bytes=200_000, total_bytes=16 << 20)
THRESHOLD = 0.3
#: Share of documents, and least number, that must have a word for it to have an embedding of its own; pull of word shares to their mean.
MET_SHARE, MET_LEAST, PRIOR = 0.004, 3, 20.0

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[b for b in range(128) if not chr(b).isalnum()]] = True


@dataclass
class WindowSet:
    """Distinct words (hash, word bucket, trigram buckets by word) and windows of indices into them, -1 where a text ends."""

    hash: np.ndarray
    bucket: np.ndarray
    trigrams: np.ndarray
    by_word: np.ndarray
    windows: np.ndarray
    doc: np.ndarray


def windows_of(piece: Slice) -> WindowSet:
    words = split_words(piece, fold_case=True, separators=_SEPARATORS)
    _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    n = words.end[first] - words.start[first]
    lower = piece.data.astype(np.uint32)
    lower[(lower >= 65) & (lower <= 90)] += 32
    padded = np.concatenate([lower, np.zeros(2, np.uint32)])
    at = ragged(words.start[first], n)
    left = np.repeat(n, n) - (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n))
    tri = padded[at] * 0x9E3779B1 + np.where(left > 1, padded[at + 1], 1) * 0x85EBCA77 + np.where(left > 2, padded[at + 2], 2) * 0xC2B2AE3D
    tri = ((tri.astype(np.uint64) & 0xFFFFFFFF) >> np.uint64(12)).astype(np.int64) % TRIGRAMS

    count = np.diff(words.by_doc)
    per_doc = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), per_doc)
    k = ragged(np.zeros(len(count), np.int64), per_doc)
    begin = np.minimum(k * STRIDE, np.maximum(count[doc] - WINDOW, 0))
    index = begin[:, None] + np.arange(WINDOW)
    inside = index < count[doc][:, None]
    flat = np.append(which.astype(np.int32), -1)
    windows = flat[np.where(inside, index + words.by_doc[doc][:, None], len(which))]
    return WindowSet(words.hash[first], (words.hash[first] >> np.uint64(20)).astype(np.int64) % WORDS, tri, np.concatenate([[0], np.cumsum(n)]), windows, doc)


def windows_of_all(texts: list[str]) -> WindowSet:
    """The windows of all texts, made slice by slice, over the words that are distinct among all."""
    parts, words, grams = [], 0, 0
    for piece in slices(pa.array(texts, pa.large_string())):
        s = windows_of(piece)
        parts.append((s.hash, s.bucket, s.trigrams.astype(np.int32), s.by_word[:-1] + grams, np.where(s.windows >= 0, s.windows + np.int32(words), np.int32(-1)), s.doc + piece.first))
        words += len(s.bucket)
        grams += len(s.trigrams)
    every, bucket, trigrams, begin, windows, doc = (np.concatenate(x) for x in zip(*parts))
    length = np.diff(np.append(begin, grams))
    named, first, which = np.unique(every, return_index=True, return_inverse=True)
    flat = np.append(which.astype(np.int32), np.int32(-1))
    return WindowSet(named, bucket[first], trigrams[ragged(begin[first], length[first])], np.concatenate([[0], np.cumsum(length[first])]), flat[windows], doc)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums_by(key: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by key 0..n-1; rows of other keys are left out."""
    order = np.argsort(key, kind="stable")
    order = order[np.searchsorted(key[order], 0) :]
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(order):
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        out[key[order[first]]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Network:
    def __init__(self, log_odds: np.ndarray, known: np.ndarray, seed: int = 3):
        self.unknown = ~known
        rng = np.random.default_rng(seed)
        d, h, a = WORD_DIM + CHAR_DIM, HIDDEN, ATTENTION
        make = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        word = make(WORDS, WORD_DIM, scale=0.05)
        word[:, 0] = log_odds / 2.0
        word[self.unknown] = 0
        self.p = {"word": word, "char": make(TRIGRAMS, CHAR_DIM, scale=0.05), "wa": make(2 * h, a, scale=0.3), "va": make(a, scale=0.3), "wo": make(2 * h, scale=0.3), "bo": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"w{way}": make(d, 3 * h, scale=0.3), f"u{way}": make(h, 3 * h, scale=0.3), f"b{way}": np.zeros(3 * h, np.float32)}

    def inputs(self, s: WindowSet) -> np.ndarray:
        chars = np.add.reduceat(self.p["char"][s.trigrams], s.by_word[:-1], axis=0) / np.diff(s.by_word)[:, None].astype(np.float32) if len(s.bucket) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][s.bucket], chars], axis=1)

    def _read(self, way: str, gates: np.ndarray, windows: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        h, u = HIDDEN, self.p[f"u{way}"]
        state = np.zeros((len(windows), h), np.float32)
        out = np.empty((WINDOW, len(windows), h), np.float32)
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            g, m = np.take(gates, windows[:, t], axis=0, mode="wrap"), mask[:, t : t + 1]
            hu = state @ u
            zr = _sigmoid(g[:, : 2 * h] + hu[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = 2 * _sigmoid(2 * (g[:, 2 * h :] + r * hu[:, 2 * h :])) - 1
            if keep is not None:
                keep.append((t, state, z, r, n, hu[:, 2 * h :], m))
            state = state + m * (1 - z) * (n - state)
            out[t] = state
        return out

    def forward(self, x: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows over word inputs x."""
        mask = (windows >= 0).astype(np.float32)
        both = []
        for way in "fb":
            gates = x @ self.p[f"w{way}"] + self.p[f"b{way}"]
            steps = None if keep is None else keep.setdefault(way, [])
            both.append(self._read(way, np.concatenate([gates, np.zeros((1, gates.shape[1]), np.float32)]), windows, mask, steps))
        hidden = np.concatenate(both, axis=2)
        inner = np.tanh(hidden @ self.p["wa"])
        energy = inner @ self.p["va"] + (mask.T - 1) * 1e9
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, hidden)
        if keep is not None:
            keep |= {"hidden": hidden, "inner": inner, "weight": weight, "pooled": pooled}
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def gradients(self, s: WindowSet, windows: np.ndarray, target: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over windows."""
        used, local = np.unique(windows, return_inverse=True)
        local = local.reshape(windows.shape).astype(np.int32)
        if used[0] < 0:
            used, local = used[1:], local - 1
        lengths = np.diff(s.by_word)[used]
        trigrams = s.trigrams[ragged(s.by_word[used], lengths)]
        part = WindowSet(s.hash[used], s.bucket[used], trigrams, np.concatenate([[0], np.cumsum(lengths)]), local, s.doc)
        x, keep = self.inputs(part), {}
        logit = self.forward(x, local, keep)
        h = HIDDEN
        d_logit = (_sigmoid(logit) - target) * importance / len(windows)
        g = {"wo": keep["pooled"].T @ d_logit, "bo": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["wo"]
        d_hidden = keep["weight"][:, :, None] * d_pooled
        d_weight = np.einsum("tnh,nh->tn", keep["hidden"], d_pooled)
        d_energy = keep["weight"] * (d_weight - (keep["weight"] * d_weight).sum(axis=0))
        g["va"] = np.einsum("tna,tn->a", keep["inner"], d_energy)
        d_inner = d_energy[:, :, None] * self.p["va"] * (1 - keep["inner"] ** 2)
        g["wa"] = np.einsum("tnh,tna->ha", keep["hidden"], d_inner)
        d_hidden += d_inner @ self.p["wa"].T
        d_x = np.zeros_like(x)
        for way, cols in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u = self.p[f"u{way}"]
            d_u, all_gates = np.zeros_like(u), np.empty((WINDOW, len(local), 3 * h), np.float32)
            d_state = np.zeros((len(local), h), np.float32)
            for t, before, z, r, n, hn, m in reversed(keep[way]):
                d_state = d_state + d_hidden[t][:, cols]
                d = d_state * m
                dn = d * (1 - z) * (1 - n * n)
                dz = d * (before - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                d_hu = np.concatenate([dz, dr, dn * r], axis=1)
                all_gates[t] = np.concatenate([dz, dr, dn], axis=1)
                d_u += before.T @ d_hu
                d_state = d_state * (1 - m) + d * z + d_hu @ u.T
            d_gates = _sums_by(local.T.ravel(), all_gates.reshape(-1, 3 * h), len(x))
            g |= {f"u{way}": d_u, f"w{way}": x.T @ d_gates, f"b{way}": d_gates.sum(axis=0)}
            d_x += d_gates @ self.p[f"w{way}"].T
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], part.bucket, d_x[:, :WORD_DIM])
        g["word"][self.unknown] = 0
        g["char"] = _sums_by(trigrams, np.repeat(d_x[:, WORD_DIM:] / lengths[:, None].astype(np.float32), lengths, axis=0), TRIGRAMS)
        return g

    def window_logits(self, s: WindowSet, at_once: int = 4096) -> np.ndarray:
        x = self.inputs(s)
        return np.concatenate([self.forward(x, s.windows[i : i + at_once]) for i in range(0, len(s.windows), at_once)]) if len(s.windows) else np.zeros(0, np.float32)


@dataclass
class Model:
    network: Network
    slope: float
    offset: float
    empty: float

    def scores(self, piece: Slice) -> np.ndarray:
        s = windows_of(piece)
        best = np.full(len(piece), -np.inf)
        np.maximum.at(best, s.doc, self.network.window_logits(s))
        with np.errstate(over="ignore"):
            return np.where(np.isinf(best), self.empty, 1 / (1 + np.exp(-(self.slope * np.nan_to_num(best, neginf=0) + self.offset))))


def _log_odds(s: WindowSet, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log ratio of the shares of toxic and other documents that have a word of the bucket; whether enough documents have it."""
    seen = s.windows >= 0
    pairs = np.unique(np.repeat(s.doc, seen.sum(axis=1)).astype(np.int64) * WORDS + s.bucket[s.windows[seen]])
    pairs = pairs[labels[pairs // WORDS] >= 0]
    doc, bucket = pairs // WORDS, pairs % WORDS
    of = [np.bincount(bucket[labels[doc] == y], minlength=WORDS) for y in (1, 0)]
    total = [max(1, (labels == y).sum()) for y in (1, 0)]
    base = (of[0] + of[1]) / sum(total)
    share = [(of[k] + PRIOR * (base + 0.005)) / (total[k] + PRIOR) for k in (0, 1)]
    known = of[0] + of[1] >= max(MET_LEAST, MET_SHARE * sum(total))
    return np.where(known, np.clip(np.log(share[0] / share[1]), -1, 4), 0).astype(np.float32), known


def train(texts: list[str], labels: np.ndarray, seed: int = 9) -> Model | None:
    """Fits on windows: of a toxic document the likeliest one, of others the likeliest and a random one; then calibrates on a fifth kept aside."""
    labels = np.asarray(labels).astype(np.int64)
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    s = windows_of_all(texts)
    aside = rng.random(len(labels)) < 0.2
    for y in (0, 1):
        if aside[labels == y].all() or not aside[labels == y].any():
            aside[:] = False
    fit_labels = np.where(aside, -1, labels)
    net = Network(*_log_odds(s, fit_labels))
    odds = np.append(net.p["word"][s.bucket, 0], 0)[s.windows]
    logits = np.maximum(odds, 0).sum(axis=1)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    rows = np.flatnonzero(~aside[s.doc])
    share = max(1, int((fit_labels == 0).sum() / max(1, (fit_labels == 1).sum())))
    documents = len(np.unique(s.doc[rows]))
    epochs = max(EPOCHS, LEAST_STEPS * BATCH // max(BATCH, 2 * documents))
    for epoch in range(epochs):
        if epoch:
            logits = net.window_logits(s)
        order = rows[np.lexsort((-logits[rows], s.doc[rows]))]
        top = order[np.unique(s.doc[order], return_index=True)[1]]
        negative = rows[labels[s.doc[rows]] == 0]
        some = rng.choice(negative, min(len(negative), len(top)), replace=False)
        batchable = np.concatenate([top, some])
        rng.shuffle(batchable)
        for i in range(0, len(batchable), BATCH):
            w = batchable[i : i + BATCH]
            y = labels[s.doc[w]].astype(np.float32)
            g = net.gradients(s, s.windows[w], y, np.where(y == 1, min(share, 4), 1).astype(np.float32))
            step += 1
            for k, v in net.p.items():
                m = moment[k]
                m[0] = 0.9 * m[0] + 0.1 * g[k]
                m[1] = 0.99 * m[1] + 0.01 * g[k] ** 2
                v -= (RATE * (1 - epoch / epochs) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    best = np.full(len(labels), -np.inf)
    np.maximum.at(best, s.doc, net.window_logits(s))
    use = (aside if aside.any() else np.ones(len(labels), bool)) & ~np.isinf(best)
    slope, offset = _calibrate(best[use], labels[use])
    return Model(net, slope, offset, float(min(0.29, labels.mean())))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and offset of a logistic curve, by Newton steps with a slight pull to (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        grad = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        hess = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        move = np.linalg.solve(hess, grad)
        a, b = max(0.05, a - move[0]), b - move[1]
        if np.abs(move).max() < 1e-7:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    return train(*labelled_sample(docs, labels, label_col, BOUNDS, id_col, text_col, highest=True))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id_col, held_out, score, predicted) of every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = model.value
            parts = [m.scores(p) if m else np.zeros(len(p)) for p in slices(b.column(1))]
            if parts:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts))], names=[id_col, "score"])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    scored = slim.mapInArrow(run, f"`{id_col}` {slim.dtypes[0][1]}, score double")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
