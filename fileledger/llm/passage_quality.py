"""Quality of documents by attention over their passages (multiple-instance learning), trained in numpy.

A text is cut into passages of about PASSAGE words.  A passage's features are shares of
pairs of neighbouring byte classes, statistics of its words (different ones, repeats next to each other,
runs met before in the document, lengths), and the mean of hashed word embeddings; a layer
encodes them.  Gated attention, tanh of one projection times the sigmoid of another, weighs
the passages of a document, and the weighted sum of their codes is scored.  Only the document has a
label: which passages make it good or bad is what the attention learns.

Labels come from rows outside the held-out fold only, and are a bounded sample (BOUNDS).
Label, language, source and id are no inputs of a score.

Rules.  Null text counts as empty; texts without a word get the share of good rows in the
sample (below THRESHOLD: an empty text is no good document); whole texts are
scored whatever their length; equal texts get equal scores (rounded to six digits, as products of matrices differ in the last bits); without labelled rows of
both kinds every score is 0.  An empty table gives an empty table; extra columns are not
read.  A null id is outside the held-out fold, and labels of a null id are not used.
An id with several labels trains by the lowest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.llm.kernel import Slice, ragged, shingles, slices, split_words
from fileledger.llm.labelled import SampleBounds, held_out, labelled_sample

PASSAGE, RUN = 32, 4
WORDS, WORD_DIM = 1 << 13, 8
HIDDEN, ATTENTION = 24, 12
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 10, 300, 64, 0.01, 1e-4
BOUNDS = SampleBounds(positive=3000, negative=1500, text_bytes=200_000, total_bytes=12 << 20)
THRESHOLD = 0.7
#: Documents that must have a word of a bucket for it to be embedded.
MET_LEAST = 5

#: Classes of bytes; a byte that no line names is of the last class.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "!?", "\"'()-", "#*$%&|<>@^~=+_\\/`{}[]"]
_CLASS = np.full(256, len(_CLASSES) + 2, np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0x80:0xC0], _CLASS[0xC0:] = len(_CLASSES), len(_CLASSES) + 1
_KINDS = len(_CLASSES) + 3
STATISTICS = 7
FIXED = _KINDS * _KINDS + STATISTICS
_SMALL = 1 << 20


@dataclass
class Passages:
    """Fixed features by passage, the buckets of their words (first_word[i]:first_word[i+1]), and passages by document."""

    fixed: np.ndarray
    bucket: np.ndarray
    first_word: np.ndarray
    by_doc: np.ndarray

    def of(self, docs: np.ndarray) -> Passages:
        n = np.diff(self.by_doc)[docs]
        p = ragged(self.by_doc[docs], n)
        words = np.diff(self.first_word)[p]
        return Passages(self.fixed[p], self.bucket[ragged(self.first_word[p], words)], np.concatenate([[0], np.cumsum(words)]), np.concatenate([[0], np.cumsum(n)]))


def _class_pairs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Square roots of the shares of pairs of byte classes, by passage: pairs whose first byte is in start[i]:end[i]."""
    n = len(start)
    out = np.zeros((n, _KINDS * _KINDS), np.float32)
    for at in range(0, n, 4096):
        # A stretch of passages at a time; a very long passage is read in parts.
        last = min(n, at + 4096)
        for low in range(int(start[at]), int(end[last - 1]), _SMALL):
            high = min(low + _SMALL, int(end[last - 1]))
            kinds = _CLASS[data[low : high + 1]]
            place = np.arange(low, high)
            of = np.searchsorted(start[at:last], place, side="right") - 1
            inside = place < end[at + of]
            out[at:last] += np.bincount((of * (_KINDS * _KINDS) + kinds[:-1] * _KINDS + kinds[1:])[inside], minlength=(last - at) * _KINDS * _KINDS).reshape(last - at, -1)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))


def passages_of(piece: Slice) -> Passages:
    words = split_words(piece, fold_case=True)
    count = np.diff(words.by_doc)
    n = np.where(count > 0, np.maximum(1, (count + PASSAGE // 2) // PASSAGE), 0)
    doc = np.repeat(np.arange(len(n)), n)
    k = ragged(np.zeros(len(n), np.int64), n)
    first = words.by_doc[doc] + k * count[doc] // np.maximum(n[doc], 1)
    first_word = np.append(first, len(words.hash))
    total = np.diff(first_word)
    if not len(first):
        return Passages(np.zeros((0, FIXED), np.float32), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(len(n) + 1, np.int64))
    passage = np.repeat(np.arange(len(first)), total)
    by = lambda x: np.bincount(passage, x, len(first)) / total
    length = (words.end - words.start).astype(np.float64)
    order = np.lexsort((words.hash, passage))
    new = np.ones(len(order), bool)
    new[1:] = (words.hash[order[1:]] != words.hash[order[:-1]]) | (passage[order[1:]] != passage[order[:-1]])
    again = np.zeros(len(passage))
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    run, owner = shingles(words, len(n), RUN, False)
    met = np.zeros(len(passage))
    if len(run):
        ranked = np.lexsort((np.arange(len(run)), run, owner))
        seen = np.zeros(len(run), bool)
        seen[ranked[1:]] = (run[ranked[1:]] == run[ranked[:-1]]) & (owner[ranked[1:]] == owner[ranked[:-1]])
        starts = np.arange(len(words.hash) - RUN + 1)
        met[starts[words.doc[starts] == words.doc[starts + RUN - 1]]] = seen
    stats = np.stack([np.bincount(passage[order[new]], minlength=len(first)) / total, by(again), by(met), by(np.minimum(length, 40)) / 10, by(length > 20), by(length == 1), np.log1p(total) / 4], axis=1)
    # A passage's pairs begin before the next one's first word and end with its document.
    start = words.start[first]
    last = piece.bounds[1:][doc] - 1
    end = np.where(np.append(doc[1:] == doc[:-1], False), np.append(start[1:], 0), last)
    pairs = _class_pairs(piece.data, start, end)
    bucket = (words.hash >> np.uint64(24)).astype(np.int64) % WORDS
    return Passages(np.concatenate([pairs, stats.astype(np.float32)], axis=1), bucket, first_word, np.concatenate([[0], np.cumsum(n)]))


def passages_of_all(texts: list[str]) -> Passages:
    parts = [passages_of(p) for p in slices(pa.array(texts, pa.large_string()))]
    words, passages = np.cumsum([0] + [len(p.bucket) for p in parts]), np.cumsum([0] + [len(p.fixed) for p in parts])
    return Passages(
        np.concatenate([p.fixed for p in parts]),
        np.concatenate([p.bucket for p in parts]),
        np.concatenate([[0], *(p.first_word[1:] + w for p, w in zip(parts, words))]),
        np.concatenate([[0], *(p.by_doc[1:] + k for p, k in zip(parts, passages))]),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, centre: np.ndarray, spread: np.ndarray, known: np.ndarray, seed: int = 5):
        self.centre, self.spread, self.known = centre, spread, known
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        h, a = HIDDEN, ATTENTION
        self.p = {"word": np.zeros((WORDS, WORD_DIM), np.float32), "w": make(FIXED + WORD_DIM, h), "b": np.zeros(h, np.float32), "v": make(h, a), "u": make(h, a), "q": make(a), "o": make(h), "c": np.zeros(1, np.float32)}

    def forward(self, s: Passages, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Logits of documents, all of which have a passage, and the attention of their passages."""
        p = self.p
        words = np.diff(s.first_word)[:, None].astype(np.float32)
        x = np.concatenate([(s.fixed - self.centre) / self.spread, np.add.reduceat(p["word"][s.bucket], s.first_word[:-1], axis=0) / words], axis=1)
        code = np.tanh(x @ p["w"] + p["b"])
        way, gate = np.tanh(code @ p["v"]), _sigmoid(code @ p["u"])
        energy = (way * gate) @ p["q"]
        first, n = s.by_doc[:-1], np.diff(s.by_doc)
        weight = np.exp(energy - np.repeat(np.maximum.reduceat(energy, first), n))
        weight /= np.repeat(np.add.reduceat(weight, first), n)
        pooled = np.add.reduceat(weight[:, None] * code, first, axis=0)
        if keep is not None:
            keep |= {"x": x, "code": code, "way": way, "gate": gate, "weight": weight, "pooled": pooled, "words": words}
        return pooled @ p["o"] + p["c"][0], weight

    def gradients(self, s: Passages, target: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over documents."""
        p, keep = self.p, {}
        logit, weight = self.forward(s, keep)
        n = np.diff(s.by_doc)
        code, way, gate = keep["code"], keep["way"], keep["gate"]
        d_logit = ((_sigmoid(logit) - target) * importance / len(n)).astype(np.float32)
        g = {"o": keep["pooled"].T @ d_logit, "c": d_logit.sum(keepdims=True)}
        d_pooled = np.repeat(d_logit[:, None] * p["o"], n, axis=0)
        d_weight = (code * d_pooled).sum(axis=1)
        d_energy = weight * (d_weight - np.repeat(np.add.reduceat(weight * d_weight, s.by_doc[:-1]), n))
        g["q"] = (way * gate).T @ d_energy
        d_both = d_energy[:, None] * p["q"]
        d_way, d_gate = d_both * gate * (1 - way**2), d_both * way * gate * (1 - gate)
        g["v"], g["u"] = code.T @ d_way, code.T @ d_gate
        d_code = (weight[:, None] * d_pooled + d_way @ p["v"].T + d_gate @ p["u"].T) * (1 - code**2)
        g["w"], g["b"] = keep["x"].T @ d_code, d_code.sum(axis=0)
        d_words = np.repeat(d_code @ p["w"][FIXED:].T / keep["words"], np.diff(s.first_word), axis=0)
        g["word"] = np.stack([np.bincount(s.bucket, d_words[:, i], WORDS) for i in range(WORD_DIM)], axis=1).astype(np.float32)
        g["word"][~self.known] = 0
        return g


@dataclass
class Model:
    network: Network
    slope: float
    offset: float
    empty: float

    def scores(self, s: Passages) -> np.ndarray:
        out = np.full(len(s.by_doc) - 1, self.empty)
        some = np.flatnonzero(np.diff(s.by_doc))
        if len(some):
            out[some] = _sigmoid(self.slope * self.network.forward(s.of(some))[0].astype(np.float64) + self.offset)
        return out.round(6)


def train(texts: list[str], good: np.ndarray, seed: int = 7) -> Model | None:
    """Fits on four fifths of the documents and calibrates on the rest."""
    if not len(good) or good.all() or not good.any():
        return None
    s = passages_of_all(texts)
    some = np.flatnonzero(np.diff(s.by_doc))
    y = np.asarray(good)[some].astype(np.float32)
    if not len(y) or y.min() == y.max():
        return None
    s = s.of(some)
    rng = np.random.default_rng(seed)
    aside = rng.random(len(y)) < 0.2
    if any(aside[y == k].all() or not aside[y == k].any() for k in (0, 1)):
        aside[:] = False
    doc = np.repeat(np.repeat(np.arange(len(y)), np.diff(s.by_doc)), np.diff(s.first_word))
    met = np.bincount(np.unique(doc * WORDS + s.bucket) % WORDS, minlength=WORDS)
    net = Network(s.fixed.mean(axis=0), s.fixed.std(axis=0) + np.float32(0.02), met >= MET_LEAST)
    rows = np.flatnonzero(~aside)
    importance = np.where(y == 1, 0.5 / max(y[rows].mean(), 0.01), 0.5 / max(1 - y[rows].mean(), 0.01)).astype(np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(rows)))
    moment, step = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(rows)
        for i in range(0, len(order), BATCH):
            docs = order[i : i + BATCH]
            g = net.gradients(s.of(docs), y[docs], importance[docs])
            step += 1
            for k, v in net.p.items():
                m, d = moment[k], g[k] + DECAY * v
                m[0] = 0.9 * m[0] + 0.1 * d
                m[1] = 0.99 * m[1] + 0.01 * d**2
                v -= (RATE * (1 - epoch / epochs) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    use = np.flatnonzero(aside) if aside.any() else np.arange(len(y))
    slope, offset = calibrate(net.forward(s.of(use))[0].astype(np.float64), y[use])
    return Model(net, slope, offset, float(min(THRESHOLD - 0.01, np.asarray(good).mean())))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and offset of a logistic curve, by Newton steps with a slight pull to (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        w = p * (1 - p)
        grad = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        hess = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        move = np.linalg.solve(hess, grad)
        a, b = max(0.05, a - move[0]), b - move[1]
        if np.abs(move).max() < 1e-7:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    return train(*labelled_sample(docs, labels, label_col, BOUNDS, id_col, text_col))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id_col, held_out, score, predicted) of every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = model.value
            for piece in slices(b.column(1)):
                score = m.scores(passages_of(piece)) if m else np.zeros(len(piece))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(piece.first, len(piece)), pa.array(score)], names=[id_col, "score"])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    scored = slim.mapInArrow(run, f"`{id_col}` {slim.dtypes[0][1]}, score double")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
