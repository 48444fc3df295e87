"""Quality rules: counts of every whole text, and an isolation forest over rule statistics.

The base rules are fixed thresholds on the counts.  For the rest, each statistic
is measured by how far it lies outside the range of nearly all good labelled rows,
and random trees over all possible distances are filled with
all good ones; documents that few random splits isolate are anomalous.  The score threshold is calibrated on
labelled rows: the least one that keeps KEEP_GOOD of the good rows.  Every labelled row that passes the
base rules counts: ranks are found digit by digit from counts, and trees are drawn before they are
filled, so tasks send counts whose number does not grow with the rows.

Rules.  Null text counts as empty; a text of under 10 words fails; texts are read
whole; repeated rows are judged alike; without labelled rows of both kinds the
forest rejects nothing; an empty table gives an empty table.  Extra columns are
not read.  A null id keeps its row and has no label; an id with several labels is good
only if all say so, and counts once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.llm.kernel import ragged, shingles, slices, split_words, substring_hashes
from fileledger.sources.scratch import written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_marks", "n_lines")
#: Bits of a digit of `order_statistics`.
DIGIT = 11
TREES, TREE_ROWS = 128, 64
KEEP_GOOD = 0.995
#: Share of good rows beyond either end of a statistic's band, and the least unit outside it.
BAND, LEAST_UNIT = 0.001, 0.05

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?.,;:"]] = True


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags)])
    return run[bounds[1:]] - run[bounds[:-1]]


def _repeats_earlier(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks every value equal to an earlier one of its owner."""
    order = np.lexsort((np.arange(len(hashes)), hashes, owner))
    out = np.zeros(len(hashes), bool)
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    out[order[1:][same]] = True
    return out


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks every value its owner has twice or more."""
    order = np.lexsort((hashes, owner))
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def count_slice(piece) -> dict[str, np.ndarray]:
    """All counts of the documents of a slice."""
    data, bounds, n_docs = piece.data, piece.bounds, len(piece)
    words = split_words(piece)
    n_words = np.diff(words.by_doc)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    np.subtract.at(inside, words.end, 1)
    in_word = np.cumsum(inside[:-1]).astype(bool)
    lead = (data & 0xC0) != 0x80
    out = {"n_words": n_words, "word_chars": _per_doc(in_word & lead, bounds), "n_symbols": _per_doc(_SYMBOL[data], bounds)}

    newline = data == 10
    start = np.union1d(np.flatnonzero(newline) + 1, bounds[:-1])
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))[: len(start)]
    end = end - (newline[end - 1] & (end > start))
    word_run = np.concatenate([[0], np.cumsum(in_word)])
    full = word_run[end] > word_run[start]
    start, end = start[full], end[full]
    doc = np.searchsorted(bounds, start, side="right") - 1
    out["n_lines"] = np.bincount(doc, minlength=n_docs)
    out["n_dup_lines"] = np.bincount(doc[_repeats_earlier(substring_hashes(data, start, end), doc)], minlength=n_docs)

    five, owner = shingles(words, n_docs, 5, short_whole=False)
    windows = np.maximum(n_words - 4, 0)
    first = ragged(words.by_doc[:-1], windows)[_repeated(five, owner)]
    covered = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(covered, first, 1)
    np.subtract.at(covered, first + 5, 1)
    out["n_repeat_words"] = np.bincount(words.doc[np.cumsum(covered[:-1]) > 0], minlength=n_docs)

    out["n_upper"] = _per_doc((data >= 65) & (data <= 90), bounds)
    out["n_marks"] = _per_doc(_MARK[data], bounds)
    return out


def count_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """(id_col, counts, columns named in also): one row per row of docs."""
    names = (*COUNTS, *MORE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [count_slice(p) for p in slices(b.column(1))]
            if parts:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in names), *b.columns[2:]], names=[id_col, *names, *also])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string"), *also)
    return slim.mapInArrow(run, ", ".join([f"`{id_col}` {slim.dtypes[0][1]}", *(f"{k} bigint" for k in names), *(f"`{k}` {t}" for k, t in slim.dtypes[2:])]))


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def statistics(c: dict[str, np.ndarray]) -> np.ndarray:
    """One row per document: rates of symbols, upper case, punctuation, repeated lines and repeated words, and the logs of mean word length and word count."""
    f = {k: np.asarray(v, float) for k, v in c.items()}
    words, chars = np.maximum(f["n_words"], 1), np.maximum(f["word_chars"], 1)
    rate = lambda x, by: np.sqrt(np.minimum(x / by, 4.0))
    of_words = (rate(f[k], words) for k in ("n_symbols", "n_marks", "n_repeat_words"))
    return np.stack([*of_words, rate(f["n_upper"], chars), rate(f["n_dup_lines"], np.maximum(f["n_lines"], 1)), np.log(chars / words), np.log(words)], axis=1)


@dataclass
class Bands:
    """The range of each statistic that nearly all good rows keep to, and a unit for what lies outside."""

    low: np.ndarray
    high: np.ndarray
    unit: np.ndarray

    def beyond(self, x: np.ndarray) -> np.ndarray:
        """0 inside the range, towards 1 the further outside."""
        e = np.maximum(np.maximum(self.low - x, x - self.high), 0.0) / self.unit
        return e / (1.0 + e)


def fit_bands(x: np.ndarray) -> Bands:
    low, high = np.quantile(x, [BAND, 1 - BAND], axis=0)
    return Bands(low, high, np.maximum((high - low) / 4, LEAST_UNIT))


@dataclass
class Forest:
    """Trees as arrays: split column (-1 at a leaf), split value, left child, and depth plus the expected rest at a leaf."""

    column: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    scale: float

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in range(len(self.column)):
            node = np.zeros(len(x), np.int64)
            for _ in range(32):
                col = self.column[t, node]
                deeper = col >= 0
                if not deeper.any():
                    break
                right = x[np.arange(len(x)), np.maximum(col, 0)] >= self.value[t, node]
                node = np.where(deeper, self.left[t, node] + right, node)
            total += self.length[t, node]
        return total / len(self.column)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; higher: fewer random splits isolate the row."""
        return 2.0 ** (-self.path_lengths(x) / self.scale)


def _expected(n: float) -> float:
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def fit_forest(x: np.ndarray, seed: int = 11, box: tuple[float, float] | None = None) -> Forest:
    """Random trees over x; each split takes a column that varies and a value between its least and greatest.

    With box, every column is split between these bounds whether or not the rows
    vary in it, so a row beyond all of x is isolated in any column.
    """
    rng = np.random.default_rng(seed)
    rows = min(TREE_ROWS, len(x))
    depth = max(1, int(np.ceil(np.log2(max(2, rows)))) + 2)
    trees = []
    for _ in range(TREES):
        nodes: list[list[float]] = []

        def grow(at: int, part: np.ndarray, level: int, low: np.ndarray | None, high: np.ndarray | None) -> None:
            least, most = (part.min(axis=0), part.max(axis=0)) if box is None else (low, high)
            leaf = [-1, 0.0, 0, level + _expected(len(part))]
            open_ = np.flatnonzero(most > least)
            if level >= depth or len(part) <= 1 or not len(open_):
                nodes[at] = leaf
                return
            c = int(rng.choice(open_))
            v = rng.uniform(least[c], most[c])
            below = part[:, c] < v
            if box is None and (not below.any() or below.all()):
                nodes[at] = leaf
                return
            left = len(nodes)
            nodes.extend([[], []])
            nodes[at] = [c, v, left, 0.0]
            column = np.arange(x.shape[1]) == c
            grow(left, part[below], level + 1, least, np.where(column, v, most))
            grow(left + 1, part[~below], level + 1, np.where(column, v, least), most)

        nodes.append([])
        ends = (None, None) if box is None else (np.full(x.shape[1], box[0]), np.full(x.shape[1], box[1]))
        grow(0, x[rng.choice(len(x), rows, replace=False)], 0, *ends)
        trees.append(np.array(nodes))
    most = max(len(t) for t in trees)
    padded = np.stack([np.vstack([t, np.tile([-1, 0, 0, 0], (most - len(t), 1))]) for t in trees])
    return Forest(padded[:, :, 0].astype(np.int64), padded[:, :, 1], padded[:, :, 2].astype(np.int64), padded[:, :, 3], _expected(rows))


def calibrate(scores: np.ndarray, good: np.ndarray, keep: float = KEEP_GOOD) -> float:
    """The least threshold that keeps this share of the good rows (scores above it are rejected); infinite if it rejects no bad row."""
    if good.all() or not good.any():
        return float("inf")
    g = np.sort(scores[good])
    threshold = g[min(len(g) - 1, int(np.ceil(keep * len(g))) - 1)]
    return float(threshold) if (scores[~good] > threshold).any() else float("inf")


def _keys(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of doubles."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _tallies(rows: DataFrame, count: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over tasks of what count makes of their rows (a matrix of all columns), as (place, how many), places in order.  A task sends a place once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = None
        for b in batches:
            if b.num_rows:
                more = count(np.stack([c.to_numpy() for c in b.columns], axis=1))
                n = more if n is None else n + more
        if n is not None:
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["place", "n"])

    found = rows.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).orderBy("place").collect()
    return np.array([tuple(r) for r in found], np.int64).reshape(-1, 2)


def order_statistics(rows: DataFrame, targets: Sequence[tuple[int, int]]) -> list[float]:
    """The values at ranks (from 0) of columns of doubles, given as (column, rank): exact, by counts of one digit after the other."""
    known, ranks = [0] * len(targets), [r for _, r in targets]
    columns = [c for c, _ in targets]
    left = 64
    while left:
        bits = min(DIGIT, left)
        left -= bits
        wide = 1 << bits
        asked, low = list(known), left

        def count(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(asked) * wide, np.int64)
            for t, (c, prefix) in enumerate(zip(columns, asked)):
                k = _keys(x[:, c]) >> np.uint64(low)
                k = k[k >> np.uint64(bits) == np.uint64(prefix)] if prefix or low + bits < 64 else k
                out[t * wide : (t + 1) * wide] = np.bincount((k & np.uint64(wide - 1)).astype(np.int64), minlength=wide)
            return out

        table = _tallies(rows, count)
        for t in range(len(targets)):
            mine = table[table[:, 0] // wide == t]
            run = np.cumsum(mine[:, 1])
            k = int(np.searchsorted(run, ranks[t], side="right"))
            ranks[t] -= int(run[k - 1]) if k else 0
            known[t] = (known[t] << bits) | int(mine[k, 0] % wide)
    return [_value(k) for k in known]


def whole_bands(good: DataFrame, n: int) -> Bands:
    """fit_bands of all rows."""
    width, ends = len(good.columns), [q * (n - 1) for q in (BAND, 1 - BAND)]
    ranks = [(c, min(int(e) + k, n - 1)) for e in ends for k in (0, 1) for c in range(width)]
    v = np.array(order_statistics(good, ranks)).reshape(2, 2, width)
    low, high = (a + (b - a) * (e - int(e)) for (a, b), e in zip(v, ends))
    return Bands(low, high, np.maximum((high - low) / 4, LEAST_UNIT))


def _expected_of(mass: float) -> float:
    """_expected where a node holds a part of a row."""
    return max(0.0, mass - 1) if mass <= 2 else max(1.0, _expected(mass))


def whole_forest(good: DataFrame, bands: Bands, n: int, seed: int = 11) -> Forest:
    """Random trees over [0, 1] in every column, filled with how far all good rows lie beyond the bands.

    A node is split while it holds more than one of TREE_ROWS rows' worth; its rows count as that many parts.
    """
    rng, width = np.random.default_rng(seed), len(good.columns)
    rows = min(TREE_ROWS, n)
    depth = max(1, int(np.ceil(np.log2(max(2, rows)))) + 2)
    inner, nodes = (1 << depth) - 1, (2 << depth) - 1  # children of a node k stand at 2k + 1 and 2k + 2
    column = np.full((TREES, nodes), -1)
    value = np.zeros((TREES, nodes))
    for t in range(TREES):
        box = [(np.zeros(width), np.ones(width))]
        for k in range(inner):
            low, high = box[k]
            c = int(rng.integers(width))
            column[t, k], value[t, k] = c, rng.uniform(low[c], high[c])
            at = np.arange(width) == c
            box += [(low, np.where(at, value[t, k], high)), (np.where(at, value[t, k], low), high)]
    left = np.tile(2 * np.arange(nodes) + 1, (TREES, 1))

    def count(x: np.ndarray) -> np.ndarray:
        e, every = bands.beyond(x), np.arange(len(x))
        out = np.zeros(TREES * nodes, np.int64)
        for t in range(TREES):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (e[every, column[t, node]] >= value[t, node])
            out[t * nodes : (t + 1) * nodes] = np.bincount(node, minlength=nodes)
        return out

    table = _tallies(good, count)
    held = np.zeros(TREES * nodes)
    held[table[:, 0]] = table[:, 1]
    held = held.reshape(TREES, nodes)
    for k in range(inner - 1, -1, -1):
        held[:, k] = held[:, 2 * k + 1] + held[:, 2 * k + 2]
    mass = held * rows / n
    level = np.floor(np.log2(np.arange(nodes) + 1))
    length = level + np.vectorize(_expected_of, otypes=[float])(mass)
    column[mass <= 1] = -1
    return Forest(column, value, left, length, _expected(rows))


def fit(labelled: DataFrame, label_col: str = "quality") -> tuple[Bands, Forest, float] | None:
    """Bands and forest of all good rows and the threshold, from all labelled counts."""
    names, columns = (*COUNTS, *MORE), [f"s{i}" for i in range(7)]
    rows = labelled.where(F.col(label_col).isNotNull() & ~base_failed()).select((F.col(label_col) == 1).alias("good"), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics({k: b.column(i + 1).to_numpy() for i, k in enumerate(names)})
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v) for v in x.T)], names=["good", *columns])

    stats = written(rows.mapInArrow(run, ", ".join(["good boolean", *(f"{c} double" for c in columns)])), "quality-statistics")
    n, bad = stats.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    if not n or not bad:
        return None
    good = stats.where("good").select(*columns)
    bands = whole_bands(good, n)
    forest = whole_forest(good, bands, n)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([c.to_numpy() for c in b.columns[1:]], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forest.scores(bands.beyond(x)))], names=["good", "score"])

    scored = written(stats.mapInArrow(score, "good boolean, score double"), "quality-scores")
    (threshold,) = order_statistics(scored.where("good").select("score"), [(0, min(n - 1, int(np.ceil(KEEP_GOOD * n)) - 1))])
    return bands, forest, threshold if scored.where(~F.col("good") & (F.col("score") > threshold)).count() else float("inf")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", also: Sequence[str] = ()) -> DataFrame:
    """(id_col, counts, base_failed, score, kept, columns named in also) of every row of docs."""
    counts = written(count_rules(docs, id_col, text_col, also), "quality-counts")
    once = labels.groupBy(id_col).agg(F.min(label_col).alias(label_col))
    model = fit(counts.join(once, id_col), label_col)
    names = (*COUNTS, *MORE)
    if model is None:
        scored = counts.withColumn("score", F.lit(0.0)).withColumn("_odd", F.lit(False))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bands, forest, threshold = shared.value
            for b in batches:
                scores = forest.scores(bands.beyond(statistics({k: b.column(k).to_numpy() for k in names})))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores), pa.array(scores > threshold)], names=[*b.schema.names, "score", "_odd"])

        scored = counts.mapInArrow(run, ", ".join([*(f"`{k}` {t}" for k, t in counts.dtypes), "score double", "_odd boolean"]))
    return scored.withColumn("base_failed", base_failed()).select(id_col, *COUNTS, "base_failed", "score", (~F.col("base_failed") & ~F.col("_odd")).alias("kept"), *also)
