"""Mixing to target weights: bounded iterative proportional fitting, then sampling by the calibrated probabilities.

Documents fall into cells of source, language and topic.  Tokens are summed by
cell over all documents; the inclusion probability of each cell is raked until the
expected tokens meet the targets of every margin, no probability above 1.  A category
whose target is more than it has is taken whole, and what it lacks goes to the others of
its margin by their shares, so one rare category does not shrink the mix; `shares` tells
for each category what was asked, what was aimed at and what is reached.  A document is
taken if a hash of its id, read as a number in [0, 1), is below its cell's probability.

The topic is a column of that name where there is one.  Else it comes from the
corpus: `topics` clusters the word profiles of all documents, and every text takes
the nearest of the centres t0 to t7, each with a constant lead that gives them about
equal shares of the words.

Rules.  Null source, language or topic is the category ''.  Null text is empty
(0 tokens).  Every category is raked by itself; the cells that occur are held on the
driver.  A target above 0 for a category without tokens is an error.  Rows with equal ids are
taken or left together; rows without an id are drawn by their texts.  A corpus of empty texts
has no shares to meet: every row's probability is the fraction.  An empty table gives an empty table.  Extra columns pass
through take() untouched.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileledger.llm.kernel import slices, split_words
from fileledger.llm.topics import BUCKETS, PLAIN, Topics, column_cells, count_words, fit_cells, fit_topics, text_cells, word_cells  # noqa: F401
from fileledger.sources.scratch import written

MARGINS = ("source", "lang", "topic")
#: A share off its target by more than this part of it is not met.
MOST_OFF = 0.01
MOST_FACTOR = 1e9
#: Probabilities of more cells than this are joined to the rows instead of broadcast.
BROADCAST_CELLS = 1 << 17
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Mix:
    """fraction: expected share of all tokens.  tempering: default targets are token shares to this power.
    targets: shares by margin and category that replace the default ones."""

    fraction: float = 0.6
    tempering: float = 0.7
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    seed: int = 17
    rounds: int = 500
    tolerance: float = 1e-9


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topics: Topics | None = None, seed: int = Mix.seed) -> DataFrame:
    """(id, source, lang, drawn, topic, n_tokens).  topic: the column of that name, or the nearest centre of topics (fitted if not given).  drawn: the row's number in [0, 1)."""
    return _measured(docs, id_col, text_col, topics, seed)[0]


def _measured(docs: DataFrame, id_col: str, text_col: str, topics: Topics | None, seed: int) -> tuple[DataFrame, Topics | None]:
    """What measure gives, and the topics; where they are fitted here, from the cells of the fit, so texts are not read again."""
    told = {"id": F.col(id_col), "source": F.coalesce(F.col("source").cast("string"), F.lit("")), "drawn": draw(F.col(id_col), seed, F.col(text_col))}
    if topics is None and "topic" in docs.columns:
        lang, given = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in MARGINS[1:])
        slim = docs.select(*(c.alias(k) for k, c in told.items()), lang.alias("lang"), given.alias("topic"), F.col(text_col).cast("string").alias("text"))
        rows = slim.mapInArrow(_count_tokens, ", ".join(f"{k} {t}" for k, t in slim.dtypes[:-1]) + ", n_tokens bigint")
    else:
        cells = word_cells(docs, id_col, text_col, told)
        if topics is None:
            cells = written(cells, "topic-cells", **PLAIN)
            topics = fit_cells(cells)
        rows = _topic_rows(cells.select("id", "source", "lang", "drawn", "tokens", "cells", "heavy"), topics)
    return rows.select("id", "source", "lang", "drawn", "topic", "n_tokens"), topics


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = [_n_words(p) for p in slices(b.column(b.num_columns - 1))]
        if tokens:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(tokens))], names=[*b.schema.names[:-1], "n_tokens"])


def _topic_rows(cells: DataFrame, topics: Topics) -> DataFrame:
    shared = cells.sparkSession.sparkContext.broadcast(topics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = shared.value.of(column_cells(b, shared.value.weight), b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([f"t{k}" for k in found], pa.string()), b.column(4)], names=["id", "source", "lang", "drawn", "topic", "n_tokens"])

    return cells.mapInArrow(run, f"id {cells.dtypes[0][1]}, source string, lang string, drawn double, topic string, n_tokens bigint")


def _n_words(piece) -> np.ndarray:
    return np.diff(split_words(piece).by_doc)


@dataclass
class Fit:
    """Inclusion probabilities by cell, the share of all tokens they keep, by what part of what is aimed at the worst category misses it, and (margin, category, tokens, asked, aimed, reached), the last three as shares of the tokens kept."""

    p: np.ndarray
    fraction: float
    residual: float
    shares: list[tuple[str, str, float, float, float, float]]


def _shares(name: str, names: np.ndarray, have: np.ndarray, mix: Mix) -> np.ndarray:
    """Target shares of a margin's categories."""
    want = (have / have.sum()) ** mix.tempering * (have > 0)
    want /= want.sum()
    given = mix.targets.get(name, {})
    if given:
        named = np.array([n in given for n in names])
        rest = np.where(named, 0.0, want)
        rest *= max(0.0, 1 - sum(given.values())) / max(rest.sum(), 1e-300)
        want = np.where(named, [given.get(n, 0.0) for n in names], rest) * (have > 0)
        want /= max(want.sum(), 1e-300)
    return want


def _solve(margins: list[tuple], tokens: np.ndarray, fraction: float, mix: Mix) -> tuple[np.ndarray, float]:
    """Probabilities min(1, product of a factor a category) that meet the shares at this fraction, and the residual.

    Factors go on growing where p stands at 1, so a cell that another margin pushes down comes back.
    """
    total, u = tokens.sum(), np.full(len(tokens), fraction)
    p = np.minimum(1.0, u)
    for _ in range(mix.rounds):
        before = p
        for index, share, n in margins:
            now = np.bincount(index, weights=tokens * p, minlength=n)
            u = np.minimum(u * np.divide(share * total * fraction, now, out=np.ones(n), where=now > 0)[index], MOST_FACTOR)
            p = np.minimum(1.0, u)
        if np.abs(p - before).max() < mix.tolerance:
            break
    off = 0.0
    for index, share, n in margins:
        now = np.bincount(index, weights=tokens * p, minlength=n) / (total * fraction)
        off = max(off, np.abs(now / np.where(share > 0, share, 1.0) - (share > 0)).max())
    return p, float(off)


def _reachable(share: np.ndarray, have: np.ndarray, wanted: float) -> np.ndarray:
    """Shares of `wanted` tokens that categories can give: those that have less than their share are whole, the others fill up by their shares."""
    out, whole = share.copy(), np.zeros(len(share), bool)
    while True:
        short = ~whole & (out * wanted > have)
        if not short.any():
            return out
        whole |= short
        rest = np.where(whole, 0.0, share)
        left = max(0.0, wanted - have[whole].sum())
        filled = rest / rest.sum() * left if rest.sum() > 0 else rest
        out = np.where(whole, have, filled) / wanted


def fit_mix(cells: list[tuple], tokens: np.ndarray, mix: Mix) -> Fit:
    """Probabilities of cells (tuples of categories, one per margin) that keep mix.fraction of the tokens and meet every margin as far as its categories have the tokens."""
    total, f = tokens.sum(), min(1.0, mix.fraction)
    if not len(cells) or total <= 0 or f <= 0:
        return Fit(np.full(len(cells), f), f, 0.0, [])
    margins, asked = [], []
    for k, name in enumerate(MARGINS):
        names, index = np.unique(np.array([c[k] for c in cells], dtype=object).astype(str), return_inverse=True)
        have = np.bincount(index, weights=tokens, minlength=len(names))
        asked.append((name, names, have, _shares(name, names, have, mix)))
        margins.append((index, _reachable(asked[-1][3], have, f * total), len(names)))
    p, off = _solve(margins, tokens, f, mix)
    kept = float((tokens * p).sum())
    shares = []
    for (name, names, have, share), (index, aim, n) in zip(asked, margins):
        reached = np.bincount(index, weights=tokens * p, minlength=n) / max(kept, 1e-300)
        shares += zip([name] * n, names.tolist(), have.tolist(), share.tolist(), aim.tolist(), reached.tolist())
    fit = Fit(p, kept / total, off, shares)
    if off > MOST_OFF:
        log.warning("mixing: the margins contradict each other; a share misses what it aims at by %.4f of it (fraction %.4f)", off, fit.fraction)
    whole = [f"{m} {c}" for m, c, _, want, aim, _ in shares if aim < want * (1 - MOST_OFF)]
    if whole:
        log.warning("mixing: %d categories have less than their share and are taken whole: %s", len(whole), whole[:20])
    return fit


def shares(measured: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(margin, category, n_tokens, asked, aimed, reached) by category: its target share, the same after whole categories have given way, and the expected share of the mix."""
    rows = fitted(measured, mix)[1].shares
    return measured.sparkSession.createDataFrame([(m, c, int(n), *x) for m, c, n, *x in rows], "margin string, category string, n_tokens bigint, asked double, aimed double, reached double")


def rake(cells: list[tuple], tokens: np.ndarray, mix: Mix) -> np.ndarray:
    """Inclusion probability of each cell (a tuple of categories, one per margin)."""
    return fit_mix(cells, tokens, mix).p


def fitted(measured: DataFrame, mix: Mix) -> tuple[list[tuple], Fit]:
    """The cells that occur and their fit; targets that name a category without tokens are an error."""
    rows = measured.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n")).orderBy(*MARGINS).collect()
    cells = [tuple(r[:3]) for r in rows]
    for k, name in enumerate(MARGINS):
        there = {c[k] for c, r in zip(cells, rows) if r[3]}
        missing = sorted(n for n, share in mix.targets.get(name, {}).items() if share > 0 and n not in there)
        if rows and missing:
            raise ValueError(f"targets of {name} name categories without tokens: {missing[:20]}")
    return cells, fit_mix(cells, np.array([r[3] for r in rows], float), mix)


def probabilities(measured: DataFrame, mix: Mix) -> dict[tuple, float]:
    """The probability of every cell that occurs."""
    cells, fit = fitted(measured, mix)
    return dict(zip(cells, fit.p.tolist()))


def draw(id_column: Column, seed: int, text: Column | None = None) -> Column:
    """A number in [0, 1) that depends on the id alone, or where there is none on the text."""
    by = F.xxhash64(id_column, F.lit(seed))
    by = by if text is None else F.when(id_column.isNull(), F.xxhash64(text, F.lit(seed))).otherwise(by)
    return F.shiftrightunsigned(by, 11) / float(1 << 53)


def _with_probability(rows: DataFrame, p: dict[tuple, float], names: Sequence[str], into: str = "probability") -> DataFrame:
    """rows with the probability of the cell that the named columns give, as column `into`."""
    cells = [f"{into}_of_{n}" for n in MARGINS]
    table = rows.sparkSession.createDataFrame([(*c, v) for c, v in p.items()] or [("", "", "", 0.0)], ", ".join([*(f"`{c}` string" for c in cells), f"`{into}` double"]))
    return rows.join(F.broadcast(table) if len(p) <= BROADCAST_CELLS else table, [F.col(n) == F.col(c) for n, c in zip(names, cells)], "left").drop(*cells)


def calibrated(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, source, lang, topic, n_tokens, probability, selected) of every row of docs."""
    measured = written(measure(docs, id_col, text_col, seed=mix.seed), "mixing-measures")
    joined = _with_probability(measured, probabilities(measured, mix), MARGINS)
    return joined.select(F.col("id").alias(id_col), *MARGINS, "n_tokens", "probability", (F.col("drawn") < F.col("probability")).alias("selected"))


def take(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled rows of docs, all columns; where probabilities can be broadcast, without a shuffle of texts."""
    measured, topics = _measured(docs, id_col, text_col, None, mix.seed)
    p = probabilities(written(measured, "mixing-measures"), mix)
    few = len(p) <= BROADCAST_CELLS
    shared = docs.sparkSession.sparkContext.broadcast((p if few else None, topics))
    names = docs.columns
    at, where = names.index(text_col), [names.index(c) for c in MARGINS if c in names]

    def topics_of(model: Topics, texts: pa.Array, langs: list[str]) -> list[str]:
        return [f"t{k}" for q in slices(texts) for k in model.of(text_cells(q, model.weight), langs[q.first : q.first + len(q)])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prob, model = shared.value
        span: dict[tuple, tuple[float, float]] = {}
        for (source, lang, _), x in (prob or {}).items():
            low, high = span.get((source, lang), (x, x))
            span[source, lang] = min(low, x), max(high, x)
        for b in batches:
            sides = [["" if x is None else str(x) for x in b.column(i).to_pylist()] for i in where]
            u = b.column(len(names)).to_numpy() if b.num_rows else ()
            if model and few:  # a topic is looked up where a row's number lies between the probabilities that its source and language have
                spans = [span.get(cell, (0.0, 1.0)) for cell in zip(*sides)]
                open_ = [i for i, (x, (low, high)) in enumerate(zip(u, spans)) if low <= x < high]
                keep = [x < low for x, (low, _) in zip(u, spans)]
                for i, topic in zip(open_, topics_of(model, b.column(at).take(pa.array(open_, pa.int64())), [sides[1][i] for i in open_])):
                    keep[i] = u[i] < prob.get((sides[0][i], sides[1][i], topic), 0.0)
                yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names=names).filter(pa.array(keep, pa.bool_()))
                continue
            if model:
                sides.append(topics_of(model, b.column(at), sides[1]))
            if prob is None:
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.string()) for x in sides)], names=[*b.schema.names, *more])
                continue
            keep = [x < prob.get(cell, 0.0) for x, cell in zip(u, zip(*sides))]
            yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names=names).filter(pa.array(keep, pa.bool_()))

    name = "_draw" + "_" * max(map(len, names))  # longer than any column, so it clashes with none
    more = [f"{name}_{m}" for m in MARGINS]
    drawn = docs.withColumn(name, draw(F.col(id_col), mix.seed, F.col(text_col)))
    if few:
        return drawn.mapInArrow(run, docs.schema)
    told = drawn.mapInArrow(run, T.StructType([*drawn.schema.fields, *(T.StructField(m, T.StringType()) for m in more)]))
    return _with_probability(told, p, more, f"{name}_p").where(F.col(name) < F.col(f"{name}_p")).select(*names)
