"""Topics of a corpus: k-means of word profiles over all its documents, as rounds of counts.

Counts of words of 5 bytes or more in hashed buckets, damped, weighted by rarity and
less the mean profile of the document's language, are clustered on the unit sphere.
Every document counts in the weights, the means, the draws of first centres, all
rounds and the leads.  A lead is a constant by topic that gives topics about equal
shares of the words; a text takes the topic of most likeness plus lead.

Texts are read once into cells, two bytes each (a bucket and its count), and these become
profiles, several documents a row; a round reads the profiles and sends one vector a
centre and task.  What is added up is whole numbers, and a nearest centre that single
precision leaves open is told in exact products, so a fit does not depend on how the rows
are dealt out.
First centres are drawn by the k-means++ rule: of all documents the one of least
-ln(u) / far**2 comes next, u being a hash of its id, language and text.  All starts
share their rounds.  Leads are found by Newton steps on the words at the borders of
topics; a round tries many and the most even one stays.

Rules.  Null languages and those of fewer than one in MOST_LANGS documents share one
mean, ''.  A text without such words, or that hardly differs from its language's mean,
has no profile: it counts in weights and means alone and takes the topic of most lead.
Fewer distinct profiles than topics give as many topics as profiles, none gives one.
Rows that repeat count each for itself; a null text is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.llm.kernel import byte_view, mix, ragged, slices, split_words
from fileledger.sources.scratch import written

TOPICS, BUCKETS = 8, 1024
STARTS, CLUSTER_ROUNDS, SEED = 6, 50, 5
#: Rounds of leads at most; shares of words as near as this are even; widths of borders.
LEAD_ROUNDS, EVEN, WIDTHS = 16, 1e-3, (0.2, 0.05, 0.0125)
#: Profiles and centres are whole numbers of 1 / ONE: products of two add up exactly in doubles.
ONE, FINE = 1 << 22, 1 << 30
#: A profile is less than this away from its language's mean: none.  A document is less than this from a centre: not drawn.
LEAST_AWAY, APART = 1 / 256, 1e-4
MOST_LANGS = 4096
CHUNK = 512
#: A cell is count * BUCKETS + bucket; a count of HEAVY or more stands apart and is 0 there.
HEAVY = (1 << 16) // BUCKETS
#: Cells do not compress, and are read often.
PLAIN = {"compression": "none"}
#: Cells of a row of profiles, about; a document's other numbers weigh as much as this many cells.
PACKED, HEAD_CELLS = 256, 16
HEAD = np.dtype([("lang", np.int32), ("cells", np.int32), ("norm", np.float64), ("inverse", np.float64)])
#: Products in single precision are less than this (times 1 / r) off, twice over.
ROUGH = 2e-4


@dataclass
class Topics:
    """Word weights, the mean profile of each language ('' for any other), the centres of the topics, and a lead that evens out their words."""

    weight: np.ndarray
    means: dict[str, np.ndarray]
    centres: np.ndarray
    lead: np.ndarray

    def of(self, cells: Cells, langs: list[str]) -> np.ndarray:
        """The topic of each text: the nearest of the centres, with their leads, to how it differs from its language's mean profile."""
        number = {lang: k for k, lang in enumerate(self.means)}
        means = np.stack(list(self.means.values()))
        lang = np.array([number.get(x, number[""]) for x in langs], np.int64)
        away, there = _away(cells, lang, means)
        of_langs, found = means @ self.centres.T, np.empty(len(lang), np.int64)
        wide = np.zeros((CHUNK, BUCKETS))
        for first in range(0, len(lang), CHUNK):
            rows = slice(first, min(first + CHUNK, len(lang)))
            mine = slice(cells.bounds[rows.start], cells.bounds[rows.stop])
            wide.fill(0)
            wide.reshape(-1)[(cells.doc[mine] - first) * BUCKETS + cells.at[mine]] = cells.value[mine]
            x = ((wide @ self.centres.T)[: rows.stop - first] - of_langs[lang[rows]]) / np.maximum(away[rows], LEAST_AWAY)[:, None]
            found[rows] = (x * there[rows, None] + self.lead).argmax(axis=1)
        return found


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-12)


def count_words(piece) -> tuple[np.ndarray, np.ndarray]:
    """Words of 5 bytes or more by bucket, and the number of all words, of each document."""
    words = split_words(piece, fold_case=True)
    long = words.end - words.start >= 5
    at = words.doc[long] * BUCKETS + (words.hash[long] % np.uint64(BUCKETS)).astype(np.int64)
    return np.bincount(at, minlength=len(piece) * BUCKETS).reshape(-1, BUCKETS), np.diff(words.by_doc)


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values[bounds[i]:bounds[i + 1]] as bytes, one an entry."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _coded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of counts (a row of buckets a document), the counts that are heavy, and the bounds of both by document."""
    flat = np.flatnonzero(counts)
    n = counts.ravel()[flat]
    bounds = np.searchsorted(flat, np.arange(len(counts) + 1) * BUCKETS)
    heavy = np.flatnonzero(n >= HEAVY)
    code = flat % BUCKETS + n * BUCKETS
    code[heavy] %= BUCKETS
    return code.astype(np.uint16), n[heavy].astype(np.uint32), bounds, np.searchsorted(heavy, bounds)


def word_cells(docs: DataFrame, id_col: str, text_col: str, also: dict[str, Column] | None = None) -> DataFrame:
    """(place, lang, those of also, words, tokens, cells, heavy) of every row of docs: a hash of it, its language or '', how many words of 5 bytes or more and of any length, their buckets with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b.column(b.num_columns - 1)):
                counts, tokens = count_words(piece)
                code, heavy, bounds, heavy_bounds = _coded(counts)
                part = b.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts.sum(axis=1)), pa.array(tokens), _binaries(code, bounds), _binaries(heavy, heavy_bounds)], names=[*b.schema.names[:-1], "words", "tokens", "cells", "heavy"])

    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("")), F.col(text_col).cast("string")
    slim = docs.select(F.xxhash64(F.col(id_col), lang, text, F.lit(SEED)).alias("place"), lang.alias("lang"), *(c.alias(k) for k, c in (also or {}).items()), text.alias("text"))
    kept = ", ".join(f"{k} {t}" for k, t in slim.dtypes[:-1])
    return slim.mapInArrow(run, f"{kept}, words bigint, tokens bigint, cells binary, heavy binary")


@dataclass
class Cells:
    """Damped and weighted unit vectors of documents: entry i is `value` in bucket `at` of document `doc`; norm: their lengths before."""

    doc: np.ndarray
    at: np.ndarray
    value: np.ndarray
    bounds: np.ndarray
    norm: np.ndarray


def _numbers(column: pa.Array, kind: type | np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """What the entries of a column of bytes hold, one after the other, and bounds by entry."""
    data, bounds = byte_view(column)
    size = np.dtype(kind).itemsize
    return data[bounds[0] : bounds[-1]].view(kind), (bounds - bounds[0]) // size


def _damped(code: np.ndarray, heavy: np.ndarray, at: np.ndarray, of_code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The damped and weighted counts of cells."""
    value = of_code[code]
    if len(heavy):
        rows = np.flatnonzero(code < BUCKETS)
        value[rows] = np.sqrt(heavy) * weight[at[rows]]
    return value


def _of_code(weight: np.ndarray) -> np.ndarray:
    return (np.sqrt(np.arange(HEAVY))[:, None] * weight).ravel()


def cells_of(code: np.ndarray, heavy: np.ndarray, bounds: np.ndarray, weight: np.ndarray) -> Cells:
    at, doc = (code % BUCKETS).astype(np.int64), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    value = _damped(code, heavy, at, _of_code(weight), weight)
    norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=len(bounds) - 1))
    return Cells(doc, at, value / norm[doc], bounds, norm)


def text_cells(piece, weight: np.ndarray) -> Cells:
    """Cells of the texts of a slice."""
    return cells_of(*_coded(count_words(piece)[0])[:3], weight)


def column_cells(b: pa.RecordBatch, weight: np.ndarray) -> Cells:
    """Cells of a batch's columns `cells` and `heavy`."""
    code, bounds = _numbers(b.column(b.schema.get_field_index("cells")), np.uint16)
    return cells_of(code, _numbers(b.column(b.schema.get_field_index("heavy")), np.uint32)[0], bounds, weight)


def _away(c: Cells, lang: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far documents are from their languages' means, and whether they have a profile."""
    alike = np.bincount(c.doc, weights=c.value * means[lang[c.doc], c.at], minlength=len(lang))
    away = np.sqrt(np.maximum(1 - 2 * alike + (means * means).sum(axis=1)[lang], 0))
    return away, (np.diff(c.bounds) > 0) & (away >= LEAST_AWAY)


def _summed(rows: DataFrame, count: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Vectors of whole numbers that count makes of batches, added up by key.  A task sends a key once."""

    def add(sums: dict[int, np.ndarray], key: int, x: np.ndarray) -> None:
        sums[key] = sums[key] + x if key in sums else x

    def out(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for key, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([x.astype(np.int64).tobytes()], pa.binary())], names=["key", "sums"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for key, x in count(b).items():
                    add(sums, key, x)
        yield from out(sums)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                add(sums, b.column(0)[i].as_py(), np.frombuffer(b.column(1)[i].as_py(), np.int64))
        yield from out(sums)

    found = rows.mapInArrow(part, "key int, sums binary").repartition("key").mapInArrow(whole, "key int, sums binary")
    return {r.key: np.frombuffer(bytes(r.sums), np.int64) for r in found.collect()}


def _word_weights(cells: DataFrame) -> tuple[np.ndarray, int]:
    """Weights by rarity, and the number of documents."""

    def count(b: pa.RecordBatch) -> dict[int, np.ndarray]:
        return {0: np.append(np.bincount(_numbers(b.column(0), np.uint16)[0] % BUCKETS, minlength=BUCKETS), b.num_rows)}

    seen = _summed(cells.select("cells"), count).get(0, np.zeros(BUCKETS + 1, np.int64))
    n = int(seen[-1])
    return np.log((1 + n) / (1 + seen[:-1])) + 1, n


def _language_means(cells: DataFrame, weight: np.ndarray, langs: list[str]) -> np.ndarray:
    """The mean unit vector of each language; langs[0] is '' and stands for all that are not named.  Where no document is of those, it is the mean of all."""
    number = {lang: k for k, lang in enumerate(langs)}

    def count(b: pa.RecordBatch) -> dict[int, np.ndarray]:
        c = column_cells(b, weight)
        there, lang = np.unique([number.get(x, 0) for x in b.column(0).to_pylist()], return_inverse=True)
        sums = np.bincount(lang[c.doc] * BUCKETS + c.at, weights=np.rint(c.value * FINE), minlength=len(there) * BUCKETS).reshape(-1, BUCKETS)
        docs = np.bincount(lang, minlength=len(there))
        return {int(k): np.append(s, n).astype(np.int64) for k, s, n in zip(there, sums, docs)}

    sums = _summed(cells.select("lang", "cells", "heavy"), count)
    sums.setdefault(0, sum(sums.values()))
    return np.stack([sums[k][:-1] / FINE / sums[k][-1] for k in range(len(langs))])


def profiles_of(cells: DataFrame, weight: np.ndarray, langs: list[str], means: np.ndarray) -> DataFrame:
    """(places, words, heads, cells, heavy) of the documents that have a profile, those of several in a row; lang as a number.

    A profile is (v - m) / r: v the unit vector, m its language's mean, r their distance.  v is the cells,
    weighted, over `norm`, and 1 / r is `inverse`; readers round v / r and 1 / r to whole numbers of 1 / ONE; m is not repeated.
    """
    number = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = column_cells(b, weight)
            lang = np.array([number.get(x, 0) for x in b.column(1).to_pylist()], np.int32)
            away, there = _away(c, lang, means)
            kept = b.filter(pa.array(there))
            if not kept.num_rows:
                continue
            heads = np.zeros(kept.num_rows, HEAD)
            heads["lang"], heads["cells"], heads["norm"], heads["inverse"] = lang[there], np.diff(c.bounds)[there], c.norm[there], 1 / away[there]
            row = np.cumsum(heads["cells"] + HEAD_CELLS) // PACKED
            ends = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]])
            arrays = [_binaries(x, ends) for x in (kept.column(0).to_numpy(), kept.column(2).to_numpy(), heads)]
            for at, kind in ((3, np.uint16), (4, np.uint32)):
                numbers, bounds = _numbers(kept.column(at), kind)
                arrays.append(_binaries(numbers, bounds[ends]))
            yield pa.RecordBatch.from_arrays(arrays, names=["places", "words", "heads", "cells", "heavy"])

    return cells.select("place", "lang", "words", "cells", "heavy").mapInArrow(run, "places binary, words binary, heads binary, cells binary, heavy binary")


@dataclass
class Profiles:
    """Up to CHUNK documents: `value` in bucket `at`, whole numbers; bounds by document."""

    lang: np.ndarray
    inverse: np.ndarray
    at: np.ndarray
    value: np.ndarray
    bounds: np.ndarray
    #: Of `places` and `words` what the table has.
    more: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        self.size = np.diff(self.bounds)
        self.flat = np.repeat(np.arange(len(self)) * BUCKETS, self.size) + self.at

    def __len__(self) -> int:
        return len(self.lang)

    def times(self, centres: np.ndarray, of_langs: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Products of every document and centre (a row of centres) in the precision of wide, a matrix to write over; of_langs: means times centres."""
        wide = wide[: len(self)]
        wide.fill(0)
        wide.reshape(-1)[self.flat] = self.value
        out = wide @ centres.T
        out -= self.inverse[:, None].astype(wide.dtype) * of_langs[self.lang]
        return out

    def only(self, rows: np.ndarray) -> Profiles:
        cells = ragged(self.bounds[rows], self.size[rows])
        return Profiles(self.lang[rows], self.inverse[rows], self.at[cells], self.value[cells], np.concatenate([[0], np.cumsum(self.size[rows])]), {})

    def profile(self, i: int, means: np.ndarray) -> np.ndarray:
        x = np.zeros(BUCKETS)
        cells = slice(self.bounds[i], self.bounds[i + 1])
        x[self.at[cells]] = self.value[cells]
        return x - self.inverse[i] * means[self.lang[i]]


def _reader(weight: np.ndarray) -> Callable[[pa.RecordBatch], Iterator[Profiles]]:
    """What reads the documents of batches of profiles."""
    of_code = _of_code(weight)

    def chunks(b: pa.RecordBatch) -> Iterator[Profiles]:
        column = lambda name, kind: _numbers(b.column(b.schema.get_field_index(name)), kind)[0]
        if not b.num_rows:
            return
        heads, code, heavy = column("heads", HEAD), column("cells", np.uint16), column("heavy", np.uint32)
        more = {k: column(k, np.int64) for k in ("places", "words") if k in b.schema.names}
        bounds = np.concatenate([[0], np.cumsum(heads["cells"], dtype=np.int64)])
        heavy_at = np.flatnonzero(code < BUCKETS) if len(heavy) else heavy
        for first in range(0, len(heads), CHUNK):
            rows = slice(first, min(first + CHUNK, len(heads)))
            ends, part = bounds[first : rows.stop + 1], heads[rows]
            mine, size = code[ends[0] : ends[-1]], np.diff(ends)
            at = (mine % BUCKETS).astype(np.int64)
            value = _damped(mine, heavy[slice(*np.searchsorted(heavy_at, ends[[0, -1]]))], at, of_code, weight)
            value /= np.repeat(part["norm"], size)
            value *= np.repeat(part["inverse"] * ONE, size)
            yield Profiles(part["lang"].copy(), np.rint(part["inverse"] * ONE), at, np.rint(value, out=value), ends - ends[0], {k: x[rows] for k, x in more.items()})

    return chunks


@dataclass
class Nearest:
    """The centres of several starts (whole numbers; sizes: how many each), to find for a document the nearest of each start."""

    centres: np.ndarray
    sizes: list[int]
    means: np.ndarray

    def __post_init__(self) -> None:
        self.of_langs = self.means @ self.centres.T
        self.rough = (self.centres / ONE).astype(np.float32), (self.of_langs / ONE).astype(np.float32)
        self.firsts = np.cumsum([0, *self.sizes[:-1]]).tolist()

    def of(self, docs: Profiles, wide: np.ndarray) -> list[np.ndarray]:
        """Numbers of the nearest centres (ties: the first), an array a start; wide: a matrix in single precision to write over."""
        z = np.ascontiguousarray(docs.times(*self.rough, wide).T)
        least, open_, near = ROUGH * docs.inverse.astype(np.float32), np.zeros(len(docs), bool), []
        for first, k in zip(self.firsts, self.sizes):
            mine = z[first : first + k]
            likely = mine > mine.max(axis=0) - least
            near.append(np.arange(k) @ likely)  # where only one is
            open_ |= likely.sum(axis=0) > 1
        rows = np.flatnonzero(open_)
        if len(rows):
            z = docs.only(rows).times(self.centres, self.of_langs, np.empty((len(rows), BUCKETS)))
            for j, (first, k) in enumerate(zip(self.firsts, self.sizes)):
                near[j][rows] = z[:, first : first + k].argmax(axis=1)
        return near


def _chance(place: np.ndarray, start: int, step: int) -> np.ndarray:
    """Numbers in (0, 1) by document, other ones each start and step."""
    salt = mix(np.array([start * 1000 + step + 1], np.uint64))
    return ((mix(place.view(np.uint64) ^ salt) >> np.uint64(11)) + 0.5) / float(1 << 53)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(_unit(x) * ONE)


def _first_centres(profiles: DataFrame, means: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """For each start up to TOPICS profiles, the next one drawn by its squared distance from those before."""
    centres = [np.zeros((0, BUCKETS)) for _ in range(STARTS)]
    for step in range(TOPICS):
        open_ = [s for s in range(STARTS) if len(centres[s]) == step]
        if not open_:
            break
        now = np.vstack([centres[s] for s in open_])
        of_langs = means @ now.T

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, np.ndarray]] = {}
            wide, chunks = np.empty((CHUNK, BUCKETS)), _reader(weight)
            for docs in (c for b in batches for c in chunks(b)):
                likes = docs.times(now, of_langs, wide) / ONE**2 if step else None
                for k, s in enumerate(open_):
                    far = np.ones(len(docs)) if likes is None else 1 - likes[:, k * step : (k + 1) * step].max(axis=1)
                    wait = np.where(far > APART, -np.log(_chance(docs.more["places"], s, step)) / np.maximum(far, APART) ** 2, np.inf)
                    i = int(wait.argmin())
                    if wait[i] < best.get(s, (np.inf,))[0]:
                        best[s] = float(wait[i]), docs.profile(i, means)
            for s, (wait, x) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([wait]), pa.array([_whole(x).tobytes()], pa.binary())], names=["start", "wait", "centre"])

        drawn = profiles.drop("words").mapInArrow(run, "start int, wait double, centre binary").groupBy("start").agg(F.min(F.struct("wait", "centre")).alias("x"))
        for r in drawn.collect():  # a row each start
            centres[r.start] = np.vstack([centres[r.start], np.frombuffer(bytes(r.x.centre))])
    return centres


def _add_by_centre(out: np.ndarray, docs: Profiles, near: list[np.ndarray], now: Nearest) -> None:
    """Add to every row of out the cells and, behind them, the inverses by language of the documents nearest to that centre.  Two starts share a count of their pairs of centres."""
    n_langs = out.shape[1] - BUCKETS
    starts = list(zip(near, now.firsts, now.sizes))
    for near_one, first, k in starts:
        out[first : first + k, BUCKETS:] += np.bincount(near_one * n_langs + docs.lang, weights=docs.inverse, minlength=k * n_langs).reshape(k, -1)
    for j in range(0, len(starts), 2):
        (one, first, k), (other, other_first, other_k) = starts[j], starts[j + 1] if j + 1 < len(starts) else (0, 0, 1)
        by_pair = np.bincount(np.repeat((one * other_k + other) * BUCKETS, docs.size) + docs.at, weights=docs.value, minlength=k * other_k * BUCKETS).reshape(k, other_k, BUCKETS)
        out[first : first + k, :BUCKETS] += by_pair.sum(axis=1)
        if j + 1 < len(starts):
            out[other_first : other_first + other_k, :BUCKETS] += by_pair.sum(axis=0)


def _centres(profiles: DataFrame, means: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The centres (whole numbers) of the start whose documents are most like theirs."""
    centres = _first_centres(profiles, means, weight)
    n_langs, live, score = len(means), list(range(STARTS)), [0.0] * STARTS
    slim = profiles.drop("places", "words")
    for step in range(CLUSTER_ROUNDS + 1):
        now = Nearest(np.vstack([centres[s] for s in live]), [len(centres[s]) for s in live], means)

        def count(b: pa.RecordBatch) -> dict[int, np.ndarray]:
            out = np.zeros((len(now.centres), BUCKETS + n_langs))
            wide = np.empty((CHUNK, BUCKETS), np.float32)
            for docs in _reader(weight)(b):
                _add_by_centre(out, docs, now.of(docs, wide), now)
            return {j: x.astype(np.int64) for j, x in enumerate(out) if x.any()}

        found = _summed(slim, count)
        sums = np.stack([found.get(j, np.zeros(BUCKETS + n_langs, np.int64)) for j in range(len(now.centres))])
        moved = sums[:, :BUCKETS] - sums[:, BUCKETS:] @ means
        still = []
        for s, first, k in zip(live, now.firsts, now.sizes):
            mine = moved[first : first + k]
            score[s] = float((mine * centres[s]).sum())
            after = np.where(mine.any(axis=1, keepdims=True), _whole(mine), centres[s])
            if step < CLUSTER_ROUNDS and np.abs(after - centres[s]).max() >= 1e-6 * ONE:
                centres[s] = after
                still.append(s)
        live = still
        if not live:
            break
    return centres[int(np.argmax(score))]


def _leads(profiles: DataFrame, means: np.ndarray, weight: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """A constant by topic under which the topics' words are most even."""
    k, of_langs = len(centres), means @ centres.T
    if k == 1:
        return np.zeros(1)

    def like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, chunks = np.empty((CHUNK, BUCKETS)), _reader(weight)
        for docs in (c for b in batches for c in chunks(b)):
            x = docs.times(centres, of_langs, wide) / ONE**2
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([docs.more["words"].tobytes()], pa.binary())], names=["likes", "words"])

    likes = written(profiles.drop("places").mapInArrow(like, "likes binary, words binary"), "topic-likes")
    tries, best, stride = [np.zeros(k)], (np.inf, (), None), 1.0
    for _ in range(LEAD_ROUNDS):

        def count(b: pa.RecordBatch) -> dict[int, np.ndarray]:
            out = np.zeros((len(tries), k + len(WIDTHS) * k * k), np.int64)
            for row in range(b.num_rows):
                x = np.frombuffer(b.column(0)[row].as_py()).reshape(-1, k)
                words, every = np.frombuffer(b.column(1)[row].as_py(), np.int64), np.arange(len(x))
                for t, lead in enumerate(tries):
                    z = x + lead
                    top = z.argmax(axis=1)
                    most = z[every, top]
                    z[every, top] = -np.inf
                    second = z.argmax(axis=1)
                    gap, pair = most - z[every, second], top * k + second
                    borders = [np.bincount(pair, weights=words * (gap < w), minlength=k * k) for w in WIDTHS]
                    out[t] += np.concatenate([np.bincount(top, weights=words, minlength=k), *borders]).astype(np.int64)
            return dict(enumerate(out))

        found, before = _summed(likes, count), best[0]
        for t, lead in enumerate(tries):
            share = found[t] / found[t][:k].sum()
            best = min(best, (float(np.ptp(share[:k])), tuple(lead.tolist()), share), key=lambda x: x[:2])
        if best[0] <= EVEN or stride < 1e-3:
            break
        stride = stride if best[0] < before else stride / 8
        over, lead = best[2][:k] - 1 / k, np.array(best[1])
        ways = [over]
        for w, border in zip(WIDTHS, best[2][k:].reshape(-1, k, k)):
            dense = (border + border.T) / (2 * w)
            ways.append(np.linalg.solve(np.diag(dense.sum(axis=1)) - dense + 1e-3 * np.eye(k), over))
        tries = [lead - np.clip(way * far * stride, -0.5, 0.5) for way in ways for far in (1, 0.5, 0.25, 0.1)]
    return np.array(best[1])


def fit_topics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Topics | None:
    """Topics of all documents; None where docs have a topic column."""
    return None if "topic" in docs.columns else fit_cells(written(word_cells(docs, id_col, text_col), "topic-cells", **PLAIN))


def fit_cells(cells: DataFrame) -> Topics:
    """Topics of all rows of word_cells."""
    weight, n = _word_weights(cells)
    none = Topics(weight, {"": np.zeros(BUCKETS)}, np.zeros((1, BUCKETS)), np.zeros(1))
    if not n:
        return none
    frequent = cells.groupBy("lang").count().where((F.col("count") * MOST_LANGS >= n) & (F.col("lang") != ""))
    langs = ["", *sorted(r.lang for r in frequent.select("lang").collect())]  # MOST_LANGS at most
    means = _language_means(cells, weight, langs)
    profiles = written(profiles_of(cells, weight, langs, means), "topic-profiles", **PLAIN)
    model = Topics(weight, dict(zip(langs, means)), none.centres, none.lead)
    if profiles.select("heads").limit(1).count():
        centres = _centres(profiles, means, weight)
        model.centres, model.lead = centres / ONE, _leads(profiles, means, weight, centres)
    return model
