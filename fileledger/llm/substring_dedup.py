"""Removal of long byte strings that occur more than once, by blockwise suffix sorting.

Every 400-byte window of a text has an anchor: the least-hashed 64-byte string in
it, which depends on the window's bytes alone.  Neighbouring windows with one
anchor form a block, and equal windows lie in blocks of equal anchors, so the
anchor is a suffix bucket and buckets can be handled one by one.  Digests thin
them out first: blocks whose anchor stands nowhere else are dropped, and equal
blocks are sorted as one that is known to repeat.  Where different blocks remain
in a bucket (at the edges of shared passages) their bytes are gathered and their
suffixes are sorted: blocks are laid out with anchors on multiples of 7, suffixes
at cover positions (0, 1 and 3 modulo 7) are ranked once, by doubling, before the
others, and every suffix is then compared by its first bytes, the ranks of two cover
positions and its last bytes, so a tie of any length costs no more.  Buckets of
very many different blocks are split by the windows' digests instead.

The same sort finds passages: runs of more than 50 words that also stand in
another document, whatever their length in bytes and the space between words.
There a symbol is a word, as 4 bytes of its hash.  Passages are counted, not cut.

Rules.  Null text is empty and nothing is removed from it; texts shorter than a
window have none; windows never cross documents; equal windows inside one text
count as repeats (but make no passage); a repeated row is another copy of its
text, so both go; where an id has several texts, each is cut by its own spans.  An
empty table gives an empty table; extra columns are not read.  The id must be an
integer column; rows with a null id keep their whole text and count as no copy of
others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.llm.kernel import Slice, byte_view, mix, ragged, sliding_hashes, slices, split_words, text_column
from fileledger.sources.scratch import written

PIECE = 1 << 20
COVER_PERIOD = 7
COVER = (0, 1, 3)
#: Steps from a position (modulo the period) to the next cover position.
COVER_STEP = np.array([next(k for k in range(COVER_PERIOD) if (c + k) % COVER_PERIOD in COVER) for c in range(COVER_PERIOD)])
#: Steps back from a position to the cover position before it.
COVER_BACK = np.array([next(k for k in range(COVER_PERIOD) if (c - k) % COVER_PERIOD in COVER) for c in range(COVER_PERIOD)])
WIDE_BUCKET = 4096
SORT_BYTES = 1 << 20
BLOCKS_AT_ONCE = 100_000
SALTS = 16
PASSAGE_WORDS = 51
_U = np.uint64


@dataclass(frozen=True)
class Unit:
    """What a text is a sequence of: bytes, or words as `width` bytes of their hashes; window and anchor are counted in them."""

    number: int
    width: int
    window: int
    anchor: int

    def symbols(self, piece: Slice, anchors: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Bytes of the symbols, bounds by document in symbols, and (with anchors) the hash of the anchor that starts at each symbol."""
        if self.number == 0:
            return piece.data, piece.bounds, sliding_hashes(piece.data, self.anchor) if anchors else None
        words, h = split_words(piece), None
        if anchors:
            h = np.zeros(max(0, len(words.hash) - self.anchor + 1), np.uint64)
            for j in range(self.anchor):
                h = h * _U(0x9E3779B97F4A7C15) + words.hash[j : j + len(h)]
            h = mix(h)
        return words.hash.astype(np.uint32).view(np.uint8), words.by_doc, h


def units(window: int, passage_words: int) -> list[Unit]:
    return [Unit(0, 1, window, 64), Unit(1, 4, passage_words, 8)]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(out) - (width - have)], out[width - have :])


def blocks_of(h: np.ndarray, bounds: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(document, first window start, last window start, anchor position, anchor hash) of each block of symbols with anchor hashes h."""
    empty = np.zeros(0, np.int64)
    if bounds[-1] < unit.window:
        return empty, empty, empty, empty, empty.astype(np.uint64)
    least = _sliding_least((h & ~_U(PIECE * 2 - 1)) | np.arange(len(h), dtype=np.uint64), unit.window - unit.anchor + 1)
    count = np.maximum(np.diff(bounds) - unit.window + 1, 0)
    full = count > 0
    step = np.zeros(len(least) + 1, np.int8)
    step[bounds[:-1][full]] = 1
    step[bounds[:-1][full] + count[full]] = -1
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    least &= _U(PIECE * 2 - 1)
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    doc = np.searchsorted(bounds, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(least)), bounds[doc] + count[doc]) - 1
    anchor = least[first].astype(np.int64)
    return doc, first, last, anchor, h[anchor]


def _pieces(data: np.ndarray, bounds: np.ndarray, h: np.ndarray, unit: Unit) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols before, data, bounds, h) in pieces of a bounded length; a long document comes in pieces that overlap by a window less a symbol."""
    n = int(bounds[-1])
    if n <= PIECE or len(bounds) > 2:
        yield 0, data, bounds, h
        return
    for s in range(0, n - unit.window + 1, PIECE - unit.window):
        e = min(n, s + PIECE - 1)
        yield s, data[s * unit.width : e * unit.width], np.array([0, e - s]), h[s : e - unit.anchor + 1]


_BLOCK = "unit int, id bigint, h bigint, s int, e int, a int, key bigint, d bigint, times int"


def _block_rows(docs: DataFrame, kinds: list[Unit]) -> DataFrame:
    """Blocks (unit, id, h, s, e, a, key, d, times) of docs (id, h, text), positions in symbols, with their digest.

    Of blocks met twice among BLOCKS_AT_ONCE, by other documents for passages, the
    first has times > 1 and the others come as plain spans (key null).
    """
    schema = pa.schema([("unit", pa.int32()), ("id", pa.int64()), ("h", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("a", pa.int32()), ("key", pa.int64()), ("d", pa.int64()), ("times", pa.int32())])

    def rows(number: int, parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        id_, h, s, e, a, key, digest = (np.concatenate(c) for c in zip(*parts))
        if not len(id_):
            return
        order = np.lexsort((s, id_, digest, key))
        new = np.ones(len(order), bool)
        new[1:] = (digest[order[1:]] != digest[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
        begin = np.flatnonzero(new)
        times = np.diff(np.append(begin, len(order)))
        if number:  # ids are in order: one document alone makes no passage
            one = id_[order[begin]] == id_[order[np.append(begin[1:], len(order)) - 1]]
            new |= np.repeat(one, times)
            times = np.repeat(np.where(one, 1, times), np.where(one, times, 1))
        lead = order[new]
        n = len(lead)
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x), f.type) for x, f in zip((np.full(n, number, np.int32), id_[lead], h[lead], s[lead], e[lead], a[lead], key[lead], digest[lead], times), schema)], schema=schema)
        rest = order[~new]
        if len(rest):
            i, k, s, e = merged(id_[rest], h[rest], s[rest], e[rest])
            n = len(i)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((np.full(n, number, np.int32), i, k, s, e), schema)] + [pa.nulls(n, f.type) for f in list(schema)[5:]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in kinds]
        for b in batches:
            ids, hashes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for whole in slices(b.column(2)):
                for k, unit in enumerate(kinds):
                    for before, data, bounds, h in _pieces(*unit.symbols(whole), unit):
                        doc, s, last, a, key = blocks_of(h, bounds, unit)
                        view, w = data.tobytes(), unit.width
                        digest = b"".join([hashlib.blake2b(view[i * w : (j + unit.window) * w], digest_size=8).digest() for i, j in zip(s.tolist(), last.tolist())])
                        of, off = whole.first + doc, before - bounds[doc]
                        held[k].append((ids[of], hashes[of], s + off, last + unit.window + off, a - s, key.astype(np.int64), np.frombuffer(digest, np.int64)))
                    if sum(len(x[0]) for x in held[k]) > BLOCKS_AT_ONCE:
                        yield from rows(unit.number, held[k])
                        held[k] = []
        for k, unit in enumerate(kinds):
            if held[k]:
                yield from rows(unit.number, held[k])

    return docs.mapInArrow(run, _BLOCK)


def merged(ids: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each (id, h) joined where they overlap or touch."""
    if not len(s):
        return ids, h, s, e
    order = np.lexsort((s, h, ids))
    ids, h, s, e = ids[order], h[order], s[order].astype(np.int64), e[order].astype(np.int64)
    other = (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])
    group = np.concatenate([[0], np.cumsum(other)])
    reach = np.maximum.accumulate(e + group * (1 << 40)) - group * (1 << 40)
    new = np.ones(len(s), bool)
    new[1:] = other | (s[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return ids[first], h[first], s[first], reach[np.append(first[1:], len(s)) - 1]


def _packed(text: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The n symbols (bytes or 4-byte numbers) from each position, as numbers of 8 bytes in the same order."""
    width = text.dtype.itemsize
    out = []
    for begin in range(0, n, 8 // width):
        key = np.zeros(len(at), np.uint64)
        for k in range(begin, min(n, begin + 8 // width)):
            key = (key << _U(8 * width)) | text[at + k].astype(np.uint64)
        out.append(key)
    return out


def _dense(x: np.ndarray) -> np.ndarray:
    """Rank of each number among the different ones."""
    order = np.argsort(x)
    s = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.append(np.zeros(min(1, len(x)), bool), s[1:] != s[:-1]))
    return out


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by keys, the first most significant.  Keys are put together as digits of one number and sorted when the next would not fit."""
    out, span = np.zeros(len(keys[0]), np.int64), 1
    for k in keys:
        k = _dense(k) if k.dtype == np.uint64 and k.max(initial=0) >= 1 << 62 else k.astype(np.int64) - int(k.min(initial=0))
        size = int(k.max(initial=0)) + 1
        if span * size >= 1 << 62:
            out = _dense(out)
            span = int(out.max(initial=0)) + 1
            if span * size >= 1 << 62:
                k = _dense(k)
                size = int(k.max(initial=0)) + 1
        out, span = out * size + k, span * size
    return _dense(out)


def _cover_ranks(text: np.ndarray, length: int, place: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Rank of the `length` symbols (a multiple of the period) from cover positions, at least up to reach symbols behind each place; -1 elsewhere.

    Ranks of 7 symbols become those of 21, 63, ... by putting three together; the
    shorter ones are made only as far as the longer ones look.
    """
    steps = [COVER_PERIOD]
    while steps[-1] < length:
        steps.append(min(3 * steps[-1], length))
    at = np.arange(int(place[0]), len(text) - COVER_PERIOD)
    at = at[np.isin(at % COVER_PERIOD, COVER)]
    left = np.repeat(place + reach, np.diff(np.searchsorted(at, np.append(place, len(text))))) - at
    look = length - np.array(steps)
    rank = np.full(len(text) + length, -1, np.int64)
    for have, done, beyond in zip(steps, [0, *steps], look.tolist()):
        here = at[left + beyond > 0]
        if not done:
            rank[here] = _ranks(*_packed(text, here, COVER_PERIOD))
        else:
            rank[here] = _ranks(rank[here], rank[here + min(done, have - done)], rank[here + have - done])
    return rank


def repeated_windows(bodies: list[bytes], anchors: np.ndarray, buckets: np.ndarray, sure: np.ndarray, window: int, owner: np.ndarray | None = None, width: int = 1) -> list[np.ndarray]:
    """For each block, the window starts (in the block) whose symbols also start at another place of the bucket, or in a block known to repeat.

    With owners, only places of blocks of other owners count.  Symbols are of 1 or 4
    bytes; positions count symbols.
    """
    period, of = COVER_PERIOD, np.dtype(np.uint8 if width == 1 else np.uint32)
    sizes = np.array([len(x) // width for x in bodies])
    place, end = np.zeros(len(bodies), np.int64), 0
    for i, (n, a) in enumerate(zip(sizes.tolist(), anchors.tolist())):
        place[i] = end + (-(end + a)) % period
        end = place[i] + n
    text = np.zeros(end + 2 * period, of)
    for x, p, n in zip(bodies, place.tolist(), sizes.tolist()):
        text[p : p + n] = np.frombuffer(x, of)
    near = int(COVER_STEP.max())
    cover = (window - near) // period * period
    count = sizes - window + 1
    rank = _cover_ranks(text, cover, place, count + window - cover)
    block = np.repeat(np.arange(len(bodies)), count)
    starts = ragged(np.zeros(len(bodies), np.int64), count)
    at = place[block] + starts
    offset = starts - anchors[block]
    # A window is its first symbols, the cover ranks that start first and last in it, and its last symbols.
    late = at + window - cover
    late -= COVER_BACK[late % period]
    group = _ranks(buckets[block], offset, rank[at + COVER_STEP[at % period]], rank[late], *_packed(text, at, near), *_packed(text, at + window - near, near))
    if owner is None:
        again = np.bincount(group)[group] > 1
    else:
        least, most = np.full(len(group), np.iinfo(np.int64).max), np.full(len(group), np.iinfo(np.int64).min)
        np.minimum.at(least, group, owner[block])
        np.maximum.at(most, group, owner[block])
        again = least[group] != most[group]
    known = np.bincount(group, weights=sure[block])
    again = (again | (known[group] > 0)) & ~sure[block].astype(bool)
    return np.split(starts[again], np.searchsorted(block[again], np.arange(1, len(bodies))))


def _resolved(blocks: DataFrame, kinds: list[Unit]) -> DataFrame:
    """(unit, id, h, s, e): repeated windows of blocks (unit, key, id, h, s, a, sure, body), sorted bucket by bucket; holds one run of buckets of about a megabyte."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        unit = kinds[rows[0][0]]
        buckets = np.unique(np.array([r[1] for r in rows]), return_inverse=True)[1]
        owner = np.array([r[2] for r in rows]) if unit.number else None
        hits = repeated_windows([r[7] for r in rows], np.array([r[5] for r in rows]), buckets, np.array([r[6] for r in rows], np.int64), unit.window, owner, unit.width)
        n = np.array([len(x) for x in hits])
        starts = np.concatenate(hits) + np.repeat(np.array([r[4] for r in rows]), n)
        i, h, s, e = merged(np.repeat(np.array([r[2] for r in rows]), n), np.repeat(np.array([r[3] for r in rows]), n), starts, starts + unit.window)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), unit.number, np.int32)), pa.array(i, pa.int64()), pa.array(h, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["unit", "id", "h", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (row[0] != held[-1][0] or size > SORT_BYTES and row[1] != held[-1][1]):
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield solve(held)

    return blocks.repartition("unit", "key").sortWithinPartitions("unit", "key").mapInArrow(run, "unit int, id bigint, h bigint, s int, e int")


def _bodies(docs: DataFrame, wanted: DataFrame, kinds: list[Unit]) -> DataFrame:
    """(unit, key, id, h, s, a, sure, body) of wanted (unit, id, h, s, e, a, key, sure), cut from the texts (id, h, text)."""
    cuts = wanted.groupBy("id", "h").agg(F.collect_list(F.struct("unit", "key", "s", "e", "a", "sure")).alias("cuts"))
    schema = pa.schema([("unit", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("s", pa.int32()), ("a", pa.int32()), ("sure", pa.int32()), ("body", pa.binary())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            ids, hashes, lists = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)
            for whole in slices(b.column(2)):
                seen = [(data, bounds, unit.width) for unit in kinds for data, bounds, _ in [unit.symbols(whole, False)]]
                for i in range(len(whole)):
                    r = whole.first + i
                    for c in lists[r].as_py():
                        data, bounds, w = seen[c["unit"]]
                        rows.append((c["unit"], c["key"], ids[r], hashes[r], c["s"], c["a"], c["sure"], data[(bounds[i] + c["s"]) * w : (bounds[i] + c["e"]) * w].tobytes()))
                    if len(rows) > 5000:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    return docs.join(cuts, ["id", "h"]).select("id", "h", "text", "cuts").mapInArrow(run, "unit int, key bigint, id bigint, h bigint, s int, a int, sure int, body binary")


def _wide(blocks: DataFrame, kinds: list[Unit]) -> DataFrame:
    """(unit, id, h, s, e) of the repeated windows of blocks in buckets too large for one task, found by the digest of each window."""
    schema = pa.schema([("unit", pa.int32()), ("digest", pa.binary()), ("id", pa.int64()), ("h", pa.int64()), ("s", pa.int32()), ("sure", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for number, _, id_, h, s, _, sure, body in zip(*(c.to_pylist() for c in b.columns)):
                w, n = kinds[number].width, kinds[number].window
                rows += [(number, hashlib.blake2b(body[k * w : (k + n) * w], digest_size=16).digest(), id_, h, s + k, sure) for k in range(len(body) // w - n + 1)]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    w = written(blocks.mapInArrow(run, "unit int, digest binary, id bigint, h bigint, s int, sure int"), "repeat-windows")
    times = [F.sum(F.col("sure") + 1).alias("times"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("sure").alias("known")]
    again = (F.col("known") > 0) | F.when(F.col("unit") == 0, F.col("times") > 1).otherwise(F.col("lo") != F.col("hi"))
    whole = [F.sum("times").alias("times"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("known").alias("known")]
    found = _with_group(w, ["unit", "digest"], times, whole, again).where("sure = 0")
    size = F.element_at(F.array(*(F.lit(k.window) for k in kinds)), F.col("unit") + 1)
    return found.select("unit", "id", "h", "s", (F.col("s") + size).cast("int").alias("e"))


def _with_group(rows: DataFrame, keys: list[str], part: list[Column], whole: list[Column], having: Column) -> DataFrame:
    """rows (id, s, ...) with the aggregates of their group, which are made and joined by salted parts: no key is one task, however many rows it has."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id", "s"), F.lit(SALTS)))
    parts = salted.groupBy(*keys, "_salt").agg(*part)
    groups = parts.groupBy(*keys).agg(*whole).where(having)
    return salted.join(parts.select(*keys, "_salt").join(groups, keys), [*keys, "_salt"]).drop("_salt")


def repeated_spans(docs: DataFrame, kinds: list[Unit]) -> DataFrame:
    """(unit, id, h, s, e) of docs (id, h, text): spans of symbols covered by windows that also start elsewhere; spans may overlap."""
    rows = written(_block_rows(docs, kinds), "repeat-blocks")
    blocks = rows.where("key is not null")
    shared = blocks.groupBy("unit", "key").agg(F.sum("times").alias("n"), F.max("times").alias("most"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    shared = written(shared.where("if(unit = 0, n > 1, lo <> hi or most > 1)").select("unit", "key"), "repeat-keys")
    blocks = written(blocks.join(shared, ["unit", "key"], "left_semi"), "repeat-shared")

    place = F.struct("id", "h", "s", "e")
    part = [F.sum("times").alias("n"), F.max("times").alias("most"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min(place).alias("first")]
    whole = [F.sum("n").alias("n"), F.max("most").alias("most"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first")]
    known = _with_group(blocks, ["unit", "key", "d"], part, whole, F.lit(True))
    known = known.withColumn("sure", F.expr("if(unit = 0, n > 1, lo <> hi or most > 1)")).withColumn("stands", ~F.col("sure") | (place == F.col("first")))
    known = written(known.select("unit", "id", "h", "s", "e", "a", "key", F.col("sure").cast("int").alias("sure"), "stands"), "repeat-known")

    wanted = _with_group(known.where("stands").drop("stands"), ["unit", "key"], [F.count(F.lit(1)).alias("kinds")], [F.sum("kinds").alias("kinds")], F.col("kinds") > 1)
    wanted = written(wanted, "repeat-edges")
    narrow = _resolved(_bodies(docs, wanted.where(F.col("kinds") <= WIDE_BUCKET), kinds), kinds)
    spans = rows.where("key is null").select("unit", "id", "h", "s", "e").unionByName(known.where("sure = 1").select("unit", "id", "h", "s", "e")).unionByName(narrow)
    if not wanted.where(F.col("kinds") > WIDE_BUCKET).isEmpty():
        spans = spans.unionByName(_wide(_bodies(docs, wanted.where(F.col("kinds") > WIDE_BUCKET), kinds), kinds))
    return spans


def remove_repeats(docs: DataFrame, window: int = 400, passage_words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept binary, n_passages, n_passage_words) of every row: the bytes left when all repeated strings are cut, and what passages it shares."""
    kinds = units(window, passage_words)
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text")).select("id", "h", "text")
    spans = repeated_spans(slim.where("id is not null"), kinds)
    lists = written(spans.groupBy("id", "h").agg(F.collect_list(F.struct("unit", "s", "e")).alias("spans")), "repeat-spans")

    def covered(spans: list[dict], number: int, n: int) -> np.ndarray:
        stay = np.ones(n + 1, bool)
        for x in spans:
            if x["unit"] == number:
                stay[x["s"] : min(x["e"], n)] = False
        return stay

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = byte_view(text_column(b.column(1)))
            counts, kept = [], []
            for i, spans in enumerate(b.column(2).to_pylist()):
                body = data[bounds[i] : bounds[i + 1]]
                if not spans:
                    counts.append((0, 0, 0, 0)), kept.append(body.tobytes())
                    continue
                stay = covered(spans, 0, len(body))
                passages = covered(spans, 1, max((x["e"] for x in spans if x["unit"] == 1), default=0))
                counts.append((int((~stay).sum()), int(np.count_nonzero(~stay[:-1] & stay[1:])), int(np.count_nonzero(~passages[:-1] & passages[1:])), int((~passages).sum())))
                kept.append(body[stay[:-1]].tobytes())
            removed, n_spans, n_passages, n_words = (pa.array(x, pa.int64()) for x in (zip(*counts) if counts else ([],) * 4))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), removed, n_spans, pa.array(kept, pa.binary()), n_passages, n_words], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept", "n_passages", "n_passage_words"])

    out = f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, n_passages bigint, n_passage_words bigint"
    return slim.join(lists, ["id", "h"], "left").select("id", "text", "spans").mapInArrow(run, out)
