"""Exact Jaccard join on word shingles, as components of the link graph.

Texts become sets of hashed shingles, and equal sets one node.  Two sets with
100 * |x & y| >= 75 * |x | y| share an element among the first
|x| - ceil(3/4 |x|) + 1 of each in any common order, so only such prefixes are
shuffled.  The order puts shingles that recur within tasks last, which keeps tiles
small; any order is right, so neither how they were counted nor the bound on their
list can cost a link.

Nodes that share a prefix element form a tile.  First each node is compared with
the likeliest leader of its tiles.  Then only tiles whose members still lie in
different components go on: they are split by size bands a link can join, tiles of
one leader are united where that lessens the work, hashed bitmaps bound every
overlap from above, and members that no bound rules out are compared by
intersecting sorted arrays.  A task joins its own findings as it goes and passes on
members and at most one link for each, never pairs.

Rules.  Null or wordless text: empty set, linked with nothing.  Equal sets link.
Rows that repeat an id count as one document with the links of all of them.  A
null id is linked with nothing and is its own null component.  An empty table
gives an empty table.  Texts are read whole.  The id must be an integer column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileledger.llm.graph import components
from fileledger.llm.kernel import mix, ragged, shingles, slices, sorted_sets, split_words
from fileledger.sources.scratch import written

SIZE = 5
#: Shingles met this often, as far as tasks see, come last; HEAVY_MOST of them are broadcast.
HEAVY_AT = 16
HEAVY_MOST = 1 << 19
#: Rows of a batch of shingles that are counted together.
COUNT_AT_ONCE = 1 << 20
#: Tiles of shingles met more often than this are dealt into salted parts.
SALT_ROWS = 4096
COPY_SALTS = 32
BITMAP_BITS = (512, 16384)
LEADERS = 3
#: Nodes of one leader that a task compares, and nodes and shingles of one block of a tile.
HOME_DOCS = 512
BLOCK_DOCS = 512
BLOCK_SHINGLES = 1 << 20
PAIRS_AT_ONCE = 100_000
#: Ratio of size bands; a little over 4/3, so that linked sets lie in one band or in neighbours.
BAND = 1.34
FILTER_BITS = 1 << 26
_U = np.uint64


def _needed(n):
    """Least overlap with an equal or larger set: ceil(3 n / 4)."""
    return (3 * n + 3) // 4


def text_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By slice: its first row, distinct 63-bit shingle hashes in order, bounds by row."""
    for piece in slices(column):
        words = split_words(piece, fold_case=True)
        values, owner = shingles(words, len(piece), SIZE, short_whole=True)
        yield piece.first, *sorted_sets(values >> _U(1), owner, len(piece))


def _set_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set: sums of mixed members."""
    sums = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ _U(salt)))])
        sums.append(run[bounds[1:]] - run[bounds[:-1]])
    return sums[0], sums[1]


def _survey(docs: DataFrame) -> DataFrame:
    """Rows (id, n, k1, k2, bits) of every document, and rows (null id, count, shingle) of shingles met twice in COUNT_AT_ONCE."""
    names = ["is_doc", "id", "n", "k1", "k2", "bits"]

    def counted(seen: list[np.ndarray]) -> pa.RecordBatch:
        all_seen = np.concatenate(seen) if seen else np.zeros(0, np.uint64)
        all_seen.sort()
        first = np.flatnonzero(np.append(True, all_seen[1:] != all_seen[:-1])) if len(all_seen) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(all_seen)))
        shared, count = all_seen[first[count > 1]].astype(np.int64), count[count > 1]
        none = pa.nulls(len(shared), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(shared), bool)), none, pa.array(count), pa.array(shared), none, pa.nulls(len(shared), pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for b in batches:
            ids = b.column(0)
            for first, values, bounds in text_sets(b.column(1)):
                n, (k1, k2) = np.diff(bounds), _set_keys(values, bounds)
                own = ids.slice(first, len(n))
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), bool)), own, *(pa.array(x.astype(np.int64)) for x in (n, k1, k2)), pa.array(bitmaps(values, bounds), pa.binary())], names=names)
                seen.append(values)
                held += len(values)
                if held > COUNT_AT_ONCE:
                    yield counted(seen)
                    seen, held = [], 0
        yield counted(seen)

    return docs.mapInArrow(run, "is_doc boolean, id bigint, n bigint, k1 bigint, k2 bigint, bits binary")


def _prefixes(docs: DataFrame, heavy) -> DataFrame:
    """(shingle, salt, node, n): the prefix of each set, once for equal sets of a batch; salt is -1 where the tile is not dealt into parts."""
    names = ["shingle", "salt", "node", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = heavy.value
        for b in batches:
            known: set[tuple[int, int]] = set()
            for _, values, bounds in text_sets(b.column(1)):
                n = np.diff(bounds)
                at = np.minimum(np.searchsorted(last, values), max(len(last) - 1, 0))
                is_last = last[at] == values if len(last) else np.zeros(len(values), bool)
                part = np.where(is_last, parts[at], 1) if len(last) else np.ones(len(values), np.int32)
                owner = np.repeat(np.arange(len(n)), n)
                k1, k2 = _set_keys(values, bounds)
                order = np.lexsort((values, is_last, owner))
                fresh = np.zeros(len(n), bool)
                for i, key in enumerate(zip(k1.tolist(), k2.tolist())):
                    if n[i] and key not in known:
                        known.add(key)
                        fresh[i] = True
                take = np.where(fresh, n - _needed(n) + 1, 0)
                pick = order[ragged(bounds[:-1], take)]
                node, part = np.repeat(k1, take), part[pick]
                salt = np.where(part > 1, (mix(node) % part.astype(np.uint64)).astype(np.int32), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (values[pick].astype(np.int64), salt, node.astype(np.int64), np.repeat(n, take).astype(np.int32))], names=names)

    return docs.mapInArrow(run, "shingle bigint, salt int, node bigint, n int")


def _tiles(entries: DataFrame) -> DataFrame:
    """(shingle, salt, node, n, leader) of entries whose shingle another node has too, each once.

    Streams over rows sorted by tile and size and holds one batch.  leader: the
    smallest member of the tile, as far as the batch shows, that is not too small.
    Members of salted tiles stay even where they are alone in their part.
    """
    names = ["shingle", "salt", "node", "n", "leader"]

    def paired(s, salt, node, n, first_shared: bool, hold: bool) -> pa.RecordBatch:
        same = (s[1:] == s[:-1]) & (salt[1:] == salt[:-1])
        keep = salt >= 0
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= first_shared
        if hold:
            keep[-1] = False
        run_no = np.concatenate([[0], np.cumsum(~same)])
        leader = node[np.searchsorted(run_no * (1 << 32) + n, run_no * (1 << 32) + _needed(n.astype(np.int64)))]
        at = np.flatnonzero(keep)
        return pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (s, salt, node, n, leader)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shared = None, False
        for b in batches:
            rows = [b.column(c).to_numpy() for c in ("shingle", "salt", "node", "n")]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
            if not len(rows[0]):
                continue
            fresh = np.ones(len(rows[0]), bool)
            fresh[1:] = np.logical_or.reduce([r[1:] != r[:-1] for r in rows])
            rows = [r[fresh] for r in rows]
            yield paired(*rows, shared, True)
            if len(rows[0]) > 1:
                shared = bool(rows[0][-1] == rows[0][-2] and rows[1][-1] == rows[1][-2])
            held = [r[-1:] for r in rows]
        if held is not None:
            yield paired(*held, shared, False)

    return entries.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "n", "node").mapInArrow(run, "shingle bigint, salt int, node bigint, n int, leader bigint")


def bitmaps(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set the parity of the members that hash to each bit; more bits for larger size bands.

    Bits that differ between two sets belong to members of only one of them, and a
    bitmap folds to half its size by xor of its halves.
    """
    n = np.diff(bounds)
    width = np.clip(2 ** np.ceil(np.log2(np.maximum(2 * n, 1))), *BITMAP_BITS).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(width)])
    at = np.repeat(begin[:-1], n) + (values & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8)).tobytes()
    return [packed[s // 8 : e // 8] for s, e in zip(begin[:-1].tolist(), begin[1:].tolist())]


def may_link(n: np.ndarray, bits: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n members with these bitmaps can link, for each i with j, as far as sizes and bitmaps tell.

    Two sets share at most (n + m - differing bits) / 2 members.  Bitmaps are
    compared in the width of the shorter one.
    """
    out = 4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])
    width = np.array([len(x) for x in bits])
    least = np.minimum(width[i], width[j])
    for w in np.unique(least[out]).tolist():
        pairs = np.flatnonzero(out & (least == w))
        rows, place = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
        folded = np.empty((len(rows), w // 8), np.uint64)
        for size in np.unique(width[rows]).tolist():
            of = np.flatnonzero(width[rows] == size)
            a = np.frombuffer(b"".join([bits[r] for r in rows[of].tolist()]), np.uint64).reshape(len(of), -1)
            while a.shape[1] * 8 > w:
                a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
            folded[of] = a
        left, right = place[: len(pairs)], place[len(pairs) :]
        step = max(1, (1 << 22) // w)
        for s in range(0, len(pairs), step):
            k = pairs[s : s + step]
            total = n[i[k]].astype(np.int64) + n[j[k]]
            differ = np.bitwise_count(folded[left[s : s + step]] ^ folded[right[s : s + step]]).sum(axis=1, dtype=np.int64)
            most = (total - differ) // 2
            out[k] = 100 * most >= 75 * (total - most)
    return out


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    total = len(x) + len(y)
    if not len(x) or not len(y) or 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= 75 * (total - common)


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b, ...) of nodes less those that size or bitmaps rule out."""
    names = pairs.columns
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"_n{k}"), F.col("bits").alias(f"_bits{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.concatenate([b.column("_na").to_numpy(), b.column("_nb").to_numpy()])
            at = np.arange(b.num_rows)
            keep = may_link(n, b.column("_bitsa").to_pylist() + b.column("_bitsb").to_pylist(), at, at + b.num_rows)
            yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names=names).filter(pa.array(keep))

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select(*names, "_na", "_nb", "_bitsa", "_bitsb").mapInArrow(run, pairs.schema).distinct()


def likely_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (id, ...) without most of those whose id is not in ids, by one broadcast bitmap of FILTER_BITS at most.

    It only lessens what a join with ids has to move: none that is in ids is lost, whatever the table's size.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    rows = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for bucket, bits in rows.collect():  # FILTER_BITS / 32768 rows at most
        bitmap[bucket * 4096 : bucket * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b.schema.names) - 1
            bucket, at = b.column(n - 1).to_numpy(), b.column(n).to_numpy()
            keep = (shared.value[bucket * 4096 + at // 8] >> (at % 8).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays(b.columns[: n - 1], names=b.schema.names[: n - 1]).filter(pa.array(keep.astype(bool)))

    return docs.withColumns({"_bucket": F.bitmap_bucket_number(bit), "_at": F.bitmap_bit_position(bit)}).mapInArrow(run, docs.schema)


#: A tile is named by k, band and kind; x and y are the two blocks of its members that a task compares.
_TILE = ["k", "band", "kind", "x", "y"]


def _dealt(members: DataFrame, parts: Column) -> DataFrame:
    """members (k, band, kind, ..., rep) with block, x and y: each tile as all pairs of its blocks, `parts` (an aggregate) many."""
    load = members.groupBy("k", "band", "kind").agg(parts.cast("int").alias("parts")).where("parts > 1")
    mates = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("x"), F.greatest(i, F.col("block")).alias("y")))
    dealt = members.join(load, ["k", "band", "kind"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    return dealt.withColumn("m", F.explode(mates)).select(*members.columns, "block", "m.x", "m.y")


def _alive(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those members (k, band, kind, low, n, rep, component) of tiles that may link with one of another component, by size and bitmaps."""
    names = members.columns
    rows = _dealt(members, F.ceil(F.count(F.lit(1)) / BLOCK_DOCS)).join(nodes.select("rep", "n", "bits"), ["rep", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def survivors(b: pa.RecordBatch) -> pa.RecordBatch:
            n, component, block = (b.column(c).to_numpy() for c in ("n", "component", "block"))
            low = b.column("low").to_numpy(zero_copy_only=False)
            across = b.column("x").to_numpy() != b.column("y").to_numpy()
            new = _starts(b)
            tile = np.cumsum(new) - 1
            at = np.arange(len(n))
            first = np.searchsorted(tile * (1 << 32) + n, tile * (1 << 32) + _needed(n.astype(np.int64)))
            keep, bits = np.zeros(len(n), bool), b.column("bits").to_pylist()
            for i, j in _pairs(at, first):
                ok = (component[i] != component[j]) & ~(low[i] & low[j]) & (~across[i] | (block[i] != block[j])) & ~(keep[i] & keep[j])
                i, j = i[ok], j[ok]
                ok = may_link(n, bits, i, j)
                keep[i[ok]] = keep[j[ok]] = True
            return b.select(names).filter(pa.array(keep))

        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if b.num_rows else held
            if not b.num_rows:
                continue
            cut = int(np.flatnonzero(_starts(b))[-1])
            if cut:
                yield survivors(b.slice(0, cut))
            held = b.slice(cut)
        if held is not None:
            yield survivors(held)

    rows = rows.select(*names, "block", "x", "y", "bits").repartition(*_TILE).sortWithinPartitions(*_TILE, "n", "rep")
    return rows.mapInArrow(run, members.schema).distinct()


def _starts(b: pa.RecordBatch) -> np.ndarray:
    """Whether each row is the first of its tile."""
    new = np.ones(b.num_rows, bool)
    new[1:] = False
    for c in _TILE:
        x = b.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def _pairs(at: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each at[k] with first[k]..at[k]-1, PAIRS_AT_ONCE or one row's at a time."""
    count = at - first
    ends = np.cumsum(count)
    begin = 0
    while begin < len(at):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
        yield np.repeat(at[begin:end], count[begin:end]), ragged(first[begin:end], count[begin:end])
        begin = end


@dataclass
class _Member:
    values: np.ndarray
    id: int
    component: int
    low: bool
    block: int


def _tile_links(members: list[_Member], across: bool) -> list[tuple[int, int]]:
    """Links (a, b) between members of different components, enough to join all that link.

    A member is first compared with the one that last linked, so a tile of copies
    takes one comparison for each.
    """
    members = sorted(members, key=lambda m: len(m.values))
    n = np.array([len(m.values) for m in members])
    label = np.unique(np.array([m.component for m in members]), return_inverse=True)[1]
    low, block = np.array([m.low for m in members]), np.array([m.block for m in members])
    bounds = np.concatenate([[0], np.cumsum(n)])
    bits = bitmaps(np.concatenate([m.values for m in members]), bounds) if len(members) > 3 else None
    out: list[tuple[int, int]] = []
    hub = 0

    def meets(i: int, j: int) -> bool:
        if members[i].id == members[j].id or not linked(members[i].values, members[j].values):
            return False
        out.append((members[i].id, members[j].id))
        label[label == label[i]] = label[j]
        return True

    for i in range(1, len(members)):
        allowed = ~(low[:i] & low[i])
        if across:
            allowed &= block[:i] != block[i]
        if label[hub] != label[i] and allowed[hub]:
            meets(i, hub)
        while True:
            first = int(np.searchsorted(n, _needed(int(n[i]))))
            open_ = np.flatnonzero(allowed[first:i] & (label[first:i] != label[i])) + first
            if len(open_) and bits is not None:
                open_ = open_[may_link(n, bits, np.full(len(open_), i), open_)]
            met = next((j for j in open_.tolist() if meets(i, j)), None)
            if met is None:
                break
            hub = met
    return out


def _exact(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of members (k, band, kind, x, y, block, low, rep, component) of tiles, by their texts; a task holds the sets of one tile."""
    ids = written(members, "shingle-members")
    texts = likely_in(docs, ids.select(F.col("rep").alias("id")).distinct())
    rows = texts.join(ids, texts["id"] == ids["rep"]).select(*_TILE, "block", "low", "rep", "component", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, []

        def found(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t[k] for t in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in _TILE)))
            block, low, rep, component = (b.column(c).to_pylist() for c in ("block", "low", "rep", "component"))
            links: list[tuple[int, int]] = []
            for first, values, bounds in text_sets(b.column(len(b.schema.names) - 1)):
                for i in range(len(bounds) - 1):
                    r = first + i
                    if keys[r] != key:
                        links += _tile_links(tile, key[3] != key[4]) if len(tile) > 1 else []
                        key, tile = keys[r], []
                    tile.append(_Member(values[bounds[i] : bounds[i + 1]].copy(), rep[r], component[r], low[r], block[r]))
            yield found(links)
        if len(tile) > 1:
            yield found(_tile_links(tile, key[3] != key[4]))

    return rows.repartition(*_TILE).sortWithinPartitions(*_TILE).mapInArrow(run, "a bigint, b bigint").distinct()


def _copies(sets: DataFrame) -> DataFrame:
    """Links (a, b) of equal sets: to the least of a salted part of the group, and from there to the least of all."""
    keys = ["k1", "k2", "n"]
    named = sets.select("id", *keys, F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS)).alias("salt"))
    part = named.groupBy(*keys, "salt").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("rows"))
    whole = part.groupBy(*keys).agg(F.min("b").alias("rep"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    inner = named.join(part.where("rows > 1"), [*keys, "salt"]).select(F.col("id").alias("a"), "b")
    outer = part.join(whole, keys).select(F.col("b").alias("a"), F.col("rep").alias("b"))
    return inner.unionByName(outer).where("a <> b").distinct()


def _home_members(tiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node with its likeliest leader, as members of that leader's tile in parts of HOME_DOCS nodes or BLOCK_SHINGLES shingles."""
    stars = tiles.where("node <> leader").groupBy(F.col("node").alias("b"), F.col("leader").alias("a")).agg(F.count(F.lit(1)).alias("tiles"))
    likeliest = Window.partitionBy("b").orderBy(F.desc("tiles"), "a")
    stars = stars.withColumn("_k", F.row_number().over(likeliest)).where(F.col("_k") <= LEADERS).select("a", "b", "tiles")
    best = _plausible(stars, nodes).groupBy("b").agg(F.max_by("a", F.struct("tiles", -F.col("a"))).alias("a"))
    best = written(best.join(nodes.select(F.col("node").alias("b"), "n"), "b").select("a", "b", "n"), "shingle-homes")
    load = best.groupBy("a").agg(F.ceil(F.greatest(F.count(F.lit(1)) / HOME_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    own = best.join(load, "a").select(F.col("a").alias("k"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("band"), F.col("b").alias("node"))
    lead = load.select(F.col("a").alias("k"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("band"), F.col("a").alias("node"))
    zero = F.lit(0)
    return own.unionByName(lead).join(nodes.select("node", "rep"), "node").select("k", "band", zero.alias("kind"), zero.alias("x"), zero.alias("y"), zero.alias("block"), F.lit(False).alias("low"), "rep", F.col("rep").alias("component")).distinct()


def _banded(t: DataFrame) -> DataFrame:
    """(shingle, band, leader, rows, low, n, rep, component) of size-banded tiles of (shingle, n, rep, component) with members in more than one component.

    Each node is in its own band and, as low, in the next one.  leader: the least
    rep of the tile; rows: how many it has.  Streams over rows sorted by shingle and
    holds one shingle's.
    """
    names = ["shingle", "band", "leader", "rows", "low", "n", "rep", "component"]

    def found(shingle, n, rep, component) -> pa.RecordBatch:
        own = np.floor(np.log(n) / np.log(BAND)).astype(np.int32)
        twice = lambda x: np.concatenate([x, x])
        low = np.arange(2 * len(n)) >= len(n)
        band = np.concatenate([own, own + 1]).astype(np.int32)
        order = np.lexsort((band, twice(shingle)))
        cols = [x[order] for x in (twice(shingle), band, low, twice(n), twice(rep), twice(component))]
        new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(order)))
        least, most = np.minimum.reduceat(cols[5], begin), np.maximum.reduceat(cols[5], begin)
        keep = np.repeat((least != most) & ~np.logical_and.reduceat(cols[2], begin), size)
        leader, rows = np.repeat(np.minimum.reduceat(cols[4], begin), size), np.repeat(size, size)
        s, band, low, n, rep, component = cols
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (s, band, leader, rows, low, n, rep, component)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = [c.to_numpy() for c in b.columns]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield found(*(r[:cut] for r in rows))
            held = [r[cut:] for r in rows]
        if held is not None:
            yield found(*held)

    return t.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(run, "shingle bigint, band int, leader bigint, rows bigint, low boolean, n int, rep bigint, component bigint")


def _banded_by_parts(t: DataFrame) -> DataFrame:
    """The same for tiles that are dealt into salted parts, (shingle, salt, ...): aggregated by part first, so no tile is one task."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("int")
    t = t.withColumn("_b", F.explode(F.array(F.lit(0), F.lit(1)))).select("shingle", "salt", "n", "rep", "component", (band + F.col("_b")).alias("band"), (F.col("_b") == 1).alias("low"))
    part = t.groupBy("shingle", "salt", "band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("low").alias("all_low"), F.min("rep").alias("leader"), F.count(F.lit(1)).alias("rows"))
    whole = part.groupBy("shingle", "band").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("all_low").alias("all_low"), F.min("leader").alias("leader"), F.sum("rows").alias("rows"))
    keys = part.select("shingle", "salt", "band").join(whole.where("least <> most and not all_low").select("shingle", "band", "leader", "rows"), ["shingle", "band"])
    return t.join(keys, ["shingle", "salt", "band"]).select("shingle", "band", "leader", "rows", "low", "n", "rep", "component")


def _mixed_members(tiles: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Members (k, band, kind, low, n, rep, component) of size-banded tiles whose members lie in more than one component.

    Two nodes of a shingle's tile also meet in the tile of its least node, so tiles of
    one leader are united where their union is not much more to compare than they are.
    """
    own = nodes.select("node", "rep").join(found, F.col("rep") == found["id"], "left").select("node", "rep", F.coalesce("component", "rep").alias("component"))
    t = tiles.select("shingle", "salt", "node", "n").join(own, "node")
    t = _banded(t.where("salt < 0").select("shingle", "n", "rep", "component")).unionByName(_banded_by_parts(t.where("salt >= 0")))
    t = written(t, "shingle-banded")
    united = t.groupBy("leader", "band", "low", "n", "rep", "component").agg(F.sum("rows").alias("work"))
    united = written(united, "shingle-united")
    work = united.groupBy("leader", "band").agg(F.count(F.lit(1)).cast("double").alias("rows"), F.sum("work").cast("double").alias("work"))
    apart = written(work.where("rows * rows > 4 * work").select("leader", "band"), "shingle-apart")
    one = united.join(apart, ["leader", "band"], "left_anti").select(F.col("leader").alias("k"), "band", F.lit(0).alias("kind"), "low", "n", "rep", "component")
    if apart.isEmpty():
        return one
    each = t.join(apart, ["leader", "band"], "left_semi").select(F.col("shingle").alias("k"), "band", F.lit(1).alias("kind"), "low", "n", "rep", "component")
    return one.unionByName(each.distinct())


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    survey = written(_survey(slim), "shingle-survey")
    met = survey.where("not is_doc").groupBy("k1").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_AT).orderBy(F.desc("n"), "k1").limit(HEAVY_MOST).orderBy("k1").toPandas()
    parts = np.ceil(met["n"].to_numpy() / SALT_ROWS).astype(np.int32)
    heavy = docs.sparkSession.sparkContext.broadcast((met["k1"].to_numpy().astype(np.uint64), parts))
    sets = survey.where("is_doc").select("id", "n", "k1", "k2", "bits")

    named, known = sets.where("n > 0 and id is not null"), slim.where("id is not null")
    nodes = written(named.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.min("bits").alias("bits")).select(F.col("k1").alias("node"), "n", "rep", "bits"), "shingle-nodes")
    copies = written(_copies(named), "shingle-copies")
    tiles = written(_tiles(_prefixes(known, heavy)), "shingle-tiles")
    links = copies.unionByName(written(_exact(_home_members(tiles, nodes), known), "shingle-links"))
    found = components(links).select(F.col("node").alias("id"), "component")

    members = written(_alive(_mixed_members(tiles, nodes, found), nodes), "shingle-alive")
    if not members.isEmpty():
        dealt = _dealt(members, F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_DOCS))).drop("n")
        links = links.unionByName(written(_exact(dealt, known), "shingle-links"))
        found = components(links).select(F.col("node").alias("id"), "component")
    return sets.select("id", F.col("n").alias("n_shingles")).join(found, "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
