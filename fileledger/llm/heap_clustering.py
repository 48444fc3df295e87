"""Centroid clustering in whole numbers, with heaps of bounds: only vectors whose bound has expired are compared again.

A vector's gap is how much farther its second nearest centroid is than its nearest.
When centroids move, a gap shrinks by no more than the way of the vector's own centroid
plus the longest way of another.  Each cluster adds up these amounts (its offset) and
keeps its vectors in a heap by gap plus the offset at the time: whose key is not above
the offset now may be nearer to another centroid, and such vectors alone are popped,
compared with all centroids and pushed again.

Vectors are written once, in blocks of about BLOCK_BYTES, bucketed by block; the heaps of
a round are a small table of the same buckets, so that a round joins them without an
exchange.  A block sends the sums of what moved between clusters, never its vectors.
Distances and sums are whole numbers and exact; bounds are doubles, kept on the safe
side.  Rounds end early when no centroid has moved, as all later ones would be equal.

Rules.  Kept are vectors of exactly `dimensions` components, none null or non-finite; a
component becomes floor(scale * x), and what is beyond LARGEST is LARGEST (squared
distances are longs).  With fewer vectors than clusters there are as many clusters as
vectors; without a vector the result is empty.  Ties go to the smaller cluster.  Rows that repeat an id, and
rows whose id is null, count each for itself; equal hashes are ordered by components.  Further columns are
not read, and their names do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.sources.scratch import new_path, written


@dataclass(frozen=True)
class Clustering:
    dimensions: int = 64
    clusters: int = 8
    rounds: int = 10
    scale: int = 1024
    seed: str = "3"


BLOCK_BYTES = 1 << 18
#: Bytes of vectors a bucket holds, about: one task's work in a round.
BUCKET_BYTES = 64 << 20
LARGEST = 1 << 27

Heap = list[tuple[float, int]]


def whole_vectors(vectors: DataFrame, cfg: Clustering, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors kept, components as whole numbers."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    bounded = lambda c: F.floor(F.greatest(F.least(c.cast("double") * cfg.scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")
    return vectors.where((F.size(x) == cfg.dimensions) & finite).select(F.col(id_col).alias("id"), F.transform(x, bounded).alias("v"))


def starts(whole: DataFrame, cfg: Clustering) -> np.ndarray:
    """The vectors of least hash, one a cluster."""
    h = F.sha2(F.concat(F.lit(f"{cfg.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = whole.select(h.alias("h"), "v").orderBy("h", "v").limit(cfg.clusters).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), cfg.dimensions)


def blocks_of(whole: DataFrame, cfg: Clustering) -> DataFrame:
    """(block, ids, vectors): whole packed in rows of 32-bit components."""
    most = max(1, BLOCK_BYTES // (4 * cfg.dimensions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                packed = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(0)]))
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, pa.array([packed])], names=["block", "ids", "vectors"])
                number += 1

    return whole.mapInArrow(run, f"block bigint, ids array<{whole.dtypes[0][1]}>, vectors binary")


class BucketedTables:
    """Tables bucketed by block in the shared folder; their names leave the catalog at the end, as with any external table the files stay."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def __enter__(self) -> BucketedTables:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.names.append(f"{name}_{uuid.uuid4().hex}")
        df.write.bucketBy(self.buckets, "block").option("path", new_path(self.spark, name)).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])


def pack_heaps(heaps: list[Heap]) -> bytes:
    """Sizes, then keys and numbers of vectors by heap; the order of a heap is kept, so it need not be built again."""
    sizes = np.array([len(h) for h in heaps], np.int32)
    keys = np.fromiter((e[0] for h in heaps for e in h), np.float64, int(sizes.sum()))
    who = np.fromiter((e[1] for h in heaps for e in h), np.int32, int(sizes.sum()))
    return sizes.tobytes() + keys.tobytes() + who.tobytes()


class Packed:
    """Heaps as packed; one is made a list only when it is popped from or pushed to."""

    def __init__(self, data: bytes, k: int):
        self.sizes = np.frombuffer(data, np.int32, k)
        total = int(self.sizes.sum())
        self.keys = np.frombuffer(data, np.float64, total, 4 * k)
        self.who = np.frombuffer(data, np.int32, total, 4 * k + 8 * total)
        self.ends = np.cumsum(self.sizes)

    def span(self, j: int) -> slice:
        return slice(int(self.ends[j] - self.sizes[j]), int(self.ends[j]))

    def expired(self, j: int, offset: float) -> bool:
        return bool(self.sizes[j]) and self.keys[self.span(j)][0] <= offset

    def heap(self, j: int) -> Heap:
        return list(zip(self.keys[self.span(j)].tolist(), self.who[self.span(j)].tolist()))

    def cluster(self) -> np.ndarray:
        """The cluster of every vector of the block."""
        out = np.empty(len(self.who), np.int32)
        out[self.who] = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        return out


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact, as one column a centroid."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        away = x - c
        out[:, j] = np.einsum("ij,ij->i", away, away)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row (ties: the first) and a gap that is never above the true one."""
    d = squared_distances(x, centroids)
    best = d.argmin(axis=1)
    if len(centroids) == 1:
        return best, np.full(len(x), np.inf)
    near, second = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64)).T
    return best, second - near - 1e-9 * (second + near + 1)


@dataclass
class Round:
    """What a round needs: centroids, and each cluster's offset."""

    centroids: np.ndarray
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scan(self, vectors: bytes, packed: bytes | None) -> tuple[bytes, int, list[dict]]:
        """A block's new heaps, how many of its vectors were compared, and count and sums of what came to (or, below 0, left) each cluster."""
        k, d = self.centroids.shape
        x = np.frombuffer(vectors, np.int32).reshape(-1, d)
        if packed is None:
            popped, old = np.arange(len(x)), np.full(len(x), -1)
            heaps: list[Heap] = [[] for _ in range(k)]
            cluster, gap = nearest(x.astype(np.int64), self.centroids)
            for j in range(k):
                mine = np.flatnonzero(cluster == j)
                heaps[j] = list(zip((gap[mine] + self.offsets[j]).tolist(), mine.tolist()))
                heapq.heapify(heaps[j])
            return pack_heaps(heaps), len(popped), self._moved(x, old, cluster)
        state = Packed(packed, k)
        if not any(state.expired(j, self.offsets[j]) for j in range(k)):
            return packed, 0, []
        heaps = [state.heap(j) for j in range(k)]
        out: list[tuple[int, int]] = []
        for j, heap in enumerate(heaps):
            while heap and heap[0][0] <= self.offsets[j]:
                out.append((heapq.heappop(heap)[1], j))
        popped, old = np.array(out, np.int64).T
        x = x[popped].astype(np.int64)
        cluster, gap = nearest(x, self.centroids)
        for i, j, key in zip(popped.tolist(), cluster.tolist(), (gap + self.offsets[cluster]).tolist()):
            heapq.heappush(heaps[j], (key, i))
        return pack_heaps(heaps), len(popped), self._moved(x, old, cluster)

    def _moved(self, x: np.ndarray, old: np.ndarray, new: np.ndarray) -> list[dict]:
        out = []
        for j in range(len(self.centroids)):
            came, left = (new == j) & (old != j), (old == j) & (new != j)
            if came.any() or left.any():
                sums = x[came].sum(axis=0, dtype=np.int64) - x[left].sum(axis=0, dtype=np.int64)
                out.append({"cluster": j, "n": int(came.sum() - left.sum()), "sums": sums.tolist()})
        return out


_STATE = "block bigint, heaps binary, compared bigint, moved array<struct<cluster: int, n: bigint, sums: array<bigint>>>"
_MOVED = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def _scanner(now: Round) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                heaps, compared, moved = now.scan(b.column(1)[i].as_py(), b.column(2)[i].as_py())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([heaps]), pa.array([compared]), pa.array([moved], _MOVED)], names=["block", "heaps", "compared", "moved"])

    return run


def _with_heaps(blocks: DataFrame, state: DataFrame) -> DataFrame:
    return blocks.join(state.select("block", "heaps").hint("shuffle_hash"), "block")


@dataclass
class Found:
    """Vectors' rows, final centroids, and how many vectors each pass compared with all centroids."""

    rows: DataFrame
    centroids: np.ndarray
    compared: list[int]


def cluster_vectors(vectors: DataFrame, cfg: Clustering = Clustering(), id_col: str = "vec_id", vector_col: str = "embedding") -> Found:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, cfg, id_col, vector_col)
    centroids, n = starts(whole, cfg), whole.count()
    k, d = centroids.shape
    if not k:
        schema = f"`{id_col}` {whole.dtypes[0][1]}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return Found(spark.createDataFrame([], schema), centroids, [])
    with BucketedTables(spark, max(spark.sparkContext.defaultParallelism, -(-n * 4 * d // BUCKET_BYTES))) as tables:
        blocks = tables.written(blocks_of(whole, cfg).repartition(tables.buckets, "block"), "vector_blocks")
        rows, final, compared = _rounds(blocks, centroids, cfg, tables, id_col, whole.dtypes[0][1])
    inertia = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())  # a row each cluster
    named = [(j, inertia.get(j, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, final[j])).encode()).hexdigest()) for j in range(k)]
    by_cluster = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return Found(rows.join(F.broadcast(by_cluster), "cluster").select(id_col, *rows.columns[1:], "cluster_inertia", "inertia", "centroid_sha256"), final, compared)


def _rounds(blocks: DataFrame, centroids: np.ndarray, cfg: Clustering, tables: BucketedTables, id_col: str, id_type: str) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(id_col, cluster, distance) after all rounds, as written; the centroids, and how many vectors each pass compared."""
    k, d = centroids.shape
    counts, sums, offsets, compared = [0] * k, [[0] * d for _ in range(k)], np.zeros(k), []
    state = None
    for step in range(cfg.rounds + 1):
        source = blocks.select("block", "vectors", F.lit(None).cast("binary").alias("heaps")) if state is None else _with_heaps(blocks.select("block", "vectors"), state)
        state = tables.written(source.mapInArrow(_scanner(Round(centroids, offsets)), _STATE), "cluster_heaps")
        compared.append(state.agg(F.sum("compared")).first()[0])
        if step == cfg.rounds:
            break
        moved = state.select(F.explode("moved").alias("m")).select("m.*")
        total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
        for j, at, x in moved.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(total("col")).collect():  # a row each component of a centroid
            sums[j][at] += int(x)
        for j, x in moved.groupBy("cluster").agg(F.sum("n")).collect():
            counts[j] += x
        after = np.array([[s // counts[j] for s in sums[j]] if counts[j] else centroids[j] for j in range(k)], np.int64)
        way = np.array([math.sqrt(sum(int(a) ** 2 for a in row)) for row in after - centroids])
        if not way.any():
            break
        others = np.array([np.delete(way, j).max(initial=0) for j in range(k)])
        centroids, offsets = after, offsets + (way + others) * (1 + 1e-9)

    final = centroids

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = np.frombuffer(b.column(2)[i].as_py(), np.int32).reshape(-1, d)
                cluster = Packed(b.column(3)[i].as_py(), k).cluster()
                away = x - final[cluster]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, 1).flatten(), pa.array(cluster), pa.array(np.einsum("ij,ij->i", away, away))], names=[id_col, "cluster", "distance"])

    return written(_with_heaps(blocks, state).mapInArrow(assigned, f"`{id_col}` {id_type}, cluster int, distance bigint"), "clusters"), final, compared
