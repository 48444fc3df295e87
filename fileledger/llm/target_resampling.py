"""Importance resampling towards a target distribution, over hashed bags of word runs.

Features are all runs of 1 to `longest` consecutive words joined by one space; words
are runs of ASCII letters and digits (A-Z lower-cased) and of anything beyond ASCII.
A feature's bucket is the CRC-32 of its UTF-8 bytes modulo `buckets`.  The features of
a slice of text are grouped by byte length: each length is one matrix of bytes, its
distinct rows are kept, all their CRCs advance one column at a time, and the buckets
are scattered back to where the features stand.

Raw and target texts give counts by bucket (a task sends at most one row a bucket),
their ratio a whole-numbered gain, and the sum of gains a document's weight.  Weight
plus Gumbel noise from a hash of the id is its score; the highest scores are drawn,
which is sampling without replacement by weight.  Ranks come from one sort by range:
a row's place in its range plus the rows of earlier ranges.

Rules.  Null texts have no word, so no feature and weight 0; a document of too few
words has a score but is not drawn.  Ties go to the smaller id; rows that repeat an id
count each for itself.  A null id hashes as the empty id and comes last among ties.
Empty tables give empty tables, an empty target gains from smoothing alone; further
columns, whatever their names, are not read.  Texts are read whole at any length.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.llm.kernel import Slice, ragged, slices, split_words
from fileledger.sources.scratch import written


@dataclass(frozen=True)
class Resampling:
    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[b for b in range(128) if not chr(b).isalnum()]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: The remainders of one byte under the reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


def _remainders() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), table >> np.uint32(1))
    return table


_CRC = _remainders()


def crc_columns(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a matrix of bytes, all rows one column further at a time."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _CRC[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of one row of each kind, and for every row the place of its kind there.  Rows are compared eight bytes at a time."""
    n, width = rows.shape
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    keys = wide.view(np.uint64)
    if keys.shape[1] == 1:
        _, first, which = np.unique(keys[:, 0], return_index=True, return_inverse=True)
        return first, which
    order = np.lexsort(keys.T)
    new = np.ones(n, bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    which = np.empty(n, np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


#: Bytes of a matrix at most, but for one row: longer lists of one length are handled in parts.
MATRIX_BYTES = 4 << 20


def crc_of_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:start+length] for every span."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    cut = np.flatnonzero(np.diff(length[order], prepend=-1))
    for at in np.split(order, cut[1:]) if len(order) else []:
        width = int(length[at[0]])
        step = max(1, MATRIX_BYTES // max(1, width))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            rows = data[start[some][:, None] + np.arange(width)]
            first, which = _distinct(rows)
            out[some] = crc_columns(rows[first])[which]
    return out


@dataclass
class Features:
    """Buckets of the features of a slice and the document of each; the words of each document."""

    bucket: np.ndarray
    doc: np.ndarray
    words: np.ndarray


def features(piece: Slice, cfg: Resampling) -> Features:
    words = split_words(piece, separators=_SEPARATORS)
    length = words.end - words.start
    # All words with one space after each: the runs of any size are spans of this.
    at = np.cumsum(length + 1) - (length + 1)
    text = np.full(int((length + 1).sum()), 32, np.uint8)
    text[ragged(at, length)] = _FOLD[piece.data[ragged(words.start, length)]]
    buckets, docs = [], []
    for size in range(1, cfg.longest + 1):
        first = np.arange(max(0, len(at) - size + 1))
        first = first[words.doc[first] == words.doc[first + size - 1]]
        last = first + size - 1
        crc = crc_of_spans(text, at[first], at[last] + length[last] - at[first])
        buckets.append((crc % np.uint32(cfg.buckets)).astype(np.int64))
        docs.append(words.doc[first])
    return Features(np.concatenate(buckets), np.concatenate(docs), np.diff(words.by_doc))


def bucket_counts(texts: DataFrame, cfg: Resampling = Resampling(), text_col: str = "text") -> DataFrame:
    """(bucket, n) of the features of all texts; buckets without one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cfg.buckets, np.int64)
        for b in batches:
            for piece in slices(b.column(0)):
                total += np.bincount(features(piece, cfg).bucket, minlength=cfg.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    slim = texts.select(F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, cfg: Resampling = Resampling()) -> DataFrame:
    """(bucket, gain) of every bucket: a thousand times the log ratio of its smoothed shares of the target and of the raw features, floored."""
    spark = raw.sparkSession
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(spark.range(cfg.buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t")))
    counts = written(both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")), "resampling-counts")
    total = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + cfg.buckets) / ((F.col("s") + 1) * (F.col("all_t") + cfg.buckets))
    return counts.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain"))


def weigh(docs: DataFrame, gain: np.ndarray, cfg: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_features, weight) of every row of docs, gains by bucket."""
    known = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = known.value
        for b in batches:
            for piece in slices(b.column(1)):
                f, n = features(piece, cfg), len(piece)
                weight = np.bincount(f.doc, by_bucket[f.bucket], n).astype(np.int64)  # doubles hold sums of gains exactly up to 2**53
                yield pa.RecordBatch.from_arrays([b.column(0).slice(piece.first, n), pa.array(f.words), pa.array(np.bincount(f.doc, minlength=n)), pa.array(weight)], names=[id_col, "n_words", "n_features", "weight"])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.dtypes[0][1]}, n_words bigint, n_features bigint, weight bigint")


def _noise(cfg: Resampling, id_col: str):
    """Gumbel noise in thousandths, floored, of the first 32 bits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{cfg.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def draw(weighed: DataFrame, cfg: Resampling = Resampling(), id_col: str = "doc_id") -> DataFrame:
    """weighed with score and rank: 1, 2, 3... for the documents drawn, null for the others."""
    scored = written(weighed.withColumn("score", F.col("weight") + _noise(cfg, id_col)), "resampling-scores")
    enough = F.col("n_words") >= cfg.least_words
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), "n_words", "n_features"]
    # The place in a range and the range itself, written so that no later step sorts again.
    ranged = written(scored.where(enough).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "resampling-order")
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = sorted(ranged.groupBy(part.alias("part")).count().collect())  # a row each range
    before = list(itertools.accumulate((n for _, n in sizes), initial=0))
    first = ranged.sparkSession.createDataFrame([(k, n) for (k, _), n in zip(sizes, before)], "_part bigint, _first bigint")
    ranked = ranged.join(F.broadcast(first), part == F.col("_part")).withColumn("rank", F.col("_first") + place + 1)
    most = cfg.percent * before[-1] // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("_place", "_part", "_first")
    return ranked.unionByName(scored.where(~F.coalesce(enough, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, cfg: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) of every row of docs, drawn towards the words of target."""
    found = gains(bucket_counts(docs, cfg, text_col), bucket_counts(target, cfg, target_text_col), cfg)
    rows = found.toPandas()  # cfg.buckets rows
    by_bucket = np.zeros(cfg.buckets, np.int64)
    by_bucket[rows["bucket"].to_numpy()] = rows["gain"].to_numpy()
    return draw(weigh(docs, by_bucket, cfg, id_col, text_col), cfg, id_col)


#: What the registered query returns, by its contract (unigrams, 10 000 buckets).
SQL = r"""
WITH RECURSIVE remainder AS (
  SELECT range AS b, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM remainder WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS crcs FROM remainder WHERE k = 8),
w AS (
  SELECT 0 AS of, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS (SELECT of, id, unnest(words) AS word FROM w),
counted AS (SELECT of, id, word, count(*) AS n FROM f GROUP BY ALL),
spelt AS (SELECT word, hex(encode(word)) AS digits FROM (SELECT DISTINCT word FROM f)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(digits), 2), lambda i: ('0x' || substr(digits, i, 2))::BIGINT)),
    lambda c, b: xor(c // 256, crcs[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM spelt, crc_table
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (of = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (of = 1), 0)::DOUBLE AS t FROM counted JOIN hashed USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts
), weight AS (
  SELECT id AS doc_id, sum(n * gain)::BIGINT AS weight FROM counted JOIN hashed USING (word) JOIN gain USING (bucket) WHERE of = 0 GROUP BY id
), ids AS (SELECT id AS doc_id, len(words) AS n_features FROM w WHERE of = 0),
final AS (
  SELECT i.doc_id, i.n_features::BIGINT AS n_features, coalesce(g.weight, 0) AS weight,
    coalesce(g.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || i.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM ids i LEFT JOIN weight g USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM final WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM final LEFT JOIN ranked USING (doc_id)
"""
