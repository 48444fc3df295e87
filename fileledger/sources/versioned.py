"""A keyed table that stream batches rewrite bucket by bucket.

Rows lie in hash buckets of their key.  A batch writes the buckets that it touches anew, under its
own number, and then a commit: for each bucket the batch that wrote it last.  A batch
without a commit never happened, so one that is run again after a failure writes the same
files once more, and one that has a commit is passed over.  A step reads the commit
before it and the buckets it touches, however many batches there were.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


class VersionedTable:
    """folder: its own; schema: a DDL string; key: the column that places a row; buckets: rewritten as a whole, so about as many as keep one at some hundred megabytes."""

    def __init__(self, folder: str, schema: str, key: str, buckets: int = 64):
        self.folder, self.schema, self.key, self.buckets = folder.rstrip("/"), schema, key, buckets

    def bucket(self, key: Column | str | None = None) -> Column:
        return F.pmod(F.xxhash64(key if key is not None else self.key), F.lit(self.buckets)).cast("int")

    def commit_of(self, spark: SparkSession, batch_id: int) -> dict[int, int] | None:
        """The last batch to have written each bucket, as of a batch; None where that has no commit."""
        try:
            rows = spark.read.schema("bucket int, version bigint").parquet(f"{self.folder}/commits/batch={batch_id}").collect()  # a row each bucket
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return {r.bucket: r.version for r in rows if r.bucket >= 0}

    def latest(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """The newest commit, or the newest one before a batch."""
        if before is None:
            try:
                names = spark.read.format("binaryFile").load(f"{self.folder}/commits/batch=*/*.parquet").select(F.regexp_extract("path", "batch=(\\d+)/[^/]*$", 1).cast("bigint").alias("id"))
                before = (names.agg(F.max("id")).first()[0] or 0) + 1
            except AnalysisException as e:
                if "PATH_NOT_FOUND" in str(e):
                    return {}
                raise
        for batch_id in range(before - 1, -1, -1):  # a stream numbers its batches without gaps, so the first is there
            if (found := self.commit_of(spark, batch_id)) is not None:
                return found
        return {}

    def read(self, spark: SparkSession, commit: dict[int, int], buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a commit, or of some of its buckets."""
        wanted = commit if buckets is None else {b: commit[b] for b in buckets if b in commit}
        paths = [f"{self.folder}/data/version={v}/{BUCKET}={b}" for b, v in sorted(wanted.items())]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def current(self, spark: SparkSession) -> DataFrame:
        return self.read(spark, self.latest(spark))

    def write(self, rows: DataFrame, batch_id: int, before: dict[int, int], touched: Iterable[int]) -> DataFrame:
        """Makes rows the contents of the touched buckets, and commits; gives them back as written."""
        spark, path = rows.sparkSession, f"{self.folder}/data/version={batch_id}"
        # Rebalanced, not repartitioned: a bucket that is large is written by several tasks, as several files.
        rows.withColumn(BUCKET, self.bucket()).hint("rebalance", F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        full = spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(path)
        filled = [r[0] for r in full.select(BUCKET).distinct().collect()]
        gone = set(touched)
        commit = {b: v for b, v in before.items() if b not in gone} | {b: batch_id for b in filled}
        spark.createDataFrame(sorted(commit.items()) or [(-1, batch_id)], "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch={batch_id}")
        return full.drop(BUCKET)
