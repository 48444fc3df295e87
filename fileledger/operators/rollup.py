"""Totals by directory, and the largest of anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.functions.paths import parent, self_and_ancestors
from fileledger.schema import KINDS


def subtree_totals(rows: DataFrame, **totals) -> DataFrame:
    """(rel_path, totals...) of every directory: sums of the given expressions over itself and all below.

    Rows are summed by parent first, so that only directories are exploded to their
    ancestors; both sums are partial before they are shuffled, and the root's row is
    one row per task.
    """
    folder = F.when(F.col("kind") == "dir", F.col("rel_path")).otherwise(parent("rel_path"))
    by_folder = rows.select(folder.alias("_folder"), *(F.coalesce(e, F.lit(0)).alias(n) for n, e in totals.items())).groupBy("_folder").agg(*(F.sum(n).alias(n) for n in totals))
    return by_folder.select(F.explode(self_and_ancestors("_folder")).alias("rel_path"), *totals).groupBy("rel_path").agg(*(F.sum(n).alias(n) for n in totals))


def directory_rollup(m: DataFrame) -> DataFrame:
    """(rel_path, bytes of files, counts by kind) of every directory."""
    is_ = lambda k: F.when(F.col("kind") == k, 1).otherwise(0).cast("bigint")
    return subtree_totals(m, bytes=F.when(F.col("kind") == "file", F.col("size")).otherwise(0), **{f"{k}s": is_(k) for k in KINDS})


def top_k(df: DataFrame, column: str, k: int, *ties: str) -> DataFrame:
    """The k rows of the greatest column; ties by the other columns, ascending."""
    return df.orderBy(F.desc(column), *ties).limit(k)
