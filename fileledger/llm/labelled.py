"""A bounded sample of labelled texts for fitting a model on the driver.

Labels of the held-out fold are never read.  An id that has several labels counts by
the lower one, or by the higher one where `highest` says so; of its several texts the one
of least hash counts.  The sample is the ids of least hash of each kind, as many as asked for, without texts
above a size, and in that order only as many as fit in a total of bytes.  Ids and sizes
come to the driver first, then the texts chosen: no task meets them all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SampleBounds:
    positive: int
    negative: int
    text_bytes: int
    total_bytes: int


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, bounds: SampleBounds, id_col: str = "doc_id", text_col: str = "text", highest: bool = False) -> tuple[list[str], np.ndarray]:
    """Texts and whether their label is 1, ordered by id."""
    pick = F.max if highest else F.min
    known = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((pick(label_col) == 1).alias("_y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    sample = known.where("_y").orderBy(*order).limit(bounds.positive).unionByName(known.where("not _y").orderBy(*order).limit(bounds.negative))
    texts = docs.where(F.octet_length(text_col) <= bounds.text_bytes).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sizes = texts.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.max(F.octet_length("_text")).alias("n")).orderBy(*order).collect()  # the ids of the sample
    total = np.cumsum([r.n for r in sizes])
    chosen = [(r._id,) for r, so_far in zip(sizes, total) if so_far <= bounds.total_bytes]
    if not chosen:
        return [], np.zeros(0, bool)
    ids = docs.sparkSession.createDataFrame(chosen, f"_id {known.dtypes[0][1]}")
    rows = texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")).join(F.broadcast(sample), "_id").orderBy("_id").collect()
    return [r._text for r in rows], np.array([r._y for r in rows], bool)
