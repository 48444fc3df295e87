"""Batches of a directory's entries for sending: each as full as a budget of bytes allows, in order of name.

Where a batch begins depends on where the one before it began, so a directory is a chain.  It is
still cut into tiles of the sorted entries, which are read in parallel.  What a tile does to the state
(batches so far, bytes in the open one) follows from where the first new batch begins in
it, and that is among the entries of its first `budget` bytes: a tile tells, for each of
them, how many batches begin from there on and how many bytes the last one has.  One look-up a
tile then carries the state through a directory, and tiles number their entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.functions.paths import name, parent
from fileledger.sources.scratch import written


def tile_outcomes(cost: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, begun, left) of the entries at which a tile's first new batch can begin: bytes of the tile before it, batches that begin from it on, bytes in the last of them.

    Batches are followed by doubling: from every entry to where the next batch begins, then twice as far each time.
    """
    n = len(cost)
    total = np.concatenate([[0], np.cumsum(cost)])
    jump = np.append(np.maximum(np.searchsorted(total, total[:-1] + budget, side="right") - 1, np.arange(n) + 1), n)
    begun, last = np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
    while (jump[:-1] < n).any():
        last = np.where(jump < n, last[jump], last)
        begun, jump = begun + begun[jump], jump[jump]
    first = np.flatnonzero(total[:-1] <= budget)
    return total[first], begun[first], total[n] - total[last[first]]


def carry(state: tuple[int, int], total: int, before: np.ndarray, begun: np.ndarray, left: np.ndarray, cost_after: np.ndarray, budget: int) -> tuple[int, int]:
    """(batches, bytes in the last) after a tile; cost_after: bytes of the tile up to and with each entry at which a batch can begin."""
    batches, used = state
    at = int(np.searchsorted(cost_after, budget - used, side="right")) if used else 0
    if at == len(before):
        return batches, used + total  # all of it fits
    return batches + int(begun[at]), int(left[at])


def chunk_manifest(m: DataFrame, budget: int = 4 << 20, overhead: int = 64) -> DataFrame:
    """(rel_path, parent, chunk): each directory's entries in name order in batches of at most budget bytes (name bytes and overhead each); an entry above it is alone."""
    order = ["parent", "rel_path"]
    rows = m.where("rel_path <> ''").select("rel_path", parent("rel_path").alias("parent"), (F.octet_length(name("rel_path")) + overhead).cast("bigint").alias("cost"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("tile", F.shiftright(F.monotonically_increasing_id(), 33))
    rows = written(rows, "chunk-tiles")
    split = rows.select("parent", "tile").distinct().groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("parent")

    def outcomes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def told() -> pd.DataFrame:
            cost = np.concatenate(held)
            before, begun, left = tile_outcomes(cost, budget)
            return pd.DataFrame({"parent": [key[0]], "tile": [key[1]], "total": [int(cost.sum())], "before": [before], "begun": [begun], "left": [left], "after": [before + cost[: len(before)]]})

        for b in batches:
            for k, part in b.groupby(["parent", "tile"], sort=False):
                if k != key and held:
                    yield told()
                    held = []
                key = k
                held.append(part["cost"].to_numpy())
        if held:
            yield told()

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder, state = None, (-1, 0)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.parent != folder:
                    folder, state = r.parent, (-1, 0)
                out.append((r.parent, r.tile, *state))
                state = carry(state, r.total, r.before, r.begun, r.left, r.after, budget)
            yield pd.DataFrame(out, columns=["parent", "tile", "begun", "used"])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunk, used = None, -1, 0
        for b in batches:
            out = []
            for where, tile, cost, begun, held in zip(b["parent"], b["tile"], b["cost"], b["begun"], b["used"]):
                if (where, tile) != key:
                    key, chunk, used = (where, tile), begun, held
                if not used or used + cost > budget:
                    chunk, used = chunk + 1, 0
                used += cost
                out.append(chunk)
            yield b[["rel_path", "parent"]].assign(chunk=out)

    by_tile = ["parent", "tile"]
    some = rows.join(split, "parent", "left_semi").repartition(*by_tile).sortWithinPartitions(*by_tile, "rel_path")
    told = some.mapInPandas(outcomes, "parent string, tile bigint, total bigint, before array<bigint>, begun array<bigint>, left array<bigint>, after array<bigint>")
    begin = told.repartition("parent").sortWithinPartitions(*by_tile).mapInPandas(states, "parent string, tile bigint, begun bigint, used bigint")
    begin = written(begin, "chunk-states")
    whole = rows.join(begin, by_tile, "left").withColumns({"begun": F.coalesce("begun", F.lit(-1)), "used": F.coalesce("used", F.lit(0))})
    return whole.repartition(*by_tile).sortWithinPartitions(*by_tile, "rel_path").mapInPandas(number, "rel_path string, parent string, chunk bigint")
