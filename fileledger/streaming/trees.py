"""Change feeds of manifests and completion events, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.functions.metadata import DEFAULT_COMPARE, equal_by_kind, parse_compare
from fileledger.functions.paths import ancestors, self_and_ancestors
from fileledger.operators.compare import COMPARED
from fileledger.operators.plans import copy_actions, exclude_failed
from fileledger.schema import MANIFEST_SCHEMA
from fileledger.sources.scratch import written
from fileledger.sources.versioned import VersionedTable


def incremental_compare(changes: DataFrame, dst: DataFrame, compare: str = DEFAULT_COMPARE) -> DataFrame:
    """(rel_path, result) of changed source entries against a static destination: row-local rules only."""
    side = lambda m, p: m.select("rel_path", *(F.col(c).alias(f"{p}{c}") for c in COMPARED))
    j = side(changes, "s_").join(side(dst, "d_"), "rel_path", "left")
    equal = (F.col("s_kind") == F.col("d_kind")) & equal_by_kind(parse_compare(compare), F.col("s_kind"), "s_", "d_")
    return j.select("rel_path", F.when(F.col("d_kind").isNull(), "dst_missing").when(equal, "same").otherwise("different").alias("result"))


def incremental_copy_plan(changes: DataFrame, dst: DataFrame, **options) -> DataFrame:
    """(rel_path, kind, size, action, dst_kind) of changed source entries against a static destination.

    options as of copy_plan.  The table of decisions is row-local; what lies below
    an entry that fails, and what a replaced directory takes with it, needs the whole
    tree and is left to copy_plan.
    """
    return copy_actions(changes, dst, **options).select("rel_path", "kind", "size", "action", "dst_kind")


class ManifestTable:
    """A manifest kept by a change feed: rows of MANIFEST_SCHEMA with `seq` (order of change) and `deleted`.

    Of one path's changes the one of highest seq counts, whichever batch it comes in; at
    the same seq a deletion.  Deleted paths stay as rows, so that an older change that comes later does not
    bring them back.  A batch rewrites the buckets it touches, and a replayed one nothing.
    """

    def __init__(self, folder: str, buckets: int = 64):
        self.columns = [*MANIFEST_SCHEMA.names, "seq", "deleted"]
        self.table = VersionedTable(folder, f"{MANIFEST_SCHEMA.toDDL()}, seq bigint, deleted boolean", "rel_path", buckets)

    def add(self, changes: DataFrame, batch_id: int) -> None:
        """A micro-batch of changes, for foreachBatch; those without a path or a seq are none."""
        spark = changes.sparkSession
        if self.table.commit_of(spark, batch_id) is not None:
            return
        named = changes.withColumn("deleted", F.coalesce("deleted", F.lit(False)))
        c = written(self._newest(named.select(*self.columns).where("rel_path is not null and seq is not null")), "manifest-changes")
        touched = [r[0] for r in c.select(self.table.bucket()).distinct().collect()]  # numbers of buckets
        before = self.table.latest(spark, batch_id)
        self.table.write(self._newest(self.table.read(spark, before, touched).select(*self.columns).unionByName(c)), batch_id, before, touched)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = F.struct(*(c for c in self.columns if c not in ("rel_path", "seq", "deleted")))
        return rows.groupBy("rel_path").agg(F.max(F.struct("seq", "deleted", rest.alias("rest"))).alias("_top")).select("rel_path", "_top.rest.*", "_top.seq", "_top.deleted").select(*self.columns)

    def current(self, spark: SparkSession) -> DataFrame:
        """The manifest as of the newest batch, for any operator over manifests."""
        return self.table.current(spark).where("not deleted").select(*MANIFEST_SCHEMA.names)


class CompletionTracker:
    """Directory completion over batches of events (run, dir, event, expected): announce, child, failed.

    State is a row a directory: what is expected and done, and how many directories at or
    below it are open (announced or failed, and not all children done).  A batch adds up its events by directory; where
    that opens or closes a directory, it and those above it change by one, and where a directory
    fails, those above lose what was open below it.  So a batch touches directories of its
    events and their ancestors, whatever there was before it.  A batch that is replayed counts once, and a
    tracker made anew on the same folder goes on where the last one stopped.  Events for
    directories that were never announced, or below failed ones, count for nothing in
    the result.
    """

    STATE = "rel_path string, expected bigint, done bigint, failed boolean, open boolean, open_below bigint, told bigint"

    def __init__(self, run: str, folder: str, buckets: int = 64):
        self.run = run
        self.table = VersionedTable(folder, self.STATE, "rel_path", buckets)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self.table.commit_of(spark, batch_id) is not None:
            return
        b = batch.where((F.col("run") == self.run) & F.col("dir").isNotNull())
        events = b.groupBy(F.col("dir").alias("rel_path")).agg(
            F.max(F.when(F.col("event") == "announce", F.col("expected"))).alias("more_expected"), F.count_if(F.col("event") == "child").alias("more_done"), F.coalesce(F.bool_or(F.col("event") == "failed"), F.lit(False)).alias("more_failed")
        )
        events = written(events, "completion-events")
        reach = events.select(F.explode(self_and_ancestors("rel_path")).alias("rel_path")).distinct()
        touched = [r[0] for r in reach.select(self.table.bucket()).distinct().collect()]  # numbers of buckets
        before = self.table.latest(spark, batch_id)
        old = self.table.read(spark, before, touched)
        no = F.lit(False)
        s = old.join(reach.withColumn("reached", F.lit(True)), "rel_path", "full").join(events, "rel_path", "left")
        expected = F.greatest("expected", "more_expected")
        done = F.coalesce("done", F.lit(0)) + F.coalesce("more_done", F.lit(0))
        failed = F.coalesce("failed", no) | F.coalesce("more_failed", no)
        s = s.select(
            "rel_path", expected.alias("expected"), done.alias("done"), failed.alias("failed"), F.coalesce("failed", no).alias("failed_before"),
            F.coalesce("open", no).alias("open_before"), (failed | (expected.isNotNull() & (done < expected))).alias("open"), F.coalesce("open_below", F.lit(0)).alias("open_below"), "told", F.coalesce("reached", no).alias("reached"), F.col("more_done").isNotNull().alias("has_events"),
        )
        s = written(s, "completion-state")

        # Failed directories at or above each reached one: how many, and how many of them strictly above.
        mine = s.where("reached").select("rel_path", F.explode(self_and_ancestors("rel_path")).alias("_at"))
        bad = s.where("failed").select(F.col("rel_path").alias("_at"), "failed_before")
        under = mine.join(bad, "_at").groupBy("rel_path").agg(F.lit(True).alias("covered"), F.bool_or("failed_before").alias("covered_before"), F.bool_or(F.col("_at") != F.col("rel_path")).alias("below_failed"))
        s = written(s.join(under, "rel_path", "left").fillna(False, ["covered", "covered_before", "below_failed"]), "completion-covered")
        flips = s.where("has_events and not covered and open <> open_before").select(F.explode(self_and_ancestors("rel_path")).alias("rel_path"), F.when(F.col("open"), 1).otherwise(-1).alias("by"))
        lost = s.where("failed and not failed_before and not covered_before and not below_failed and open_below <> 0").select(F.explode(ancestors("rel_path")).alias("rel_path"), (-F.col("open_below")).alias("by"))
        change = flips.unionByName(lost).groupBy("rel_path").agg(F.sum("by").alias("by"))
        n = F.col("open_below") + F.coalesce("by", F.lit(0))
        told = F.when(F.col("told").isNull() & F.col("reached") & F.col("expected").isNotNull() & ~F.col("covered") & (n == 0), F.lit(batch_id)).otherwise(F.col("told"))
        rows = s.join(change, "rel_path", "left").select("rel_path", "expected", "done", "failed", "open", n.cast("bigint").alias("open_below"), told.cast("bigint").alias("told"))
        self.table.write(rows, batch_id, before, touched)

    def completed(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """(rel_path) of the directories that a batch completed for the first time."""
        commit = self.table.commit_of(spark, batch_id) or {}
        return self.table.read(spark, commit, [b for b, v in commit.items() if v == batch_id]).where(F.col("told") == batch_id).select("rel_path")

    def status(self, spark: SparkSession) -> DataFrame:
        """(rel_path, processed, complete) of announced directories."""
        s = written(self.table.current(spark).where("expected is not null or failed"), "completion-status")
        tracked = exclude_failed(s, s.where("failed").select("rel_path"))
        return tracked.where("expected is not null").select("rel_path", F.col("done").alias("processed"), (F.col("open_below") == 0).alias("complete"))
