"""What a removal with globs and minimum ages takes and leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.functions.filters import FilterSettings, apply_filter, directly_matches, time_filter
from fileledger.functions.paths import parent, self_and_ancestors
from fileledger.operators.policy import Policy, decide


def marked_above(seeds: DataFrame) -> DataFrame:
    """(rel_path): every seed that is a directory and every directory above a seed."""
    folders = seeds.select(F.when(F.col("kind") == "dir", F.col("rel_path")).otherwise(parent("rel_path")).alias("_f")).where("_f is not null").distinct()
    return folders.select(F.explode(self_and_ancestors("_f")).alias("rel_path")).distinct()


def rm_plan(m: DataFrame, filter: FilterSettings | None = None, modified_before=None, created_before=None, now_s: int = 0, dry_run: bool = False, policy: Policy = ()) -> DataFrame:
    """(rel_path, kind, size, action, reason).

    action: remove, skip_filter, skip_time, keep (a directory that stays for what is
    left in it), pruned (below a skipped directory).  A directory goes if its own
    conditions hold, nothing below it stays, and it and every directory below it has
    something removed in it or matches itself.  A dry run only asks that nothing
    below was skipped.  An entry for which a rule of the policy holds stays, with the
    rule's action and its name as reason; so does what holds it.

    Rows are added up by folder once; from there on only directories are joined.
    """
    settings = filter or FilterSettings()
    aged = modified_before is not None or created_before is not None
    age = time_filter(modified_before, created_before, now_s) if aged else F.lit("matched")
    path, is_dir = F.col("rel_path"), F.col("kind") == "dir"
    r = apply_filter(m, settings).select("rel_path", "kind", "size", "walk", "reason", age.alias("_age"), directly_matches(settings, path, is_dir).alias("_match"))
    if policy:
        r = decide(r.withColumn("action", F.when((F.col("walk") == "included") & (F.col("_age") == "matched"), "remove")), policy)
        r = r.withColumn("rule", F.when(F.col("walk") == "included", F.col("rule"))).withColumnRenamed("action", "_ruled")
    else:
        r = r.withColumns({"rule": F.lit(None).cast("string"), "_ruled": F.lit(None).cast("string")})
    ruled = F.col("rule").isNotNull()
    live, ok = F.col("walk") == "included", (F.col("_age") == "matched") & ~ruled
    seed = live & F.when(is_dir, F.col("_match")).otherwise(ok)
    stay = (F.col("walk") == "skipped") | (live & ~ok) if dry_run else ~live | ~ok
    marks = _directory_marks(r.select("rel_path", is_dir.alias("is_dir"), seed.alias("seed"), stay.alias("stay"), live.alias("live")), not dry_run)
    files, dirs = r.where(~is_dir), r.where(is_dir).join(marks, "rel_path", "left")
    r = files.withColumns({"_seeded": F.lit(False), "_stays": F.lit(False)}).unionByName(dirs.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_seeded", "_stays")}))
    gone = F.when(is_dir, ~F.col("_stays") & ok & F.col("_seeded")).otherwise(ok)
    # A real run asks whether a directory was only passed through before it asks its age.
    passed = is_dir & ~F.col("_match") & ~F.col("_seeded") if not dry_run else F.lit(False)
    action = F.when(F.col("walk") == "pruned", "pruned").when(F.col("walk") == "skipped", "skip_filter").when(ruled, F.col("_ruled")).when(gone, "remove").when(passed, "keep").when(~ok, "skip_time").otherwise("keep")
    why = F.when(ruled, F.col("rule")).when(action == "skip_filter", F.col("reason")).when(action == "skip_time", F.col("_age"))
    return r.select("rel_path", "kind", "size", action.alias("action"), why.alias("reason"))


def _directory_marks(r: DataFrame, unseeded_stay: bool) -> DataFrame:
    """(rel_path, _seeded, _stays) of directories, from rows (rel_path, is_dir, seed, stay, live): whether a seed, and something that stays, is at or below them."""
    own = F.col("is_dir")
    sums = r.groupBy(F.when(own, F.col("rel_path")).otherwise(parent("rel_path")).alias("_f")).agg(F.max("seed").alias("seed"), F.max("stay").alias("stay"), F.max(own & F.col("live")).alias("live"))
    up = sums.where("_f is not null").select("_f", F.explode(self_and_ancestors("_f")).alias("rel_path"), "seed", "stay", "live")
    marks = up.groupBy("rel_path").agg(F.max("seed").alias("_seeded"), F.max("stay").alias("_stays"), F.max(F.col("live") & (F.col("_f") == F.col("rel_path"))).alias("_live"))
    if not unseeded_stay:
        return marks.drop("_live")
    row = lambda path, seeded, stays: F.struct(path.alias("rel_path"), seeded.alias("_seeded"), stays.alias("_stays"))
    own_row = F.array(row(F.col("rel_path"), F.col("_seeded"), F.col("_stays")))
    above = F.transform(self_and_ancestors("rel_path"), lambda a: row(a, F.lit(False), F.lit(True)))
    told = marks.select(F.explode(F.when(F.col("_live") & ~F.col("_seeded"), F.concat(own_row, above)).otherwise(own_row)).alias("r")).select("r.*")
    return told.groupBy("rel_path").agg(F.max("_seeded").alias("_seeded"), F.max("_stays").alias("_stays"))


def rm_summary(plan: DataFrame) -> DataFrame:
    """One row: removed and skipped counts by kind (other counts as file), bytes of removed files."""
    kind = F.when(F.col("kind") == "other", "file").otherwise(F.col("kind"))
    names = {"file": "files", "dir": "directories", "symlink": "symlinks"}
    count = lambda what, k: F.count_if(what & (kind == k))
    removed, skipped = F.col("action") == "remove", F.col("action").isin("skip_filter", "skip_time")
    return plan.agg(
        F.coalesce(F.sum(F.when(removed & F.col("kind").isin("file", "other"), F.col("size"))), F.lit(0)).alias("bytes_removed"),
        *(count(removed, k).alias(f"{n}_removed") for k, n in names.items()),
        *(count(skipped, k).alias(f"{n}_skipped") for k, n in names.items()),
    )
