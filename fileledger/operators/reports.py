"""Checks, reports and sinks of manifests and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileledger.functions.metadata import iops_tokens, tokens_beyond
from fileledger.functions.paths import depth, escape_path, join_path, name, parent, self_and_ancestors
from fileledger.operators.plans import exclude_failed
from fileledger.schema import KINDS

VERBS = {"remove": "remove", "copy": "copy", "replace": "copy", "mkdir": "copy", "symlink": "copy", "touch_link": "copy", "hardlink": "link", "copy_from_update": "copy", "change": "change"}


def validate_manifest(m: DataFrame) -> DataFrame:
    """(rel_path, problem): duplicate paths, rows whose parent is missing or no directory, unknown kinds."""
    twice = m.groupBy("rel_path").count().where("count > 1").select("rel_path", F.lit("duplicate path").alias("problem"))
    dirs = m.groupBy("rel_path").agg(F.max(F.when(F.col("kind") == "dir", 1).otherwise(0)).alias("_dir")).withColumnRenamed("rel_path", "_in")
    c = m.select("rel_path", "kind").withColumn("_in", parent("rel_path")).join(dirs, "_in", "left")
    orphan = F.when(~F.col("kind").isin(*KINDS), "unknown kind").when(F.col("_in").isNull(), None).when(F.col("_dir").isNull(), "parent is missing").when(F.col("_dir") == 0, "parent is no directory")
    return twice.unionByName(c.select("rel_path", orphan.alias("problem")).where("problem is not null"))


def format_plan(plan: DataFrame, mode: str = "brief", src_root: str = "", dst_root: str | None = None) -> DataFrame:
    """(rel_path, line) of a dry run.  brief: what would be done; all: also what is skipped; explain: with reasons."""
    if mode not in ("brief", "all", "explain"):
        raise ValueError(f"unknown mode {mode!r}")
    verb: Column = F.lit(None).cast("string")
    for action, word in VERBS.items():
        verb = F.when(F.col("action") == action, word).otherwise(verb)
    label = F.when(F.col("kind") == "other", "file").otherwise(F.col("kind"))
    path = lambda root: F.concat(F.lit('"'), escape_path(join_path(F.lit(root), F.col("rel_path"))), F.lit('"'))
    what = F.concat_ws(" ", label, path(src_root), *([F.lit("->"), path(dst_root)] if dst_root is not None else []))
    skips = F.col("action").startswith("skip_")
    reason = F.concat(F.lit(" ("), F.coalesce("reason", F.col("action")), F.lit(")")) if mode == "explain" else F.lit("")
    line = F.when(verb.isNotNull(), F.concat(F.lit("would "), verb, F.lit(" "), what)).when(skips, F.concat(F.lit("skip "), what, reason))
    out = plan.select("rel_path", line.alias("line"), skips.alias("_skip")).where("line is not null")
    return (out.where("not _skip") if mode == "brief" else out).drop("_skip")


def write_plan(plan: DataFrame, path: str, order: str = "pre", files: int | None = None) -> None:
    """Writes a plan by action; parents come before their children (pre) or after them (post)."""
    if order not in ("pre", "post"):
        raise ValueError(f"unknown order {order!r}")
    p = plan.withColumns({"_depth": depth("rel_path") * (1 if order == "pre" else -1), "_in": F.coalesce(parent("rel_path"), F.lit(""))})
    keys = ["_depth", "_in", "rel_path"]  # the path too, so that a directory of many entries is many ranges
    p = p.repartitionByRange(files, *keys) if files else p.repartitionByRange(*keys)
    p.sortWithinPartitions("action", *keys).drop("_in").withColumnRenamed("_depth", "step").write.partitionBy("action").parquet(path)


def throttle_estimate(plan: DataFrame, ops_per_s: float = 0, iops_per_s: float = 0, chunk: int = 0) -> DataFrame:
    """One row: operations, IO tokens of written files, files that cost more tokens than can be taken at once (which are not throttled and not in the sum), seconds at the given caps (0: no cap)."""
    if iops_per_s and not chunk:
        raise ValueError("an IO cap needs a chunk size")
    acts = ~F.col("action").isin("unchanged", "none", "pruned", "keep", "traverse") & ~F.col("action").startswith("skip_")
    writes = acts & (F.col("kind") == "file") & F.col("action").isin("copy", "replace", "copy_from_update")
    cost = iops_tokens(F.col("size"), chunk)
    t = plan.agg(F.count_if(acts).alias("ops"), F.coalesce(F.sum(F.when(writes & ~tokens_beyond(cost), cost)), F.lit(0)).cast("bigint").alias("tokens"), F.count_if(writes & tokens_beyond(cost)).alias("files_beyond"))
    seconds = F.greatest(F.col("ops") / ops_per_s if ops_per_s else F.lit(0.0), F.col("tokens") / iops_per_s if iops_per_s else F.lit(0.0))
    return t.withColumn("seconds", seconds)


def resolve_destinations(jobs: DataFrame, existing: DataFrame | None = None, overwrite: bool = False, delete: bool = False, ignore_existing: bool = False) -> DataFrame:
    """jobs (job, src, dst) -> (job, src, dst, resolved, problem).

    A slash at the end copies into the destination under the source's name; a job of
    several sources needs it; destinations that end in . or .. are rejected, and so
    are two sources that resolve to one destination.  A mirror (delete) takes one
    source.  existing (path): a single source onto one of these needs overwrite,
    delete or a slash.
    """
    if delete and ignore_existing:
        raise ValueError("a mirror replaces what differs, so it cannot leave what exists")
    into = F.col("dst").endswith("/")
    base = name(F.regexp_replace("src", "(?<=.)/+$", ""))
    resolved = F.when(into, F.concat(F.regexp_replace("dst", "/+$", ""), F.lit("/"), base)).otherwise(F.col("dst"))
    several = jobs.groupBy("job").agg((F.count_distinct("src") > 1).alias("_several"))
    j = jobs.withColumn("resolved", resolved).join(several, "job")
    same = j.groupBy("job", "resolved").agg((F.count(F.lit(1)) > 1).alias("_same"))
    last = name(F.regexp_replace("dst", "(?<=.)/+$", ""))
    problem = F.when(last.isin(".", ".."), "destination ends in a dot step").when(F.lit(delete) & F.col("_several"), "a mirror takes a single source").when(F.col("_several") & ~F.col("dst").endswith("/"), "several sources need a slash at the end").when(F.col("_same"), "two sources have this destination")
    j = j.join(same, ["job", "resolved"])
    if existing is not None and not (overwrite or delete):
        there = existing.select(F.col("path").alias("resolved"), F.lit(True).alias("_there")).distinct()
        j = j.join(there, "resolved", "left")
        problem = problem.when(F.col("_there") & ~F.col("_several") & ~F.col("dst").endswith("/"), "destination exists")
    return j.select("job", "src", "dst", "resolved", problem.alias("problem"))


#: Buckets of causes a kept cause, by which the first causes are bounded before they are told apart.
CAUSE_BUCKETS = 64


def error_digest(errors: DataFrame, max_unique: int = 20) -> DataFrame:
    """(run, causes, total, suppressed): the first max_unique distinct causes in order of first appearance, all errors, and errors after the cap was full whose cause is not kept.

    Causes may be as many as errors, so they are not ranked.  The first error of each of
    CAUSE_BUCKETS * max_unique buckets of causes comes first: where that many buckets have one, the
    last cause to keep has appeared by the max_unique-th of them.  Only causes up to
    then are told apart, and what is not kept is the total less what is.
    """
    run, cause, seq = F.col("run"), F.col("root_cause"), F.col("seq")
    bucket = F.pmod(F.xxhash64("root_cause"), F.lit(CAUSE_BUCKETS * max_unique))
    first = errors.groupBy("run", bucket.alias("_b")).agg(F.min("seq").alias("_first")).groupBy("run").agg(F.sort_array(F.collect_list("_first")).alias("_firsts"))
    until = first.select(run.alias("_run"), F.try_element_at("_firsts", F.lit(max_unique)).alias("_until"))
    early = errors.join(until, run.eqNullSafe(F.col("_run"))).where(F.col("_until").isNull() | (seq <= F.col("_until")))
    early = early.groupBy("run", "root_cause").agg(F.min("seq").alias("_first"))
    causes = early.groupBy("run").agg(F.slice(F.array_sort(F.collect_list(F.struct("_first", "root_cause"))), 1, max_unique).alias("_kept"))
    kept = causes.select(run.alias("_run"), F.explode("_kept").alias("_k")).select("_run", F.col("_k.root_cause").alias("_cause"))
    held = errors.join(kept, run.eqNullSafe(F.col("_run")) & cause.eqNullSafe(F.col("_cause")), "left_semi").groupBy(run.alias("_run")).agg(F.count(F.lit(1)).alias("_held"))
    total = errors.groupBy(run.alias("_all")).agg(F.count(F.lit(1)).alias("total"))
    j = causes.join(held, run.eqNullSafe(F.col("_run"))).join(total, run.eqNullSafe(F.col("_all")))
    return j.select("run", F.transform("_kept", lambda x: x["root_cause"]).alias("causes"), "total", (F.col("total") - F.col("_held")).alias("suppressed"))


# The lines of a message that several errors make.
SEVERAL_ERRORS, EACH_ERROR, MORE_ERRORS = "multiple errors occurred:", "\n- %s", "\n(%d additional errors suppressed)"


def error_messages(digest: DataFrame) -> DataFrame:
    """(run, message) of an error_digest: the only cause there is, or a list of those kept and how many errors more."""
    each = F.aggregate("causes", F.lit(""), lambda text, c: F.concat(text, F.lit(EACH_ERROR.partition("%")[0]), c))
    more = F.when(F.col("suppressed") > 0, F.format_string(MORE_ERRORS, "suppressed")).otherwise("")
    alone = (F.size("causes") <= 1) & (F.col("suppressed") == 0)
    return digest.select("run", F.when(alone, F.element_at("causes", 1)).otherwise(F.concat(F.lit(SEVERAL_ERRORS), each, more)).alias("message"))


def directory_completion(dirs: DataFrame, children: DataFrame) -> DataFrame:
    """dirs (rel_path, announced, expected, failed), children (rel_path of processed entries) -> (rel_path, processed, complete).

    A directory is complete when it is announced, as many children as expected have
    been processed, and every tracked directory below it is complete; what lies at
    or below a failed directory is untracked.
    """
    done = children.groupBy(parent("rel_path").alias("rel_path")).agg(F.count(F.lit(1)).alias("processed"))
    return completion(dirs.join(done, "rel_path", "left").withColumn("processed", F.coalesce("processed", F.lit(0)))).drop("announced")


def completion(dirs: DataFrame) -> DataFrame:
    """The same from dirs that carry how many of their children are processed: (rel_path, announced, processed, complete)."""
    t = exclude_failed(dirs, dirs.where("failed").select("rel_path"))
    open_ = t.where(~(F.col("announced") & (F.col("processed") >= F.col("expected")))).select("rel_path")
    above = open_.select(F.explode(self_and_ancestors("rel_path")).alias("rel_path")).distinct().withColumn("_open", F.lit(True))
    return t.join(above, "rel_path", "left").select("rel_path", "announced", "processed", F.col("_open").isNull().alias("complete"))
