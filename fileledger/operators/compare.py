"""Differences between two trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.functions.filters import FilterSettings, apply_filter
from fileledger.functions.metadata import DEFAULT_COMPARE, equal_by_kind, parse_compare
from fileledger.functions.paths import escape_path, join_path, parent, self_and_ancestors

COMPARED = ("kind", "size", "mode", "uid", "gid", "mtime_s", "mtime_ns", "ctime_s", "ctime_ns")
RESULTS = ("same", "different", "src_missing", "dst_missing")


def _side(m: DataFrame, prefix: str, *more: str) -> DataFrame:
    return m.select("rel_path", *(F.col(c).alias(f"{prefix}{c}") for c in (*COMPARED, *more)))


def compare(src: DataFrame, dst: DataFrame, compare: str | dict = DEFAULT_COMPARE, filter: FilterSettings | None = None, expand_missing: bool = False, exit_early: bool = False) -> DataFrame:
    """(rel_path, result, src_kind, dst_kind, src_size, dst_size, side).

    An included source row is compared with whatever the destination has under its
    path; the destination's own verdict counts only for paths the source does not
    include.  A row is reported if its parent is a directory on both sides.  With
    expand_missing, entries below a one-sided directory are reported too, unless
    some ancestor differs in kind.  With exit_early nothing below a differing
    directory is reported, and a missing one reports itself alone.

    The rows of both trees meet in one full outer join on the path.  What decides
    whether a row is reported comes from smaller joins of directories.
    """
    settings = parse_compare(compare) if isinstance(compare, str) else compare
    filtered = not (filter is None or filter.empty)
    s, d = apply_filter(src, filter), apply_filter(dst, filter)
    left = _side(s.where("walk = 'included'"), "s_").withColumn("s_in", F.lit(True))
    right = _side(d, "d_", "walk").withColumn("d_in", F.lit(True))
    rows = _verdicts(left.join(right, "rel_path", "full"), settings)
    if filtered:
        none = lambda t, n: F.lit(None).cast(t).alias(n)
        rows = rows.unionByName(s.where("walk = 'skipped'").select("rel_path", F.lit("skipped").alias("result"), F.col("kind").alias("src_kind"), none("string", "dst_kind"), F.col("size").alias("src_size"), none("bigint", "dst_size"), F.lit("src").alias("side")))

    s_dirs, d_dirs = left.where("s_kind = 'dir'"), right.where("d_kind = 'dir'")
    if expand_missing:
        swapped = s_dirs.join(right.where("d_kind <> 'dir'"), "rel_path").unionByName(left.where("s_kind <> 'dir'").join(d_dirs, "rel_path")).select("rel_path")
        if exit_early:
            met = _verdicts(s_dirs.join(d_dirs, "rel_path", "full"), settings)
            swapped = swapped.unionByName(met.where("result in ('different', 'src_missing', 'dst_missing')").select("rel_path"))
        folders = s_dirs.select("rel_path").unionByName(d_dirs.select("rel_path"))
        return without_below(rows, swapped, folders)
    both = s_dirs.join(d_dirs, "rel_path")
    if exit_early:
        met = _verdicts(both, settings)
        odd = met.where("result = 'different'").select("rel_path")
        both = without_below(met.join(odd, "rel_path", "left_anti"), odd)
    # The root's parent is written '/', which is no path.
    inside = both.select(F.col("rel_path").alias("_in")).unionByName(src.sparkSession.range(1).select(F.lit("/").alias("_in")))
    return rows.withColumn("_in", F.coalesce(parent("rel_path"), F.lit("/"))).join(inside, "_in", "left_semi").drop("_in")


def _verdicts(j: DataFrame, settings: dict) -> DataFrame:
    """Reported columns of joined sides s_ (included rows) and d_ (with walk); rows that neither side reports are left out."""
    both = F.col("s_in").isNotNull() & F.col("d_in").isNotNull()
    differ = (F.col("s_kind") != F.col("d_kind")) | ~equal_by_kind(settings, F.col("s_kind"), "s_", "d_")
    result = F.when(both & differ, "different").when(both, "same").when(F.col("s_in").isNotNull(), "dst_missing").when(F.col("d_walk") == "included", "src_missing").when(F.col("d_walk") == "skipped", "skipped")
    side = F.when(both, "both").when(F.col("s_in").isNotNull(), "src").otherwise("dst")
    return j.select("rel_path", result.alias("result"), F.col("s_kind").alias("src_kind"), F.col("d_kind").alias("dst_kind"), F.col("s_size").alias("src_size"), F.col("d_size").alias("dst_size"), side.alias("side")).where(F.col("result").isNotNull())


def _folders_below(rows: DataFrame, tops: DataFrame, folders: DataFrame | None) -> DataFrame:
    """(_in): the folders that hold rows and lie at or below one of tops.

    folders: paths that include every parent of rows, where they are known more
    cheaply than from rows.  Ancestors are made once for each folder, not for each row.
    """
    held = folders.select(F.col("rel_path").alias("_in")).distinct() if folders is not None else rows.select(parent("rel_path").alias("_in")).where("_in is not null").distinct()
    up = held.select("_in", F.explode(self_and_ancestors("_in")).alias("_up"))
    return up.join(tops.select(F.col("rel_path").alias("_up")).distinct(), "_up", "left_semi").select("_in").distinct()


def without_below(rows: DataFrame, blocked: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """rows without those that have a strict ancestor among blocked."""
    return rows.withColumn("_in", parent("rel_path")).join(_folders_below(rows, blocked, folders), "_in", "left_anti").drop("_in")


def at_or_below(rows: DataFrame, tops: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """rows that are among tops or below one, each once."""
    below = _folders_below(rows, tops, folders).withColumn("_below", F.lit(True))
    own = tops.select("rel_path").distinct().withColumn("_own", F.lit(True))
    return rows.withColumn("_in", parent("rel_path")).join(below, "_in", "left").join(own, "rel_path", "left").where("_below or _own").drop("_in", "_below", "_own")


def compare_summary(diff: DataFrame) -> DataFrame:
    """One row: counts by kind and result, skips by kind (other counts as file), bytes of files met, exit code."""
    kind = F.coalesce("src_kind", "dst_kind")
    counts = [F.count_if((F.col("result") == r) & (kind == k)).alias(f"{k}_{r}") for k in ("file", "dir", "symlink", "other") for r in RESULTS]
    as_file = F.when(kind == "other", "file").otherwise(kind)
    skips = [F.count_if((F.col("result") == "skipped") & (as_file == k)).alias(f"{k}_skipped") for k in ("file", "dir", "symlink")]
    met = F.col("result") != "skipped"
    size = lambda k: F.coalesce(F.sum(F.when(met & (F.col(f"{k}_kind") == "file"), F.col(f"{k}_size"))), F.lit(0)).alias(f"{k}_bytes")
    odd = F.col("result").isin("different", "src_missing", "dst_missing")
    return diff.agg(*counts, *skips, size("src"), size("dst"), F.coalesce(F.max(F.when(odd, 1).otherwise(0)), F.lit(0)).alias("exit_code"))


def format_diff(diff: DataFrame, src_root: str, dst_root: str, fmt: str = "json") -> DataFrame:
    """(rel_path, value): one line per difference; skips and equal entries have none."""
    src, dst = (escape_path(join_path(F.lit(r), F.col("rel_path"))) for r in (src_root, dst_root))
    d = diff.where(F.col("result").isin("different", "src_missing", "dst_missing"))
    if fmt == "json":
        value = F.to_json(F.struct(F.col("result"), F.col("src_kind").alias("src_type"), F.when(F.col("src_kind").isNotNull(), src).alias("src"), F.col("dst_kind").alias("dst_type"), F.when(F.col("dst_kind").isNotNull(), dst).alias("dst")), {"ignoreNullFields": "false"})
    elif fmt == "text":
        q = lambda kind, path: F.when(kind.isNotNull(), F.concat(kind, F.lit(' "'), path, F.lit('"'))).otherwise("-")
        value = F.concat_ws(" ", F.concat(F.lit("["), F.col("result"), F.lit("]")), q(F.col("src_kind"), src), q(F.col("dst_kind"), dst))
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return d.select("rel_path", value.alias("value"))


def trees_identical(a: DataFrame, b: DataFrame, level: str = "mtime") -> DataFrame:
    """(rel_path, problem): paths on one side only, and kinds, permission bits, link targets and (by level) times or inodes that differ."""
    of = lambda m, p: m.select("rel_path", *(F.col(c).alias(f"{p}_{c}") for c in ("kind", "mode", "link_target", "mtime_s", "mtime_ns", "ino")))
    j = of(a, "a").join(of(b, "b"), "rel_path", "full")
    problem = F.when(F.col("b_kind").isNull(), "only in a").when(F.col("a_kind").isNull(), "only in b").when(F.col("a_kind") != F.col("b_kind"), "kind")
    problem = problem.when(F.col("a_mode").bitwiseAND(0o7777) != F.col("b_mode").bitwiseAND(0o7777), "mode").when(~F.col("a_link_target").eqNullSafe(F.col("b_link_target")), "link_target")
    if level == "mtime":
        problem = problem.when(~(F.struct("a_mtime_s", "a_mtime_ns").eqNullSafe(F.struct(F.col("b_mtime_s"), F.col("b_mtime_ns")))), "mtime")
    elif level == "ino":
        problem = problem.when((F.col("a_kind") == "file") & ~F.col("a_ino").eqNullSafe(F.col("b_ino")), "ino")
    elif level != "paths":
        raise ValueError(f"unknown level {level!r}")
    return j.select("rel_path", problem.alias("problem")).where("problem is not null")


def path_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rel_path, status): added (only in b), removed (only in a) or common."""
    x, y = (m.select("rel_path").distinct().withColumn(c, F.lit(True)) for m, c in ((a, "_a"), (b, "_b")))
    return x.join(y, "rel_path", "full").select("rel_path", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("common").alias("status"))
