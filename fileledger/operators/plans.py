"""Plans: what a copy, a mirror's delete pass and a link run do to a destination, entry by entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.functions.acls import ENTRIES, OTHER, OWNING_GROUP, acl_entries, named, principal_text, rights, rights_text
from fileledger.functions.filters import FilterSettings, apply_filter, directly_matches, is_included
from fileledger.functions.metadata import Preserve, dest_is_newer, masked_mode, metadata_equal, parse_metadata_cmp, project_preserved, skip_unchanged
from fileledger.functions.paths import ancestors, depth, parent, self_and_ancestors
from fileledger.operators.compare import COMPARED, at_or_below, without_below
from fileledger.operators.policy import Policy, decide, left_out
from fileledger.operators.removal import marked_above, rm_plan
from fileledger.schema import MANIFEST_SCHEMA, conform
from fileledger.sources.scratch import written

CREATES = ("copy", "replace", "symlink", "touch_link", "hardlink", "copy_from_update")


def _prefixed(m: DataFrame, prefix: str, *more: str) -> DataFrame:
    return m.select("rel_path", *(F.col(c).alias(f"{prefix}{c}") for c in (*COMPARED, "link_target", *more)))


REMOVED = ("removed_files", "removed_dirs", "removed_symlinks", "removed_bytes")


def _with_removed(plan: DataFrame, dst: DataFrame | None, gone: Column, d_kind: str, d_size: str) -> DataFrame:
    """plan with counts of what goes where `gone` holds: the destination's entry (kind and size in the named columns) and all below it.

    What lies below is added up by directory of dst before ancestors are made, and
    only replaced directories read those sums.
    """
    kind = F.col(d_kind)
    leaf = {"removed_files": kind.isin("file", "other").cast("bigint"), "removed_dirs": F.lit(0), "removed_symlinks": (kind == "symlink").cast("bigint"), "removed_bytes": F.when(kind.isin("file", "other"), F.col(d_size)).otherwise(0)}
    if dst is None:
        return plan.withColumns({c: F.when(gone, F.coalesce(leaf[c], F.lit(0))).otherwise(0).cast("bigint") for c in REMOVED})
    is_dir = F.col("kind") == "dir"
    count = lambda *ks: F.count_if(F.col("kind").isin(*ks))
    sums = dst.groupBy(F.when(is_dir, F.col("rel_path")).otherwise(parent("rel_path")).alias("_f")).agg(count("file", "other").alias("removed_files"), count("dir").alias("removed_dirs"), count("symlink").alias("removed_symlinks"), F.sum(F.when(F.col("kind").isin("file", "other"), F.col("size"))).alias("removed_bytes"))
    sums = sums.where("_f is not null").select(F.explode(self_and_ancestors("_f")).alias("rel_path"), *REMOVED).groupBy("rel_path").agg(*(F.sum(c).alias(f"_{c}") for c in REMOVED))
    replaced_dir = gone & (kind == "dir")
    j = plan.join(sums.select(F.col("rel_path").alias("_top"), *(f"_{c}" for c in REMOVED)), (F.col("rel_path") == F.col("_top")) & replaced_dir, "left")
    return j.withColumns({c: F.when(replaced_dir, F.coalesce(f"_{c}", F.lit(0))).when(gone, F.coalesce(leaf[c], F.lit(0))).otherwise(0).cast("bigint") for c in REMOVED}).drop("_top", *(f"_{c}" for c in REMOVED))


def copy_actions(src: DataFrame, dst: DataFrame, overwrite: bool = False, overwrite_compare: str = "size,mtime", keep_newer: bool = False, ignore_existing: bool = False, skip_specials: bool = False, preserve: Preserve = Preserve(), dry_run: bool = False) -> DataFrame:
    """(rel_path, kind, size, action, dst_kind, _d_size) of source entries, each by itself: one left join on the path, no set of other rows."""
    live = _prefixed(src, "s_").join(_prefixed(dst, "d_"), "rel_path", "left")
    kind, there, d_kind = F.col("s_kind"), F.col("d_kind").isNotNull(), F.col("d_kind")
    links = preserve.symlink
    if dry_run:
        leaf = F.when(there & F.lit(ignore_existing), "unchanged")
        action = (
            F.when((kind == "dir") & F.lit(ignore_existing) & there & (d_kind != "dir"), "skip_existing").when(kind == "dir", "mkdir").when(kind == "other", F.lit("skip_special" if skip_specials else "error")).when(kind == "file", F.coalesce(leaf, F.lit("copy"))).otherwise(F.coalesce(leaf, F.lit("symlink")))
        )
    else:
        equal = metadata_equal(parse_metadata_cmp(overwrite_compare), "s_", "d_")
        clash = "skip_existing" if ignore_existing else "replace" if overwrite else "error"
        same_file = (d_kind == "file") & (equal | (dest_is_newer("s_", "d_") if keep_newer else F.lit(False)))
        same_link = (d_kind == "symlink") & F.col("s_link_target").eqNullSafe(F.col("d_link_target"))
        touch = same_link & ~equal if links.uid or links.gid or links.time else F.lit(False)
        exists = F.lit("unchanged") if ignore_existing else F.lit("error") if not overwrite else None
        for_file = exists if exists is not None else F.when(same_file, "unchanged").otherwise("replace")
        for_link = exists if exists is not None else F.when(touch, "touch_link").when(same_link, "unchanged").otherwise("replace")
        action = (
            F.when(kind == "dir", F.when(~there, "mkdir").when(d_kind == "dir", "reuse_dir").otherwise(clash))
            .when(kind == "file", F.when(~there, "copy").otherwise(for_file))
            .when(kind == "symlink", F.when(~there, "symlink").otherwise(for_link))
            .otherwise(F.lit("skip_special" if skip_specials else "error"))
        )
    return live.select("rel_path", kind.alias("kind"), F.col("s_size").alias("size"), action.alias("action"), d_kind.alias("dst_kind"), F.col("d_size").alias("_d_size"))


def copy_plan(src: DataFrame, dst: DataFrame, overwrite: bool = False, overwrite_compare: str = "size,mtime", keep_newer: bool = False, ignore_existing: bool = False, skip_specials: bool = False, filter: FilterSettings | None = None, preserve: Preserve = Preserve(), dry_run: bool = False, policy: Policy = ()) -> DataFrame:
    """(rel_path, kind, size, action, dst_kind, removed_files, removed_dirs, removed_symlinks, removed_bytes, reason) of every visited source entry.

    Entries below a directory that is skipped or fails are not visited.  Directories
    made for a filtered copy in which nothing ends up are drop_empty_dir.  Rules of a
    policy are named in reason; below a directory that one leaves out nothing is visited.
    """
    settings = filter or FilterSettings()
    s = apply_filter(src, settings)
    none = F.lit(None).cast("string")
    p = copy_actions(s.where("walk = 'included'"), dst, overwrite, overwrite_compare, keep_newer, ignore_existing, skip_specials, preserve, dry_run)
    p = decide(p, policy).withColumnRenamed("rule", "reason") if policy else p.withColumn("reason", none)
    out = left_out(p.withColumnRenamed("reason", "rule")) if policy else None
    if not settings.empty:
        p = p.unionByName(s.where("walk = 'skipped'").select("rel_path", "kind", "size", F.lit("skip_filter").alias("action"), none.alias("dst_kind"), F.lit(None).cast("bigint").alias("_d_size"), "reason"))
    # Only where a directory cannot take the place of what is there does anything go unvisited.
    if ignore_existing or not (overwrite or dry_run):
        folders = s.where("walk = 'included' and kind = 'dir'").select("rel_path")
        p = without_below(p, folders.join(dst.where("kind <> 'dir'"), "rel_path", "left_semi"), folders)
    if out is not None:
        p = without_below(p, out, s.where("walk = 'included' and kind = 'dir'").select("rel_path"))
    if settings.include:
        p = cleanup_empty_dirs(p, settings)
    replaces = overwrite and not ignore_existing and not dry_run
    p = _with_removed(p, dst if replaces else None, F.col("action").isin("replace", "touch_link"), "dst_kind", "_d_size")
    return p.select("rel_path", "kind", "size", "action", "dst_kind", *REMOVED, "reason")


def cleanup_empty_dirs(plan: DataFrame, settings: FilterSettings) -> DataFrame:
    """Turns created directories that neither match nor hold anything created into drop_empty_dir; the root stays."""
    made = (F.col("kind") == "dir") & F.col("action").isin("mkdir", "replace")
    direct = directly_matches(settings, F.col("rel_path"), F.col("kind") == "dir")
    seeds = plan.where(((F.col("kind") != "dir") & F.col("action").isin(*CREATES)) | (made & direct))
    kept = marked_above(seeds).withColumn("_kept", F.lit(True))
    p = plan.join(kept, "rel_path", "left")
    return p.withColumn("action", F.when(made & (F.col("rel_path") != "") & ~direct & F.col("_kept").isNull(), "drop_empty_dir").otherwise(F.col("action"))).drop("_kept")


def copy_summary(plan: DataFrame) -> DataFrame:
    """One row of counters; touch_link counts one link removed and one created."""
    a, k = F.col("action"), F.col("kind")
    n = lambda c: F.count_if(c)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    writes = a.isin("copy", "replace", "copy_from_update") & (k == "file")
    return plan.agg(
        total(F.when(writes, F.col("size"))).alias("bytes_copied"),
        n(writes).alias("files_copied"),
        n((k == "file") & (a == "unchanged")).alias("files_unchanged"),
        n((k == "symlink") & a.isin("symlink", "replace", "touch_link")).alias("symlinks_created"),
        n((k == "symlink") & (a == "unchanged")).alias("symlinks_unchanged"),
        n((k == "dir") & a.isin("mkdir", "replace")).alias("directories_created"),
        n((k == "dir") & (a == "reuse_dir")).alias("directories_unchanged"),
        n(k.isin("file", "other") & (a == "skip_filter")).alias("files_skipped"),
        n((k == "dir") & (a == "skip_filter")).alias("directories_skipped"),
        n((k == "symlink") & (a == "skip_filter")).alias("symlinks_skipped"),
        n(a == "skip_special").alias("specials_skipped"),
        n(a == "error").alias("errors"),
        *(total(F.col(c)).alias(c) for c in ("removed_bytes", "removed_files", "removed_symlinks", "removed_dirs")),
    )


def delete_plan(kept: DataFrame, shared_dirs: DataFrame, dst: DataFrame, filter: FilterSettings | None = None, delete_excluded: bool = False, errors: DataFrame | None = None) -> DataFrame:
    """rm_plan rows of what a mirror removes: entries of dst in shared_dirs that are not kept, and what is below them.

    Excluded entries are protected unless delete_excluded.  Directories with an error
    at or below them are left as they are.
    """
    settings = FilterSettings() if delete_excluded or filter is None else filter
    d = dst.withColumn("_in", parent("rel_path")).where("_in is not null")
    dirs = shared_dirs.select(F.col("rel_path").alias("_in")).distinct()
    if errors is not None:
        exempt = errors.select(F.explode(ancestors("rel_path")).alias("_in")).unionByName(errors.select(F.col("rel_path").alias("_in"))).distinct()
        dirs = dirs.join(exempt, "_in", "left_anti")
    tops = d.join(dirs, "_in", "left_semi").join(kept.select("rel_path"), "rel_path", "left_anti")
    tops = tops.where(is_included(settings, F.col("rel_path"), F.col("kind") == "dir")).select("rel_path")
    # What goes is read several times below, and is mostly small beside the trees it comes from.
    return rm_plan(written(at_or_below(dst, tops, dst.where("kind = 'dir'")), "delete-rows"), settings)


def mirror_delete_plan(src: DataFrame, dst: DataFrame, filter: FilterSettings | None = None, delete_excluded: bool = False, errors: DataFrame | None = None) -> DataFrame:
    kept = apply_filter(src, filter).where("walk = 'included'")
    both = kept.where("kind = 'dir'").select("rel_path").join(dst.where("kind = 'dir'").select("rel_path"), "rel_path")
    return delete_plan(kept, both, dst, filter, delete_excluded, errors)


def link_plan(src: DataFrame, update: DataFrame | None = None, dst: DataFrame | None = None, update_compare: str = "size,mtime", update_exclusive: bool = False, overwrite: bool = False, filter: FilterSettings | None = None, skip_specials: bool = False, policy: Policy = ()) -> DataFrame:
    """(rel_path, kind, size, action, origin, dst_kind, removed counters): hardlink, link_unchanged, relink, copy_from_update, symlink, mkdir, reuse_dir, unchanged, replace, skip_special, none or error.

    One join of the three trees on the path.  Entries of the source below one whose
    kind differs in the update are not visited, nor is anything below a directory
    that fails because the destination has something else in its place.  With a policy
    there is a column rule, and nothing below a directory that a rule leaves out is visited.
    """
    attributes = parse_metadata_cmp(update_compare)
    s = _prefixed(apply_filter(src, filter).where("walk = 'included'"), "s_", "dev", "ino")
    empty = src.limit(0)
    u = _prefixed(apply_filter(update if update is not None else empty, filter).where("walk = 'included'"), "u_")
    d = _prefixed(dst if dst is not None else empty, "d_", "dev", "ino")
    j = s.join(u, "rel_path", "full").join(d, "rel_path", "left")
    sk, uk, dk = (F.col(f"{x}_kind") for x in "sud")
    special = F.lit("skip_special" if skip_specials else "error")
    only_src = F.when(sk.isNull(), None)
    if update_exclusive and update is not None:
        only_src = F.lit("none")
    else:
        only_src = F.when(sk == "dir", "dir").when(sk == "file", "hardlink").when(sk == "symlink", "symlink").otherwise(special)
    from_update = F.when(uk == "dir", "dir").when(uk == "file", "copy_from_update").when(uk == "symlink", "symlink").otherwise(special)
    want = (
        F.when(uk.isNull(), only_src)
        .when(sk.isNull() | (sk != uk), from_update)
        .when(sk == "file", F.when(metadata_equal(attributes, "s_", "u_"), "hardlink").otherwise("copy_from_update"))
        .otherwise(from_update)
    )
    origin = F.when(uk.isNotNull() & ~((want == "hardlink") & sk.isNotNull()), "update").otherwise("src")
    j = j.withColumns({"_want": want, "_origin": origin})
    kind = F.when(F.col("_origin") == "update", uk).otherwise(sk)
    size = F.when(F.col("_origin") == "update", F.col("u_size")).otherwise(F.col("s_size"))
    target = F.when(F.col("_origin") == "update", F.col("u_link_target")).otherwise(F.col("s_link_target"))
    linked = (dk == sk) & (F.col("d_dev") == F.col("s_dev")) & (F.col("d_ino") == F.col("s_ino"))
    w = F.col("_want")
    clash = F.lit("replace" if overwrite else "error")
    relink = F.when(F.lit(overwrite) & F.coalesce(linked, F.lit(False)), "link_unchanged").when(F.lit(overwrite), "relink").otherwise("error")
    recopy = F.when(F.lit(overwrite) & (dk == "file") & metadata_equal(parse_metadata_cmp("size,mtime"), "u_", "d_"), "unchanged").otherwise(clash)
    resym = F.when(F.lit(overwrite) & (dk == "symlink") & target.eqNullSafe(F.col("d_link_target")), "unchanged").otherwise(clash)
    action = F.when(w == "dir", F.when(dk.isNull(), "mkdir").when(dk == "dir", "reuse_dir").otherwise(clash)).when(dk.isNull() | w.isin("none", "skip_special", "error"), w).when(w == "hardlink", relink).when(w == "copy_from_update", recopy).otherwise(resym)
    rows = j.select("rel_path", kind.alias("kind"), size.alias("size"), action.alias("action"), F.col("_origin").alias("origin"), dk.alias("dst_kind"), F.col("d_size").alias("_d_size"))
    s_dirs, u_dirs = s.where("s_kind = 'dir'").select("rel_path"), u.where("u_kind = 'dir'").select("rel_path")
    folders, blocked = s_dirs.unionByName(u_dirs), None
    if update is not None:
        blocked = s_dirs.join(u.where("u_kind <> 'dir'"), "rel_path", "left_semi")
    if dst is not None and not overwrite:
        made = u_dirs if update_exclusive and update is not None else folders
        failed = made.join(d.where("d_kind <> 'dir'"), "rel_path", "left_semi")
        blocked = failed if blocked is None else blocked.unionByName(failed)
    if policy:
        rows = decide(rows, policy)
        blocked = left_out(rows) if blocked is None else blocked.unionByName(left_out(rows))
    if blocked is not None:
        rows = without_below(rows, blocked, folders)
    rows = _with_removed(rows, dst if overwrite else None, F.col("action").isin("replace", "relink"), "dst_kind", "_d_size")
    return rows.drop("_d_size")


def link_summary(plan: DataFrame) -> DataFrame:
    """One row: hard links, links unchanged, the copy counters of the rest, and what was removed to make room."""
    a, k = F.col("action"), F.col("kind")
    writes = (k == "file") & (a == "copy_from_update") | ((k == "file") & (a == "replace") & (F.col("origin") == "update"))
    n, total = F.count_if, lambda c: F.coalesce(F.sum(c), F.lit(0))
    return plan.agg(
        n(a.isin("hardlink", "relink")).alias("hard_links_created"),
        n(a == "link_unchanged").alias("hard_links_unchanged"),
        n(writes).alias("files_copied"),
        total(F.when(writes, F.col("size"))).alias("bytes_copied"),
        n((k == "file") & (a == "unchanged")).alias("files_unchanged"),
        n((k == "symlink") & a.isin("symlink", "replace")).alias("symlinks_created"),
        n((k == "symlink") & (a == "unchanged")).alias("symlinks_unchanged"),
        n((k == "dir") & a.isin("mkdir", "replace")).alias("directories_created"),
        n((k == "dir") & (a == "reuse_dir")).alias("directories_unchanged"),
        n(a == "skip_special").alias("specials_skipped"),
        n(a == "error").alias("errors"),
        *(total(F.col(c)).alias(c) for c in REMOVED),
    )


def link_delete_plan(src: DataFrame, update: DataFrame | None, dst: DataFrame, update_exclusive: bool = False, filter: FilterSettings | None = None, delete_excluded: bool = False) -> DataFrame:
    """As mirror_delete_plan, keeping source and update paths, or the update's alone where it is exclusive."""
    sides = [update] if update is not None and update_exclusive else [x for x in (src, update) if x is not None]
    kept = None
    for side in sides:
        k = apply_filter(side, filter).where("walk = 'included'").select("rel_path", "kind")
        kept = k if kept is None else kept.unionByName(k)
    kept = kept.groupBy("rel_path").agg(F.max(F.when(F.col("kind") == "dir", 1).otherwise(0)).alias("_dir"))
    both = kept.where("_dir = 1").select("rel_path").join(dst.where("kind = 'dir'").select("rel_path"), "rel_path")
    return delete_plan(kept, both, dst, filter, delete_excluded)


def transfer_candidates(src: DataFrame, dst: DataFrame, compare: str = "size,mtime", ignore_existing: bool = False, keep_newer: bool = False, max_entries: int = 5_000_000) -> DataFrame:
    """(rel_path, size, send): files of src; directories with more destination entries than max_entries send everything."""
    s, d = _prefixed(src.where("kind = 'file'"), "s_"), _prefixed(dst, "d_")
    large = dst.groupBy(parent("rel_path").alias("_in")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_entries).select("_in", F.lit(True).alias("_large"))
    j = s.join(d, "rel_path", "left").withColumn("_in", parent("rel_path")).join(large, "_in", "left")
    skip = skip_unchanged(parse_metadata_cmp(compare), "s_", "d_", ignore_existing, keep_newer)
    return j.select("rel_path", F.col("s_size").alias("size"), (F.col("_large").isNotNull() | ~skip).alias("send"))


def exclude_failed(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """rows not at or below a failed directory."""
    f = failed.select("rel_path").distinct()
    return without_below(rows.join(f, "rel_path", "left_anti"), f)


def hardlink_groups(m: DataFrame) -> DataFrame:
    """(dev, ino, n, first): files that share an inode."""
    return m.where("kind = 'file' and ino is not null").groupBy("dev", "ino").agg(F.count(F.lit(1)).alias("n"), F.min("rel_path").alias("first")).where("n > 1")


def already_linked(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(rel_path): entries that both trees hold as the same inode."""
    key = ["rel_path", "kind", "dev", "ino"]
    return src.select(*key).join(dst.select(*key), key, "left_semi").select("rel_path")


def merge_run_summaries(source: DataFrame, dest: DataFrame, dry_run: bool = False, key: str = "run_id") -> DataFrame:
    """One row per run: skip counters from the source, all others from the destination (from the source in a dry run)."""
    names = [c for c in source.columns if c != key]
    s, d = source.select(key, *(F.col(c).alias(f"s_{c}") for c in names)), dest.select(key, *(F.col(c).alias(f"d_{c}") for c in names))
    pick = lambda c: F.col(f"s_{c}") if dry_run or c.endswith("_skipped") else F.col(f"d_{c}")
    return s.join(d, key).select(key, *(F.coalesce(pick(c), F.lit(0)).alias(c) for c in names))


def apply_plan(src: DataFrame, dst: DataFrame, plan: DataFrame, preserve: Preserve = Preserve(), uid: int = 0, gid: int = 0, now_s: int = 0) -> DataFrame:
    """The destination's manifest after a copy plan."""
    acts = plan.select("rel_path", "action")
    made = acts.where(F.col("action").isin("copy", "replace", "symlink", "touch_link", "mkdir", "reuse_dir"))
    new = project_preserved(conform(src), preserve, uid, gid, now_s).join(made.select("rel_path"), "rel_path", "left_semi")
    return _placed(dst, new, made.select("rel_path"), acts.where("action = 'replace'"))


def _placed(dst: DataFrame, new: DataFrame, made: DataFrame, gone: DataFrame) -> DataFrame:
    """dst with new in the place of made, and nothing below gone."""
    names = [f.name for f in MANIFEST_SCHEMA.fields]
    stays = without_below(conform(dst), gone.select("rel_path")).join(made, "rel_path", "left_anti")
    return stays.select(*names).unionByName(new.select(*names))


def apply_link_plan(src: DataFrame, update: DataFrame | None, dst: DataFrame, plan: DataFrame, preserve: Preserve = Preserve(), uid: int = 0, gid: int = 0, now_s: int = 0) -> DataFrame:
    """The destination's manifest after a link run: a hard link is the source's row, inode and all; the rest is copied."""
    acts = plan.select("rel_path", "action", "origin")
    links = acts.where(F.col("action").isin("hardlink", "relink", "link_unchanged"))
    made = acts.where(F.col("action").isin("copy_from_update", "symlink", "replace", "mkdir", "reuse_dir"))
    new = conform(src).join(links.select("rel_path"), "rel_path", "left_semi")
    for side, tree in (("src", src), ("update", update)):
        if tree is not None:
            new = new.unionByName(project_preserved(conform(tree), preserve, uid, gid, now_s).join(made.where(F.col("origin") == side).select("rel_path"), "rel_path", "left_semi").select(*new.columns))
    return _placed(dst, new, links.select("rel_path").unionByName(made.select("rel_path")), acts.where("action in ('replace', 'relink')"))


def apply_removals(m: DataFrame, plan: DataFrame) -> DataFrame:
    """The manifest after an rm, mirror or link delete plan."""
    return m.join(plan.where("action = 'remove'").select("rel_path"), "rel_path", "left_anti")


def acl_audit(src: DataFrame, dst: DataFrame, preserve: Preserve) -> DataFrame:
    """(rel_path, principal, before, after, problem): who may do more with a copy than with its source, by rights before and after.

    Asked are the users and groups named in the source's list or in one the copy inherits,
    the owning group and all others.  A copy that keeps no list has its mode, and where a
    directory above it has a default list in the destination, that list under the mode: the
    nearest one that is there counts, as directories made below it pass it on.  Directories that
    are there inherit nothing.  Where lists are kept but the source's is not known, that is the
    problem.
    """
    kinds = ("file", "dir")
    kept = F.lit(False)
    mode = F.col("mode")
    for kind in kinds:
        at = preserve.of(kind)
        kept = F.when(F.col("kind") == kind, at.acl).otherwise(kept)
        mode = F.when(F.col("kind") == kind, masked_mode(F.col("mode"), at.mask)).otherwise(mode)
    captured = F.coalesce(F.col("acl.captured"), F.lit(False))
    s = src.where(F.col("kind").isin(*kinds)).select("rel_path", "kind", F.col("mode").alias("_mode"), mode.alias("_copied"), kept.alias("_kept"), captured.alias("_captured"), acl_entries(F.col("acl.access")).alias("_own"), parent("rel_path").alias("_in"))

    # The default list in effect in each folder of the source: of the nearest directory above, itself included, that the destination has.
    there = dst.where("kind = 'dir'").select(F.col("rel_path").alias("_at"), F.col("acl.default").alias("_default"))
    folders = s.where("kind = 'dir'").select("rel_path").distinct()
    up = folders.select(F.col("rel_path").alias("_in"), F.explode(self_and_ancestors("rel_path")).alias("_at")).join(there, "_at")
    heirs = up.groupBy("_in").agg(F.max_by("_default", depth("_at")).alias("_default")).where("_default is not null").select("_in", acl_entries(F.col("_default")).alias("_inherited"))
    made = there.select(F.col("_at").alias("rel_path"), F.lit(True).alias("_there"))
    s = s.join(heirs, "_in", "left").join(made, "rel_path", "left")
    none = F.array().cast(ENTRIES)
    after = F.when((F.col("kind") == "dir") & F.col("_there").isNotNull(), none).otherwise(F.coalesce("_inherited", none))
    s = s.withColumn("_after", after)

    unknown = s.where("_kept and not _captured").select("rel_path", *(F.lit(None).cast("string").alias(c) for c in ("principal", "before", "after")), F.lit("source ACL is unknown").alias("problem"))
    plain = lambda tag: F.struct(F.lit(tag).alias("tag"), F.lit(None).cast("bigint").alias("id"))
    asked = F.array_distinct(F.concat(named(F.col("_own")), named(F.col("_after")), F.array(plain(OWNING_GROUP), plain(OTHER))))
    w = s.where("not _kept and (size(_own) > 0 or size(_after) > 0)").withColumn("_who", F.explode(asked))
    tag, id_ = F.col("_who.tag"), F.col("_who.id")
    w = w.withColumns({"_before": rights(F.col("_own"), F.col("_mode"), tag, id_), "_now": rights(F.col("_after"), F.col("_copied"), tag, id_, mode_rules=True)})
    more = w.where(F.col("_now").bitwiseAND(F.bitwise_not("_before")) != 0)
    problem = F.when(F.size("_own") > 0, "source ACL is dropped").otherwise("inherits a default ACL")
    return unknown.unionByName(more.select("rel_path", principal_text(tag, id_).alias("principal"), rights_text(F.col("_before")).alias("before"), rights_text(F.col("_now")).alias("after"), problem.alias("problem")))
